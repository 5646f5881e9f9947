"""Main text of web pages by consensus of their hosts.

Each page's containers are scored by the text of the blocks in them, less their links.  The best one is a vote for
its path: the tags and classes from the root down, with digits made alike.  Spark counts the votes of each host, and
every page is read again with its host's winning path; a page that has nothing there is read at its own best place.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader comments are left out wherever they
stand, by their tags, roles and class names.  Names like sidebar leave nothing out that holds most of a page's text.

Defined results: a null or empty page, and one without text in a container, gives an empty text; pages without a host
vote for themselves alone; unclosed and misplaced tags are closed as browsers close them; every row gives one row,
rows that repeat an id included.  Votes are as many rows as pages at most; a host with a third of all pages is
counted before it is shuffled.  Pages of hosts with a large share of all pages, and pages without a host, are not
shuffled at all: the paths of the former are sent to them, at most ``SHARE`` rows of at most ``PATH_CHARS`` characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import schema_of, short_batches, slices, stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Kinds of tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section"
    " select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body div main section table td center blockquote".split())
OUT = frozenset(
    "aside audio button canvas dialog footer form head header menu nav object select svg math video fieldset".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: A start tag closes the open element of one of these tags, if no element of the second list is open in it.
CLOSES = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("tr td th thead tbody tfoot", "table"),
    "thead": ("tr td th thead tbody tfoot", "table"),
    "tfoot": ("tr td th thead tbody tfoot", "table"),
    "option": ("option", "select"),
}
CLOSES = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in CLOSES.items()}
#: An end tag closes nothing outside the innermost of these; one of a table's parts, nothing outside its table.
WALLS, TABLE = frozenset("td th table".split()), frozenset("table tbody td tfoot th thead tr body html".split())

#: Parts of class names and ids of what is no main text, however much of a page it is.
NAMES_OUT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|breadcrumbs?|cookies?|cookiebar|consent|gdpr|popup\w*|modal\w*"
    r"|newsletter\w*|subscri\w*|signup|login|share|sharing|social\w*|related|recommend\w*|comment\w*|disqus\w*"
    r"|repl(?:y|ies)|respond|pagination|pager)(?:$|[\s_-])"
)
#: The same of parts that are named after what stands beside them as well.
NAMES_BESIDE = re.compile(
    r"(?:^|[\s_-])(?:banner|side|sidebar\w*|nav|navbar|navigation|menu\w*|header|masthead|footer|privacy|notices?"
    r"|notifications?|alerts?|overlay|widgets?|toolbar|search\w*|form)(?:$|[\s_-])"
)
#: The share of a page's text from which on such a name leaves nothing out.
MOST = 0.6
#: What a block counts in a container, for each container between them.
DECAY = 0.6
#: Plain pages have their text here.
ROOT = "html"
#: A host is large if it has one of so many pages; longest host and path that are sent to all tasks.
SHARE, PATH_CHARS = 1000, 10_000


class Page:
    """A page as elements and blocks of text in page order."""

    def __init__(self, html: str):
        self.tags, self.labels, self.parents = [ROOT], [ROOT], [-1]
        self.out = [0]  # 1: unless it holds most of the text, 2: in any case
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._read(html)
        self._settle()

    def _read(self, html: str) -> None:
        stack, parts, linked, links, at = [0], [], 0, 0, 0
        tags = self.tags

        def flush() -> None:
            nonlocal parts, linked
            if parts and (text := " ".join("".join(parts).split())):
                element = next(e for e in reversed(stack) if tags[e] in BLOCK)
                self.blocks.append((element, text, linked))
            parts, linked = [], 0

        def say(raw: str) -> None:
            nonlocal linked
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

        def close(place: int) -> None:
            nonlocal links
            if any(tags[e] in BLOCK for e in stack[place:]):
                flush()
            links -= sum(tags[e] == "a" for e in stack[place:])
            del stack[place:]

        search = TOKEN.search
        while True:
            token = search(html, at)
            if token is None:
                say(html[at:])
                break
            if token.start() > at:
                say(html[at : token.start()])
            at = token.end()
            tag = token[2]
            if tag is None:
                continue
            tag = tag.lower()
            if token[1]:
                for place in range(len(stack) - 1, 0, -1):
                    if tags[stack[place]] == tag:
                        close(place)
                        break
                    if tags[stack[place]] == "table" or (tags[stack[place]] in WALLS and tag not in TABLE):
                        break
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag == "html" or (tag == "body" and "body" in (tags[e] for e in stack)):
                continue
            if tag in BLOCK:
                flush()
                for place in range(len(stack) - 1, 0, -1):
                    if tags[stack[place]] == "p":
                        close(place)
                        break
                    if tags[stack[place]] in CONTAINER:
                        break
                if tag == "body" and len(stack) > 1:
                    close(1)
            if tag in CLOSES:
                ends, stops = CLOSES[tag]
                while True:
                    place = next((i for i in range(len(stack) - 1, 0, -1) if tags[stack[i]] in ends | stops), 0)
                    if not place or tags[stack[place]] in stops:
                        break
                    close(place)
            if tag in VOID:
                continue
            stack.append(self._element(tag, token[3], stack[-1]))
            links += tag == "a"
            if token[3].endswith("/") and tag in ("svg", "math", "path"):
                close(len(stack) - 1)
        flush()

    def _element(self, tag: str, rest: str, parent: int) -> int:
        names, out = "", 2 if tag in OUT else 0
        if rest.strip(" /"):
            given = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}
            names = given.get("class", "")
            style = given.get("style", "").replace(" ", "").lower()
            if (
                given.get("role", "").lower() in ROLES
                or "hidden" in given
                or given.get("aria-hidden") == "true"
                or "display:none" in style
            ):
                out = 2
            elif not out and tag not in ("html", "body", "main", "article"):
                named = re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{names} {given.get('id', '')}").lower()
                out = 2 if NAMES_OUT.search(named) else 1 if NAMES_BESIDE.search(named) else 0
        classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in names.split()})
        self.tags.append(tag)
        self.labels.append(".".join([tag, *classes]))
        self.parents.append(parent)
        self.out.append(out)
        return len(self.tags) - 1

    def _settle(self) -> None:
        """Some names leave nothing out that holds most of the text; what is left out takes all within along."""
        size = [0] * len(self.tags)
        for element, text, _ in self.blocks:
            size[element] += len(text)
        for e in range(len(self.tags) - 1, 0, -1):
            if self.out[e] < 2:
                size[self.parents[e]] += size[e]
        for e in range(1, len(self.tags)):
            if self.out[e] == 1 and size[e] > MOST * size[0]:
                self.out[e] = 0
            self.out[e] = max(self.out[e], self.out[self.parents[e]])

    def path(self, element: int) -> str:
        labels = []
        while element >= 0:
            labels.append(self.labels[element])
            element = self.parents[element]
        return ">".join(reversed(labels))

    def best(self) -> tuple[int, float] | None:
        """The container with the highest score: text in its blocks, and a share of that in each level further down."""
        scores: dict[int, float] = {}
        for element, text, linked in self.blocks:
            if self.out[element]:
                continue
            value, share = len(text) - 2.0 * linked, 1.0
            while element >= 0 and share > 0.2:
                if self.tags[element] in CONTAINER or element == 0:
                    scores[element] = scores.get(element, 0.0) + value * share
                    share *= DECAY
                element = self.parents[element]
        if not scores:
            return None
        element = max(scores, key=lambda e: (scores[e], -e))
        score, place = scores[element], element
        while place >= 0:  # an article is whole
            if self.tags[place] == "article":
                element = place
                break
            place = self.parents[place]
        return element, score

    def text(self, within: set[int]) -> str:
        inside = [False] * len(self.tags)
        for e in range(len(self.tags)):
            inside[e] = e in within or (e > 0 and inside[self.parents[e]])
        return "\n\n".join(t for e, t, _ in self.blocks if inside[e] and not self.out[e])

    def main_text(self, path: str | None) -> str:
        if path is not None:
            label = path.rpartition(">")[2]
            places = {e for e, x in enumerate(self.labels) if x == label and not self.out[e] and self.path(e) == path}
            if places and (text := self.text(places)):
                return text
        best = self.best()
        return self.text({best[0]}) if best else ""


def host_of(url: str) -> F.Column:
    """The host of an address in lower case; null without one."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(found, F.lit(""))


def container_votes(pages: DataFrame) -> DataFrame:
    """(host, path, score) of each page's best container, from ``_host`` and ``_html``; no path without one."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html or "")
                best = page.best()
                rows.append((host, page.path(best[0]), best[1]) if best else (host, None, 0.0))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            kinds = pa.string(), pa.string(), pa.float64()
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "path", "score"])

    hosted = pages.where("_host is not null").select("_host", "_html")
    return hosted.mapInArrow(step, "host string, path string, score double")


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, path, pages): the path with most votes, then with most text, of each host, and its number of pages.

    The path is null where no page of the host has a container with text.
    """
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("score")).alias("score"))
    vote = F.when(F.col("path").isNotNull(), F.struct("n", "score", "path"))
    best = counted.groupBy("host").agg(F.max(vote).alias("best"), F.sum("n").alias("pages"))
    return best.select("host", F.col("best.path").alias("path"), "pages")


def extract(df: DataFrame, keep: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """Columns ``keep`` of each page and ``text``, its main text: blocks of text with an empty line between them."""
    kept = [F.col(c).alias(f"_{i}_keep") for i, c in enumerate(keep)]
    pages = df.select(host_of(url).alias("_host"), F.col(html).alias("_html"), *kept)
    short_batches(df.sparkSession)
    winners = stored(winning_paths(container_votes(pages)), "host-paths")
    total = winners.agg(F.sum("pages")).first()[0] or 0
    sendable = F.length("host") + F.coalesce(F.length("path"), F.lit(0)) <= PATH_CHARS
    large = (F.col("pages") * SHARE >= total) & sendable
    winners = winners.select(F.col("host").alias("_host"), F.col("path").alias("_path"), large.alias("_large"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            texts = [Page(x or "").main_text(path) for x, path in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string())], names=[*keep, "text"])

    sent = F.broadcast(winners.where("_large"))
    unmoved = pages.join(sent, "_host", "left").where("_large or _host is null")
    moved = pages.where("_host is not null").join(sent, "_host", "left_anti")
    moved = moved.join(winners.where("not _large").hint("merge"), "_host", "left")
    columns = "_html", "_path", *(f"_{i}_keep" for i in range(len(keep)))
    placed = unmoved.select(*columns).unionByName(moved.select(*columns))
    return placed.mapInArrow(step, schema_of(df, keep, "text string"))
