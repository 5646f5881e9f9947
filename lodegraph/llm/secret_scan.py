"""Secrets in texts, with built-in functions only.

Three kinds of strings are found by their form (``assign``, ``access``, ``hex``).  Further ones are found by how
random they look: candidate strings are gone through with a sliding window whose character counts are kept up to
date from one place to the next (one character leaves, one enters), and the windows whose Shannon entropy reaches the
limit of their character class are joined into spans.  Windows that touch a string of the allow list do not count,
the other windows of the same candidate do; found by form, such strings stay.  A candidate is gone through in blocks
of ``BLOCK`` windows, so that the work grows with its length.

Places are code points, ends exclusive.  Defined results: a null or empty text has no spans; every row gives one row,
repeated rows included.  Very long runs of one character class are candidates like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The forms of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
#: The same matches where the length can stand in the pattern: a run of these is never cut by another match.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"

#: Character classes of candidates: name, pattern, length of the window, least entropy of a window in bits.  A
#: candidate of the second class has letters and a digit.  Random strings lie about 0.3 bits above these limits.
CLASSES = (
    ("random_hex", r"(?<![0-9A-Za-z])[0-9A-F]{20,}(?![0-9A-Za-z])", 20, 2.8),
    ("random_text", r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[0-9A-Za-z+/_-]{20,}", 20, 3.6),
)
#: Strings that look random and are none: identifiers in their usual form, counting alphabets, samples.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$|wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    r"|(?i)example|sample|placeholder|changeme|abcdefghij|0123456789|1234567890"
)

#: Windows that are gone through at a time.
BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(text: Column, pattern: str, matches: Column) -> Column:
    """(start, end) of each match, from the lengths of the matches and of what lies between them."""
    between = F.split(text, pattern, -1)

    def of(parts: Column) -> Column:
        steps = F.zip_with(
            F.transform(F.slice(parts, F.lit(1), F.size(matches)), lambda x: F.length(x)),
            F.transform(matches, lambda x: F.length(x)),
            lambda gap, own: F.struct(gap.alias("gap"), own.alias("own")),
        )
        return F.aggregate(
            steps,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("found")),
            lambda s, step: F.struct(
                (s["at"] + step["gap"] + step["own"]).alias("at"),
                F.concat(
                    s["found"],
                    F.array(
                        F.struct(
                            (s["at"] + step["gap"]).alias("a"), (s["at"] + step["gap"] + step["own"]).alias("b")
                        )
                    ),
                ).alias("found"),
            ),
        )["found"]

    return let(between, of)


def masked(word: Column) -> Column:
    """``word`` with spaces, which no candidate has, in place of what the allow list matches."""
    gaps, found = F.split(word, ALLOWED, -1), F.regexp_extract_all(word, F.lit(ALLOWED), F.lit(0))
    blank = lambda own: F.repeat(F.lit(" "), F.coalesce(F.length(own), F.lit(0)))
    parts = F.zip_with(gaps, found, lambda gap, own: F.concat(gap, blank(own)))
    return F.when(F.regexp_like(word, F.lit(ALLOWED)), F.array_join(parts, "")).otherwise(word)


def blocks(starts: Column, words: Column, width: int) -> Column:
    """(at, chars) of the blocks of ``words`` (arrays of pieces), each with the first characters of the next one."""

    def block(start: Column, pieces: Column, piece: Column, i: Column) -> Column:
        beyond = F.substring(F.coalesce(F.get(pieces, i + 1), F.lit("")), 1, width - 1)
        return F.struct((start["a"] + i * BLOCK).alias("at"), F.split(F.concat(piece, beyond), "").alias("chars"))

    return F.flatten(
        F.zip_with(starts, words, lambda start, pieces: F.transform(pieces, lambda x, i: block(start, pieces, x, i)))
    )


def joined(found: Column) -> Column:
    """Spans in order of their starts, those that touch made one: a span starts where it leaves all before it."""
    opens = F.filter(found, lambda x, i: (i == 0) | (F.get(found, i - 1)["b"] < x["a"]))
    ends = F.filter(found, lambda x, i: F.coalesce(F.get(found, i + 1)["a"] > x["b"], F.lit(True)))
    return F.zip_with(opens, ends, lambda x, y: F.struct(x["a"].alias("a"), y["b"].alias("b")))


def block_windows(at: Column, chars: Column, width: int, least: float) -> Column:
    """(start, end) of the joined windows among ``chars``, of which the first is at ``at``.

    A window belongs to the block in which it starts.

    The entropy of a window is ``log2(width) - sum(n log2 n) / width`` over the counts n of its characters.  The
    counts are a map from character to number; a step lowers one and raises one, and the sum follows.
    """
    whole = F.log2(F.lit(float(width)))
    limit = (whole - F.lit(least)) * width + 1e-9

    def cost(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def count(counts: Column, char: Column) -> Column:
        return F.coalesce(F.element_at(counts, char), F.lit(0))

    def moved(counts: Column, char: Column, by: int) -> Column:
        """The counts with one of them changed; characters that are gone leave the map."""
        return F.map_filter(
            F.map_concat(
                F.map_filter(counts, lambda k, _: k != char),
                F.map_from_arrays(F.array(char), F.array(count(counts, char) + by)),
            ),
            lambda _, n: n > 0,
        )

    def char(i: Column) -> Column:
        return F.get(chars, i - 1)

    def step(state: Column, i: Column) -> Column:
        enters = char(i)
        entered = count(state["counts"], enters)
        first = F.struct(
            moved(state["counts"], enters, 1).alias("counts"),
            (state["sum"] + cost(entered + 1) - cost(entered)).alias("sum"),
        )

        def leave(now: Column) -> Column:
            leaves = char(i - width)
            n = count(now["counts"], leaves)
            return F.when(
                i > width,
                F.struct(
                    moved(now["counts"], leaves, -1).alias("counts"), (now["sum"] + cost(n - 1) - cost(n)).alias("sum")
                ),
            ).otherwise(now)

        def join(now: Column) -> Column:
            found, begin = state["found"], i - width
            last = F.get(found, F.size(found) - 1)
            fresh = F.struct((at + begin).alias("a"), (at + i).alias("b"))
            longer = F.struct(last["a"].alias("a"), (at + i).alias("b"))
            joined = (
                F.when((i < width) | (now["sum"] > limit) | (count(now["counts"], F.lit(" ")) > 0), found)
                .when(
                    (F.size(found) > 0) & (last["b"] >= at + begin),
                    F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(longer)),
                )
                .otherwise(F.concat(found, F.array(fresh)))
            )
            return F.struct(now["counts"].alias("counts"), now["sum"].alias("sum"), joined.alias("found"))

        return let(let(first, leave), join)

    start = F.struct(
        F.expr("cast(map() as map<string,int>)").alias("counts"),
        F.lit(0.0).alias("sum"),
        F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("found"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step)["found"]


def in_block(width: int, least: float) -> Callable[[Column], Column]:
    return lambda x: block_windows(x["at"], x["chars"], width, least)


def spans_of(kind: str, rank: int, found: Column) -> Column:
    return F.transform(
        found,
        lambda x: F.struct(x["a"].alias("a"), F.lit(rank).alias("rank"), x["b"].alias("b"), F.lit(kind).alias("kind")),
    )


def scan(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of each row, and ``base`` and ``spans``: arrays of (a, rank, b, kind), ordered by start.

    ``base`` has the matches of the base kinds; ``spans`` has these and the random-looking strings.
    """
    kept = [F.col(c).alias(f"_{i}_keep") for i, c in enumerate(keep)]
    rows = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    t = F.col("_text")
    rows = rows.withColumns(
        {
            "_assign": F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0)),
            "_access": F.regexp_extract_all(t, F.lit(LONG_ACCESS), F.lit(0)),
            "_hex": F.regexp_extract_all(t, F.lit(LONG_HEX), F.lit(0)),
            **{f"_{n}": F.regexp_extract_all(t, F.lit(p), F.lit(0)) for n, p, *_ in CLASSES},
        }
    )
    none = F.expr("cast(array() as array<struct<a:int,rank:int,b:int,kind:string>>)")

    def base(kind: str, rank: int, column: str, pattern: str, good: Callable[[Column], Column] | None = None) -> Column:
        matches = F.col(column)
        found = F.zip_with(
            places(t, pattern, matches),
            matches,
            lambda p, m: F.struct(p["a"].alias("a"), p["b"].alias("b"), m.alias("m")),
        )
        if good:
            found = F.filter(found, lambda x: good(x["m"]))
        return F.when(F.size(matches) > 0, spans_of(kind, rank, found)).otherwise(none)

    def long_value(match: Column) -> Column:
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_CHARS

    forms = [
        base("assign", 0, "_assign", ASSIGN, long_value),
        base("access", 1, "_access", LONG_ACCESS),
        base("hex", 2, "_hex", LONG_HEX),
    ]
    rows = rows.withColumn("base", F.array_sort(F.concat(*forms)))
    cut = lambda m: F.regexp_extract_all(masked(m), F.lit(f".{{1,{BLOCK}}}"), F.lit(0))
    for n, pattern, width, least in CLASSES:
        words = F.when(F.size(f"_{n}") > 0, F.transform(f"_{n}", cut))
        rows = rows.withColumn(f"_{n}", F.when(F.size(f"_{n}") > 0, blocks(places(t, pattern, F.col(f"_{n}")), words, width)))
        found = F.flatten(F.transform(f"_{n}", in_block(width, least)))
        rows = rows.withColumn(f"_{n}", found)
    others = [
        F.when(F.size(f"_{n}") > 0, spans_of(n, 3 + i, joined(F.col(f"_{n}")))).otherwise(none)
        for i, (n, *_) in enumerate(CLASSES)
    ]
    rows = rows.withColumn("_more", F.concat(*others))
    rows = rows.withColumn("spans", F.array_sort(F.concat("base", "_more")))
    return rows.select(*(F.col(f"_{i}_keep").alias(c) for i, c in enumerate(keep)), "base", "spans")


def written(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["a"].cast("string"), x["b"].cast("string"))), ","
    )


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")
