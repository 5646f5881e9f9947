"""Quality classifier by co-training.

Two classifiers see different sides of a document: the text view its words, the page view its source, language,
length and layout.  They are fitted on labelled rows; then, over rounds, each view labels all other documents that it
is sure about, and these train the other view.  Sureness is measured after calibration on labelled rows that no view
is fitted on.  At the end both calibrated views are combined, and all documents scored.

There are two targets, good quality and toxicity; a document's score is the chance that it is good and not toxic.

Bounds: ``LABELLED`` labelled rows are taken, those with the smallest hash of their id; their features (hashed, so
bounded by their words) are fitted on the driver.  The unlabelled part has no bound: in each round Spark scores every
other document and sums, for each feature and class, the documents that teach it; the driver gets these sums only,
whose size does not depend on the input.  Features that few labelled rows have weigh as the others do on average.

Defined results: null texts are empty and null metadata is a value like any other; labelled rows with a null label
teach nothing for that target; an id labelled twice counts twice; a target without labels is taken as good quality
and as not toxic.  Every row gives one row, rows without id included; they teach as unlabelled ones do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import release, schema_of, short_batches, slices, stored, summed

#: Labelled rows to fit on (every fifth of them calibrates).
LABELLED = 8_000
ROUNDS = 2
#: A view teaches the other one where its calibrated chance is this far from even.
SURE = 0.98
#: Words whose features a task remembers; bounds memory, not results.
REMEMBERED = 200_000
#: Size of the hashed feature spaces.
WIDTH = 1 << 18
#: A feature counts if this many fitted rows have it.
SUPPORT = 3
#: Rows of the average mix that each feature is taken to have besides its own.
SMOOTH = 10.0
STEPS, PENALTY = 60, 1e-3
TARGETS = ("quality", "toxic")

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 sign, 5 space, 6 line end
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_KIND[[9, 11, 12, 13, 32]] = 5
_KIND[10] = 6


def slot(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode()) % WIDTH


class Words(dict):
    """Features of a word: its letters in lower case, its run of signs, capitals."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        signs = word[len(core) + word.find(core) :] if core else word
        found = [slot("w " + core.lower())] if core else []
        if len(signs) > 1 or not core:
            found.append(slot("s " + signs[:8]))
        if len(core) > 1 and core.isupper():
            found.append(slot("capitals"))
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = tuple(found)
        return self[word]


def text_view(text: str, words: Words) -> np.ndarray:
    tokens = text.split()
    kinds = set(tokens)
    share = int(10 * len(kinds) / len(tokens)) if tokens else 11
    size = min(int(np.log2(len(tokens) + 1)), 12)
    return np.unique(np.fromiter(chain([slot(f"repeats {size} {share}")], *map(words.__getitem__, kinds)), np.int32))


def page_view(text: str, facts: list) -> np.ndarray:
    """Source, language and the like as they are; length and layout in steps."""
    n = np.bincount(_KIND[np.frombuffer(text.encode(), np.uint8)], minlength=7)
    total = max(1, int(n.sum()))
    letters = max(1, int(n[0] + n[1] + n[2]))
    step = lambda x: int(np.log2(x * 1000 + 1))
    found = [f"{i} {x}" for i, x in enumerate(facts)]
    layout = [n[2] / letters, n[3] / total, n[4] / total, n[6] / total, (n[5] + n[6]) / total]
    found += [f"layout {i} {step(x)}" for i, x in enumerate(layout)]
    found.append(f"size {int(np.log2(total) * 2)}")
    return np.unique(np.array([slot(x) for x in found], np.int32))


class Rows:
    """Sparse rows of present features."""

    def __init__(self, features: list[np.ndarray]):
        self.n = len(features)
        self.features = np.concatenate([*features, np.zeros(0, np.int32)])
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in features])

    def logit(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.features], minlength=self.n) + weights[WIDTH]


def chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(rows: Rows, target: np.ndarray, taught: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Logistic regression over the rows in ``taught``; the last weight is the constant.

    A feature weighs in by the log ratio of its shares among both classes, smoothed towards none, so that rare
    features say little unless they are very one-sided.  The shares count the rows in ``taught`` and those of
    ``more``: for each class the documents with each feature, and the documents.  The steps are accelerated gradient
    descent; features that fewer than ``SUPPORT`` rows of ``taught`` have get the mean weight of the others.
    """
    on = taught[rows.row]
    features, row = rows.features[on], rows.row[on]
    own = np.bincount(features, minlength=WIDTH)
    n_all = max(1, int(taught.sum() + more[:, WIDTH].sum()))
    share = float(np.clip((target[taught].sum() + more[1, WIDTH]) / n_all, 0.5 / n_all, 1 - 0.5 / n_all))
    yes = np.bincount(features, target[row], minlength=WIDTH) + more[1, :WIDTH]
    no = own + more[0, :WIDTH] + more[1, :WIDTH] - yes
    ratios = np.log((yes + SMOOTH * share) / share) - np.log((no + SMOOTH * (1 - share)) / (1 - share))
    ratios[yes + no < SUPPORT] = 0.0
    used = np.flatnonzero(own >= SUPPORT)
    place = np.full(WIDTH, -1, np.int32)
    place[used] = np.arange(len(used))
    features = place[features]
    kept = features >= 0
    features, row, n = features[kept], row[kept], max(1, int(taught.sum()))
    ratio = ratios[used]
    own_share = float(np.clip(target[taught].mean(), 0.5 / n, 1 - 0.5 / n)) if taught.any() else 0.5
    values = ratio.astype(np.float32)[features]

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, w[features] * values, minlength=rows.n)

    def back(e: np.ndarray) -> np.ndarray:
        return np.bincount(features, e[row] * values, minlength=len(used)) / n

    w = np.ones(len(used))
    size = 1.0
    for _ in range(6):  # the largest curvature, by power iteration
        w = back(forward(w))
        size = float(np.linalg.norm(w)) or 1.0
        w /= size
    rate = 1 / (0.25 * size * 1.1 + PENALTY)
    w, look, constant, pace = np.zeros(len(used)), np.zeros(len(used)), float(np.log(own_share / (1 - own_share))), 1.0
    for _ in range(STEPS):
        error = np.where(taught, chance(forward(look) + constant) - target, 0.0)
        after = look - rate * (back(error) + PENALTY * look)
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        look, w, pace = after + (pace - 1) / faster * (after - w), after, faster
        constant -= error.sum() / n
    out = np.zeros(WIDTH + 1)
    out[:WIDTH] = ratios * (np.average(w, weights=own[used]) if len(used) else 0.0)
    out[used], out[WIDTH] = w * ratio, constant
    return out


def calibrate(logits: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Factors and constant that turn logits of held-out rows into log odds (Platt), by Newton steps."""
    x = np.stack([*logits, np.ones(len(target))], axis=1)
    prior = np.array([*[1.0 / len(logits)] * len(logits), 0.0])
    b = prior.copy()
    for _ in range(25):
        p = chance(x @ b)
        slope = x.T @ (p - target) + 1e-2 * (b - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        b -= np.clip(np.linalg.solve(curve, slope), -2, 2)
    return b


def learn(views: list[Rows], labels: np.ndarray, more: np.ndarray) -> dict:
    """Weights of both views and of their combination, for one target.

    ``labels`` is 0, 1 or -1 for none; ``more`` has for each view what ``fit`` takes.
    """
    known = np.flatnonzero(labels >= 0)
    held = np.zeros(len(labels), bool)
    held[known[::5]] = True
    target, taught = np.where(labels > 0, 1.0, 0.0), (labels >= 0) & ~held
    models = [fit(view, target, taught, own).astype(np.float32) for view, own in zip(views, more, strict=True)]
    logits = [view.logit(model) for view, model in zip(views, models, strict=True)]
    scales = [calibrate([logit[held]], labels[held]) for logit in logits]
    calibrated = [logit * scale[0] + scale[1] for logit, scale in zip(logits, scales, strict=True)]
    joint = calibrate([x[held] for x in calibrated], labels[held])
    return {"models": models, "scales": scales, "joint": joint}


def lessons(others: DataFrame, models: list[dict | None]) -> np.ndarray:
    """What the documents teach that the views are sure about: for each target, taught view and class the documents
    with each feature, and the documents."""
    shared, shape = others.sparkSession.sparkContext.broadcast(models), (len(models), 2, 2, WIDTH + 1)

    def step(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(shape, np.uint32)
        for batch in batches:
            views = [Rows([np.frombuffer(x, np.int32) for x in column.to_pylist()]) for column in batch.columns]
            for target, model in enumerate(shared.value):
                if model is None:
                    continue
                for i, view in enumerate(views):
                    scale, other = model["scales"][i], views[1 - i]
                    p = chance(view.logit(model["models"][i]) * scale[0] + scale[1])
                    for kind, sure in enumerate((p <= 1 - SURE, p >= SURE)):
                        counts = out[target, 1 - i, kind]
                        counts[:WIDTH] += np.bincount(other.features[sure[other.row]], minlength=WIDTH).astype(np.uint32)
                        counts[WIDTH] += int(sure.sum())
        return out.ravel()

    return summed(others.select("text_view", "page_view"), int(np.prod(shape)), step).reshape(shape)


def views_of(batch: pa.RecordBatch, facts: int, words: Words) -> list[list[np.ndarray]]:
    """Both views of the texts in column 0; the facts follow it."""
    texts = [x or "" for x in batch.column(0).to_pylist()]
    given = list(zip(*(batch.column(1 + i).to_pylist() for i in range(facts)), strict=True))
    pages = [page_view(x, given[i] if facts else []) for i, x in enumerate(texts)]
    return [[text_view(x, words) for x in texts], pages]


def with_text(df: DataFrame, facts: list[str], keep: list[str], text: str) -> DataFrame:
    short_batches(df.sparkSession)
    return df.select(F.col(text).alias("_text"), *(F.col(c).cast("string").alias(f"_{c}") for c in facts), *keep)


def features_of(df: DataFrame, facts: list[str], keep: list[str], text: str) -> DataFrame:
    """Columns ``keep`` and the features of both views, as packed numbers."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches, "_text"):
            views = views_of(batch, len(facts), words)
            columns = [*batch.columns[1 + len(facts) :], *(pa.array([x.tobytes() for x in v], pa.binary()) for v in views)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text_view", "page_view"])

    rows = with_text(df, facts, keep, text)
    return rows.mapInArrow(step, schema_of(df, keep, "text_view binary, page_view binary"))


def train(docs: DataFrame, labels: DataFrame, facts: list[str], key: str, text: str) -> list[dict | None]:
    """The models of both targets, from a bounded sample of labelled rows and all other rows."""
    order = F.xxhash64(key), F.col(key)
    labelled = labels.where(F.col(key).isNotNull()).select(key, *TARGETS)
    taken = labelled.join(docs.select(key).distinct(), key, "left_semi").orderBy(*order, *TARGETS).limit(LABELLED)
    # at most LABELLED rows of three numbers
    taken = stored(taken, "quality-labels")
    chosen = docs.join(F.broadcast(taken), key).select(key, text, *facts, *TARGETS)
    rows = features_of(chosen, facts, [key, *TARGETS], text).toArrow().to_pylist()
    rows.sort(key=lambda r: (r[key], xxhash.xxh64_intdigest(r["text_view"]), str([r[t] for t in TARGETS])))
    views = [Rows([np.frombuffer(r[v], np.int32) for r in rows]) for v in ("text_view", "page_view")]
    known = {t: [-1 if r[t] is None else int(r[t] > 0) for r in rows] for t in TARGETS}
    del rows
    marks = [np.array(known[t], np.int64) for t in TARGETS]
    if not any((m >= 0).any() for m in marks):
        return [None] * len(TARGETS)
    others = docs.join(F.broadcast(taken.select(key).distinct()), key, "left_anti")
    others = stored(features_of(others, facts, [], text), "quality-features")
    more = np.zeros((len(TARGETS), 2, 2, WIDTH + 1), np.int64)
    for step in range(ROUNDS + 1):
        models = [learn(views, m, own) if (m >= 0).any() else None for m, own in zip(marks, more, strict=True)]
        if step < ROUNDS:
            more = lessons(others, models)
    return models


def score_documents(
    docs: DataFrame, labels: DataFrame, keep: list[str], facts: list[str] = ("lang", "source"), key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Columns ``keep`` of every row with ``text_score``, ``page_score`` (chance of good quality by each view),
    ``toxic_score`` and ``score``, the chance that it is good and not toxic."""
    facts = list(facts)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, facts, key, text))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, words = shared.value, Words()
        for batch in slices(batches, "_text"):
            views = [Rows(v) for v in views_of(batch, len(facts), words)]
            scores = []
            for default, model in zip((1.0, 0.0), models, strict=True):
                if model is None:
                    scores.append([np.full(batch.num_rows, default)] * 3)
                    continue
                parts = zip(views, model["models"], model["scales"], strict=True)
                odds = [view.logit(m) * scale[0] + scale[1] for view, m, scale in parts]
                joint = model["joint"]
                both = odds[0] * joint[0] + odds[1] * joint[1] + joint[2]
                scores.append([chance(x) for x in (*odds, both)])
            (text_score, page_score, good), (_, _, toxic) = scores
            out = [text_score, page_score, toxic, good * (1 - toxic)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1 + len(facts) :], *(pa.array(x.astype(np.float64)) for x in out)], names=[*keep, *names]
            )
        words.clear()
        release()

    names = ["text_score", "page_score", "toxic_score", "score"]
    rows = with_text(docs, facts, keep, text)
    return rows.mapInArrow(step, schema_of(docs, keep, ", ".join(f"{n} double" for n in names)))
