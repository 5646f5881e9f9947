"""Per-group Python with bounded memory and little overhead for many small groups."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, keys: list[str], order: list[str], schema: str, fn: Callable) -> DataFrame:
    """Run ``fn`` on each group's columns as NumPy arrays, in ``order``.

    Rows are shuffled by key and sorted by Spark; a task then streams Arrow batches
    and holds one group at a time.  Compared with applyInPandas no pandas frame is
    built per group.  ``fn`` takes a dict of arrays and returns a dict of equally
    long arrays; a scalar stands for a constant column.  Groups must be bounded.
    """
    columns = df.columns

    def run(batches):
        waiting: list[dict] = []  # pieces of the group that may go on in the next batch

        def close() -> dict:
            piece = waiting[0] if len(waiting) == 1 else {c: np.concatenate([w[c] for w in waiting]) for c in columns}
            waiting.clear()
            return fn(piece)

        def frame(results: list[dict]) -> pd.DataFrame:
            out: dict = {}
            sizes = [max(len(v) for v in r.values() if isinstance(v, np.ndarray)) for r in results]
            for name in results[0]:
                out[name] = np.concatenate(
                    [r[name] if isinstance(r[name], np.ndarray) else np.repeat(r[name], n) for r, n in zip(results, sizes)]
                )
            return pd.DataFrame(out)

        for batch in batches:
            arrays = {c: batch[c].to_numpy() for c in columns}
            size = len(batch)
            if not size:
                continue
            changed = np.zeros(size - 1, dtype=bool)
            for k in keys:
                changed |= arrays[k][1:] != arrays[k][:-1]
            starts = [0, *(np.flatnonzero(changed) + 1).tolist(), size]
            done = []
            for begin, end in zip(starts, starts[1:]):
                piece = {c: a[begin:end] for c, a in arrays.items()}
                if waiting and any(waiting[0][k][0] != piece[k][0] for k in keys):
                    done.append(close())
                waiting.append(piece)
            if done:
                yield frame(done)
        if waiting:
            yield frame([close()])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def each_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of one group after another, of batches that are sorted by ``keys``; holds one group at a time."""
    waiting: list[dict] = []

    def joined() -> dict[str, np.ndarray]:
        piece = waiting[0] if len(waiting) == 1 else {c: np.concatenate([w[c] for w in waiting]) for c in waiting[0]}
        waiting.clear()
        return piece

    for batch in batches:
        arrays = {c: batch[c].to_numpy() for c in batch.columns}
        if not len(batch):
            continue
        changed = np.zeros(len(batch) - 1, dtype=bool)
        for k in keys:
            changed |= arrays[k][1:] != arrays[k][:-1]
        starts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(batch)]
        for begin, end in zip(starts, starts[1:]):
            piece = {c: a[begin:end] for c, a in arrays.items()}
            if waiting and any(waiting[0][k][0] != piece[k][0] for k in keys):
                yield joined()
            waiting.append(piece)
    if waiting:
        yield joined()
