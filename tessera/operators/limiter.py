"""Fixed windows anchored at the first hit of a key: a fold over a key's ordered hits, state carried from batch to batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fold(period: int, limit: int):
    def run(batches):
        # the key being read, the start of its open window and the hits in it, and what its closed windows gave
        key, start, held, done = None, None, 0, np.zeros(3, np.int64)

        def closed() -> np.ndarray:
            ok = min(max(limit, 1), held)
            return np.array([ok, held - ok, 1]) if start is not None else np.zeros(3, np.int64)

        def flush(out):
            if key is not None:
                out.append((key, *(done + closed()).tolist()))

        for b in batches:
            keys, at, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            out, edges = [], np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            for s, e in zip(edges, [*edges[1:], len(keys)]):
                if keys[s] != key:
                    flush(out)
                    key, start, held, done = keys[s].item(), None, 0, np.zeros(3, np.int64)
                t, sums = at[s:e], np.r_[0, np.cumsum(n[s:e])]
                i = 0
                while i < len(t):  # a step a window, not a step a hit
                    if start is None or t[i] - start >= period:
                        done = done + closed()
                        start, held = int(t[i]), 0
                    j = int(np.searchsorted(t, start + period))
                    held += int(sums[j] - sums[i])
                    i = j
            yield _batch(out)
        out = []
        flush(out)
        yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "allowed", "rejected", "windows"])


def limited(hits: DataFrame, key: str, at: str, period: int, limit: int) -> DataFrame:
    """(key, allowed, rejected, windows): a hit opens a window of ``period`` when none is open; at most
    ``limit`` hits pass in one, and rejected hits don't count.

    Hits of one key and time are counted before the shuffle; a task then folds its keys in time order with five
    numbers of state, however long a key's history is.  Null keys and times are left out.
    """
    counted = hits.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).cast("long").alias("key"), F.col(at).cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    sorted_ = counted.repartition("key").sortWithinPartitions("key", "at")
    return sorted_.mapInArrow(_fold(period, limit), "key long, allowed long, rejected long, windows long").withColumnRenamed("key", key)
