"""Similarity kernels, top-k and rank-of-truth over packed bits and dense vectors.

A bank is dealt into blocks; a task holds one block and lets the query blocks stream past it, so a
block's bytes reach Python once, whatever the number of queries, and what leaves the task is ``k``
rows (or two counts) per query and block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query rows of a block, and bank rows of a block.
BLOCK, SHARD = 1024, 8192
PACKED = "block int, ids binary, data binary, extra binary"


# ---------------------------------------------------------------- kernels: (queries, rows) -> similarities


def overlap(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Common bits of packed rows."""
    out = np.zeros((len(q), len(v)), np.int32)
    for w in range(q.shape[1]):
        out += np.bitwise_count(q[:, w, None] & v[None, :, w])
    return out


def _sizes(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(1, dtype=np.int64)


def bits_cosine(q, v):
    n = np.sqrt(_sizes(q).astype(float))[:, None] * np.sqrt(_sizes(v).astype(float))
    return np.where(n > 0, overlap(q, v) / np.maximum(n, 1e-12), 0.0)


def bits_jaccard(q, v):
    inter = overlap(q, v)
    return inter / np.maximum(_sizes(q)[:, None] + _sizes(v) - inter, 1)


def bits_tversky(q, v, alpha: float = 1.0, beta: float = 0.2):
    inter = overlap(q, v)
    return inter / np.maximum(inter + alpha * (_sizes(q)[:, None] - inter) + beta * (_sizes(v) - inter), 1e-9)


def bits_dot(q, v):
    """Binary dot product of rows whose entries are 1 / sqrt(nnz), back in whole bits."""
    return overlap(q, v).astype(float)


def dense_dot(q, v):
    return q @ v.T


def dense_cosine(q, v):
    norm = lambda x: np.sqrt((x * x).sum(1))
    return (q @ v.T) / np.maximum(norm(q)[:, None] * norm(v), 1e-12)


def dense_tanimoto(q, v):
    s = q @ v.T
    return s / np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1) - s, 1e-12)


def dense_tanimoto_clamped(q, v):
    """Real-valued Tanimoto of queries clamped at zero."""
    return dense_tanimoto(np.maximum(q, 0), v)


BITS = {"cosine": bits_cosine, "jaccard": bits_jaccard, "tversky": bits_tversky, "dot": bits_dot}
DENSE = {"cosine": dense_cosine, "tanimoto": dense_tanimoto, "tanimoto_clamped": dense_tanimoto_clamped, "dot": dense_dot}


# ---------------------------------------------------------------- blocks


def blocks(rows: DataFrame, n: int, id_col: str, value_col: str, extra_col: str | None = None) -> DataFrame:
    """(block, ids, data, extra): rows dealt by a hash of their id into ``n`` blocks of flat numbers.

    ``value_col`` is array<long> (packed bits) or numeric array (dense); all rows have one length.
    """
    kind = rows.schema[value_col].dataType.simpleString()
    whole = kind == "array<bigint>"
    value = F.col(value_col) if whole else F.col(value_col).cast("array<double>")
    picked = rows.select(F.col(id_col).cast("long").alias("id"), value.alias("v"), (F.col(extra_col).cast("double") if extra_col else F.lit(0.0)).alias("x"))
    schema = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("extra", pa.binary())])

    def pack(key, t):
        flat = pa.concat_arrays([c.flatten() for c in t.column("v").chunks]).to_numpy(zero_copy_only=False)
        row = {"block": key[0].as_py(), "ids": t.column("id").to_numpy().tobytes(), "data": flat.astype(np.uint64 if whole else np.float64).tobytes(), "extra": t.column("x").to_numpy().tobytes()}
        return pa.Table.from_pylist([row], schema)

    return picked.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b")).applyInArrow(pack, PACKED)


def past(bank: DataFrame, queries: DataFrame, step: Callable, schema: str, whole: bool, bank_blocks: int) -> DataFrame:
    """Every block of ``queries`` against every block of ``bank`` (both from ``blocks``): a stated query set, in blocks.

    ``step(query ids, queries, query extra, bank ids, bank rows, bank extra)`` gives a RecordBatch.
    """
    spark = bank.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = np.uint64 if whole else np.float64
    spread = F.explode(F.sequence(F.lit(0), F.lit(bank_blocks - 1)))
    both = bank.select("block", F.lit(0).alias("part"), "ids", "data", "extra").union(queries.select(spread.alias("block"), F.lit(1).alias("part"), "ids", "data", "extra"))

    def run(batches):
        held, own = None, None
        for b in batches:
            for i in range(b.num_rows):
                block, part = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                ids = np.frombuffer(b.column(2)[i].as_buffer(), np.int64)
                data = np.frombuffer(b.column(3)[i].as_buffer(), kind).reshape(len(ids), -1)
                extra = np.frombuffer(b.column(4)[i].as_buffer(), np.float64)
                if part == 0:
                    held, own = block, tuple(x.copy() for x in (ids, data, extra))
                elif block == held:  # a block without rows of its own meets nothing
                    yield step(ids, data, extra, *own)

    return both.repartition(parts, "block").sortWithinPartitions("block", "part").mapInArrow(run, schema)


def _counted(df: DataFrame, per: int) -> int:
    return max(1, -(-df.count() // per))


def scores(bank: DataFrame, queries: DataFrame, kernel: str, k: int, id_col: str, value_col: str, query_id: str | None = None, floor: float | None = None) -> DataFrame:
    """(qid, <id_col>, score): of each block the best ``k`` rows per query; ``floor`` drops scores at or below it."""
    whole = bank.schema[value_col].dataType.simpleString() == "array<bigint>"
    of = (BITS if whole else DENSE)[kernel]

    def step(qid, q, _, ids, v, __):
        s = of(q, v)
        n = min(k, len(ids))
        rough = np.round(s, 9)
        if n < len(ids):  # a cut by value that keeps all ties of the last place, then the exact order of what is left
            last = -np.partition(-rough, n - 1, axis=1)[:, n - 1 : n]
            near = rough >= last
        else:
            near = np.ones(s.shape, bool)
        row, col = np.nonzero(near)
        order = np.lexsort((ids[col], -rough[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < n
        if floor is not None:
            keep &= s[row, col] > floor
        row, col = row[keep], col[keep]
        return pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(ids[col]), pa.array(s[row, col].astype(float))], ["qid", id_col, "score"])

    n = _counted(bank, SHARD)
    b = blocks(bank, n, id_col, value_col)
    q = blocks(queries, _counted(queries, BLOCK), query_id or id_col, value_col)
    return past(b, q, step, f"qid long, `{id_col}` long, score double", whole, n)


def rank_counts(bank: DataFrame, queries: DataFrame, kernel: str, id_col: str, value_col: str, query_id: str, threshold: str) -> DataFrame:
    """(qid, n, at_least, above): how many rows score at or about the query's ``threshold``, and clearly above it.

    All rows count, those that share nothing with the query too; two counts leave a task per query and block.
    """
    whole = bank.schema[value_col].dataType.simpleString() == "array<bigint>"
    of = (BITS if whole else DENSE)[kernel]

    def step(qid, q, thr, ids, v, _):
        s, t = of(q, v), thr[:, None]
        close = np.abs(s - t) <= 1e-8 + 1e-5 * np.abs(t)
        return pa.RecordBatch.from_arrays([pa.array(qid), pa.array([len(ids)] * len(qid), pa.int64()), pa.array(((s >= t) | close).sum(1)), pa.array(((s > t) & ~close).sum(1))], ["qid", "n", "at_least", "above"])

    n = _counted(bank, SHARD)
    b = blocks(bank, n, id_col, value_col)
    q = blocks(queries, _counted(queries, BLOCK), query_id, value_col, threshold)
    found = past(b, q, step, "qid long, n long, at_least long, above long", whole, n)
    return found.groupBy("qid").agg(*[F.sum(c).alias(c) for c in ("n", "at_least", "above")])


# ---------------------------------------------------------------- columns


def cosine(inter: Column, nq: Column, nb: Column) -> Column:
    return F.when((nq > 0) & (nb > 0), inter / F.sqrt(nq * nb)).otherwise(0.0)


def jaccard(inter: Column, nq: Column, nb: Column) -> Column:
    return inter / F.greatest(nq + nb - inter, F.lit(1))


def common_bits(a: str, b: str) -> Column:
    """Common bits of two packed rows."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def top_k(scored: DataFrame, k: int = 10, group: str = "qid", key: str = "doc_id") -> DataFrame:
    """Adds ``rank`` from 1; ties to the smaller key.  The window's limit is pushed below its shuffle."""
    w = Window.partitionBy(group).orderBy(F.round("score", 9).desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def isclose(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def safe(x: Column) -> Column:
    """A similarity in [0, 1]: non-finite and under 1e-9 become 0."""
    x = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return F.when(x < 1e-9, 0.0).otherwise(x)


def _same_length(a: str, b: str, value: Column) -> Column:
    """``value`` of two arrays; null or empty ones score 0, a difference in length is an error."""
    either = F.coalesce(F.size(a), F.lit(-1)) <= 0
    return F.when(F.coalesce(F.size(a) != F.size(b), F.lit(False)), F.raise_error(F.lit("arrays differ in length")).cast("double")).when(either | F.col(b).isNull(), 0.0).otherwise(value)


def safe_cosine(a: str, b: str) -> Column:
    """Cosine clamped to [0, 1]."""
    return _same_length(a, b, safe(F.try_divide(dot(a, b), norm(a) * norm(b))))


def safe_tanimoto(a: str, b: str) -> Column:
    """Generalised Tanimoto clamped to [0, 1]."""
    return _same_length(a, b, safe(F.try_divide(dot(a, b), dot(a, a) + dot(b, b) - dot(a, b))))
