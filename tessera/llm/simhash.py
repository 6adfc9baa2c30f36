"""Operator 10 — SimHash near-duplicate groups through pigeonhole blocks.

``fingerprints`` turns each whole text into 64 majority bits over the XXH64 values of its word
shingles.  ``groups`` links fingerprints at Hamming distance ``max_bits`` or less and labels each
document with the smallest id that it can reach.

Finding the links: the 64 bits are cut into m blocks.  Fingerprints that differ in at most d bits
agree on at least m - d blocks, so both have the same value under one of the C(m, m-d) masks.  Masks
are the join keys.  m grows with the number of *distinct* fingerprints so that chance company per
key stays about constant; every m is exact.  Keys with many members are dealt out as pairs of
chunks of at most ``CHUNK`` fingerprints; a task compares one pair of chunks and returns a spanning
forest of its links, so neither memory nor output grows with the square of a group.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows
share their fingerprint and are reported once each; a null id takes part and is never the smallest
(a component of only null ids has a null id); further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, connected_components, forest, shuffle_partitions, texts_of, tidy

CHUNK = 1024
#: Chance partners per fingerprint that the choice of m allows.
CHANCE = 2.0
#: Rows (some 16 bytes each) up to which the documents to drop are broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000


def fingerprint(text: bytes, width: int = 4) -> bytes:
    """The 8 bytes, high bit first, of one text's fingerprint."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return bytes(8)
    joined = b" ".join(words)
    if n <= width:
        digests = xxhash.xxh64_digest(joined, 42)
        return digests
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = ends - np.fromiter(map(len, words), np.int64, n)
    digest = xxhash.xxh64_digest
    spans = zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())
    raw = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in spans]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for s in range(0, len(raw), 1 << 15):
        counts += np.unpackbits(raw[s : s + (1 << 15)], axis=1).sum(0, dtype=np.int32)
    return np.packbits(counts * 2 > len(raw)).tobytes()


def _fingerprints(batches):
    for b in batches:
        raw = b"".join([fingerprint(t) for t in texts_of(b.column(1))])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64)), *b.columns[2:]], ["id", "fp", *b.schema.names[2:]])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[Column] | None = None) -> DataFrame:
    """(id long, fp long, extra longs): one row for each row of ``df``."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(extra or []))
    return rows.mapInArrow(tidy(_fingerprints), ", ".join(["id long", "fp long", *(f"{c} long" for c in rows.columns[2:])]))


def block_masks(m: int, max_bits: int) -> list[int]:
    """For each choice of m - max_bits of m blocks, the signed 64-bit mask that keeps them."""
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(m)]
    masks = [sum(c) for c in combinations(blocks, m - max_bits)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def plan_blocks(n: int, max_bits: int) -> int:
    """The fewest blocks at which a random fingerprint meets at most ``CHANCE`` others by accident."""
    for m in range(max_bits + 1, max_bits + 9):
        if n * comb(m, max_bits) / 2 ** (64 * (m - max_bits) / m) <= CHANCE:
            break
    return m


def _linked(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """For each fingerprint the index of the first one in its component within this group."""
    fp = fp.view(np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= max_bits
    label = np.arange(len(fp), dtype=np.int32)
    while True:
        new = np.where(near, label[None, :], len(fp)).min(1).astype(np.int32)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links(max_bits: int):
    def run(batches):
        # rows are sorted by group; the last group of a batch may go on in the next
        left_g, left_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def done(g, f):
            us, vs = [], []
            if len(g):
                starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                sizes = np.diff(np.r_[starts, len(g)])
                small = np.repeat(sizes <= 32, sizes)
                lag = 1
                while True:  # all pairs of the small groups, one distance in the order at a time
                    same = (g[lag:] == g[:-lag]) & small[lag:]
                    at = np.flatnonzero(same)
                    if not len(at):
                        break
                    a, b = f[at], f[at + lag]
                    ok = np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits
                    us.append(a[ok])
                    vs.append(b[ok])
                    lag += 1
                for s, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
                    own = f[s : s + n]
                    label = _linked(own, max_bits)
                    moved = label != np.arange(n)
                    us.append(own[label[moved]])
                    vs.append(own[moved])
            u = np.concatenate(us) if us else np.empty(0, np.int64)
            v = np.concatenate(vs) if vs else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            g = np.concatenate([left_g, b.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([left_f, b.column(1).to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(g, g[-1])) if len(g) else 0
            left_g, left_f = g[cut:], f[cut:]
            yield done(g[:cut], f[:cut])
        yield done(left_g, left_f)

    return run


def links(distinct: DataFrame, n: int, max_bits: int = 4, chunk: int = CHUNK) -> DataFrame:
    """(u long, v long): stars that connect exactly what Hamming distance ``max_bits`` connects.

    ``distinct`` has distinct values in ``fp``; ``n`` is about their number.
    """
    masks = block_masks(plan_blocks(n, max_bits), max_bits)
    parts = shuffle_partitions(distinct.sparkSession)
    keys: list[Column] = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(x))) for i, x in enumerate(masks)]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = keyed.join(sizes, "key").select("fp", "key", F.ceil(F.col("size") / F.lit(chunk)).cast("int").alias("k"))
    met = met.withColumn("c", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("k")).cast("int"))
    met = met.select("fp", "key", "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    group = F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("g")
    return met.select(group, "fp").repartition(parts, "g").sortWithinPartitions("g").mapInArrow(tidy(lambda batches: forest(_links(max_bits)(batches))), "u long, v long")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4) -> DataFrame:
    """(id long, fp long, component long): one row for each row of ``df``."""
    scratch = Scratch(df.sparkSession, "simhash")
    marked = scratch.save(fingerprints(df, id_col, text_col), "marked")
    distinct = scratch.save(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    n = distinct.count()
    roots = connected_components(links(distinct, n, max_bits), scratch, stars=True)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.save(rooted, "rooted")
    least = scratch.save(rooted.groupBy("root").agg(F.min("least").alias("component")), "least")
    named = scratch.save(rooted.join(least, "root").select("fp", "component"), "named")
    return marked.join(named, "fp").select("id", "fp", "component")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4) -> DataFrame:
    """``df`` with one row of each group: the first in order of (id, hash of text); nulls come first."""
    scratch = Scratch(df.sparkSession, "one-of-each")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = scratch.save(fingerprints(df, id_col, text_col, extra=[F.xxhash64(text).alias("h")]), "marked")
    distinct = scratch.save(marked.select("fp").distinct(), "distinct")
    roots = connected_components(links(distinct, distinct.count(), max_bits), scratch, stars=True)
    roots = scratch.save(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots-of-all")
    rooted = scratch.save(marked.join(roots, "fp").groupBy("root", "id", "h").agg(F.count(F.lit(1)).alias("n")), "rooted")
    first = scratch.save(rooted.groupBy("root").agg(F.min(F.struct("id", "h")).alias("first")), "first")
    told = rooted.join(first, "root").select("id", "h", "n", F.struct("id", "h").eqNullSafe(F.col("first")).alias("stays"))
    odd = scratch.save(told.where("NOT stays OR n > 1").select(F.col("id").alias("_i"), F.col("h").alias("_h"), "stays"), "odd")
    n_odd, repeated = odd.count(), odd.where("stays").limit(1).count()
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])  # whatever the columns are called
    keyed = df.select(row.alias("row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_key"))
    on = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_h"))
    side = F.broadcast(odd) if n_odd <= BROADCAST_ROWS else odd
    out = keyed.join(side, on, "left_anti")
    if repeated:  # rows equal in id and text, of which one stays
        stays = odd.where("stays")
        out = out.unionByName(keyed.join(F.broadcast(stays) if n_odd <= BROADCAST_ROWS else stays, on, "left_semi").dropDuplicates(["_id", "_key"]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = groups(docs.select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
