"""Feature vocabularies: multisets of parts -> cumulative features -> entropy-ranked columns -> packed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = "[a-z]{3,}"
WIDTH = 1024
#: Ids of at most this many rows (some tens of MB) are broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, token): every occurrence."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).alias("token"))


def run_lengths(sorted_values: Column) -> Column:
    """array<struct<token, n>> of a sorted array, by its runs; linear in its length."""

    def of(s: Column) -> Column:
        size = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), size), lambda i: (i == 0) | (i == size) | (s[i] != s[i - 1]))  # and the end
        runs = lambda st: F.transform(F.slice(st, F.lit(1), F.size(st) - 1), lambda i, j: F.struct(s[i].alias("token"), (st[j + 1] - i).cast("long").alias("n")))
        return F.transform(F.array(starts), runs)[0]

    return F.transform(F.array(sorted_values), lambda s: F.when(F.size(s) > 0, of(s)).otherwise(F.array().cast("array<struct<token:string,n:bigint>>")))[0]


def multiset(docs: DataFrame) -> DataFrame:
    """(doc_id, token, n), one document per row: counted inside the row, without a shuffle."""
    found = F.array_sort(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)))
    return docs.select("doc_id", F.explode(run_lengths(found)).alias("r")).select("doc_id", "r.token", "r.n")


def split_by_id(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose id no other row has, the other rows or None): only ids are shuffled, texts too if very many ids occur again."""
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_again"))
    n = again.count()
    if not n:
        return docs, None
    side, same = F.broadcast(again) if n <= BROADCAST_ROWS else again, F.col("doc_id").eqNullSafe(F.col("_again"))
    return docs.join(side, same, "left_anti"), docs.join(side, same, "left_semi")


def unique_occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, token, n): in how many distinct lines of an id's texts the token occurs.

    An id with one row is counted inside the row, without a shuffle; of the others each line is shuffled once.
    """
    one, rest = split_by_id(docs.select("doc_id", F.split(F.lower("text"), "\n").alias("lines")))
    found = lambda line: F.array_distinct(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)))
    tokens_of = F.array_sort(F.flatten(F.transform(F.array_distinct("lines"), found)))
    out = one.select("doc_id", F.explode(run_lengths(tokens_of)).alias("r")).select("doc_id", "r.token", "r.n")
    if rest is None:
        return out
    lines = rest.select("doc_id", F.explode("lines").alias("line")).distinct()
    return out.union(lines.select("doc_id", F.explode(found(F.col("line"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n")))


def thermometer(counts: DataFrame, cap: int | None = 5) -> DataFrame:
    """(doc_id, token, k): one feature for each level 1..min(n, cap)."""
    top = F.least("n", F.lit(cap)) if cap else F.col("n")
    return counts.select("doc_id", "token", F.explode(F.sequence(F.lit(1), top.cast("int"))).alias("k"))


def entropy(p: Column) -> Column:
    """Binary entropy in bits, p clipped away from 0 and 1."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return -(p * F.log2(p) + (1 - p) * F.log2(1 - p))


def vocabulary(features: DataFrame, n: int, size: int = WIDTH) -> DataFrame:
    """(token, k, df, h, col): the ``size`` features of highest entropy; ties by (token, k).

    The top rows are found by a distributed limit, so that only ``size`` rows are numbered.
    """
    df = features.groupBy("token", "k").agg(F.count(F.lit(1)).alias("df"))
    ranked = df.withColumn("h", entropy(F.col("df") / F.lit(n)))
    order = (F.round("h", 9).desc(), F.col("token"), F.col("k"))
    return ranked.orderBy(*order).limit(size).withColumn("col", F.row_number().over(Window.orderBy(*order)) - 1)


def bank(features: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, col) postings; features outside the vocabulary (of bounded size) fall away."""
    return features.join(F.broadcast(vocab.select("token", "k", "col")), ["token", "k"]).select("doc_id", "col")


def packed(ids: DataFrame, postings: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, bits array<long>, nnz long): a row of ``width`` bits for every id, empty rows included.

    A row's columns meet in its own task before the one shuffle, which moves a packed row per document.
    """
    rows = ids.select("doc_id", F.lit(None).cast("int").alias("col")).union(postings.select("doc_id", F.col("col").cast("int")))
    words = [F.coalesce(F.bit_or(F.when(F.expr(f"shiftright(col, 6) = {w}"), F.expr("shiftleft(1L, col & 63)"))), F.lit(0).cast("long")).alias(f"w{w}") for w in range(-(-width // 64))]
    out = rows.groupBy("doc_id").agg(*words).select("doc_id", F.array(*[f"w{w}" for w in range(len(words))]).alias("bits"))
    return out.withColumn("nnz", F.aggregate("bits", F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x)))


def columns_of(bits: str) -> Column:
    """The set columns of a packed row, ascending."""
    return F.flatten(F.transform(bits, lambda x, w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(x, i) == 1), lambda i: (w * 64 + i).cast("int"))))


def postings_of(rows: DataFrame) -> DataFrame:
    """(doc_id, col) of packed rows."""
    return rows.select("doc_id", F.explode(columns_of("bits")).alias("col"))


def row_sizes(ids: DataFrame, postings: DataFrame) -> DataFrame:
    """(doc_id, nnz) with empty rows kept."""
    counted = postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nnz"))
    return ids.select("doc_id").join(counted, "doc_id", "left").select("doc_id", F.coalesce("nnz", F.lit(0)).alias("nnz"))
