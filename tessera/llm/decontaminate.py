"""Operator 5 — benchmark decontamination by containment, in DataFrame functions only.

Which documents hold most of a short benchmark item?  With Q the set of an item's word shingles and
X a document's, the test is |Q & X| >= t |Q|.  Plain Jaccard banding can't find it: a 30-shingle item
inside a document of thousands has a Jaccard similarity near 0.01.  So the *items* carry the sketch
and the documents are probed whole:

* items are partitioned by size, and an item of s shingles gets a bottom-k MinHash signature, the
  k = s - ceil(t s) + 1 smallest hashes of Q.  A document with t of Q's shingles misses at most
  s - ceil(t s) of them, so it holds at least one value of the signature: no item is lost.  k is
  fixed by the size, about a fifth of it; each size class is probed only by documents with enough
  shingles to hold t of its smallest item;
* each document's shingle hashes meet the signatures in an equi-join (broadcast only if the counted
  signatures are few), giving candidate pairs;
* candidates are verified on the shingle *strings*: exact containment, with ties and hash
  collisions settled there.

Words are maximal runs of letters and digits of the lower-cased text.  Shingles take five words; an
item of fewer words is one shingle of all of them and is looked for among shingles of that width.

Defined results: null or empty texts, and items without words, match nothing; a null id is an id
like any other (compared null-safe); repeated rows with one id are one document whose pair reports
the largest containment; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

WIDTH = 5
THRESHOLD = 0.8
#: Signatures, item sets and candidates of at most this many rows (some 32 MB) are broadcast; more are shuffled.
BROADCAST_ROWS = 500_000


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once a row, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def words_of(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(words: Column, width) -> Column:
    """First positions, from 1, of the shingles of ``width`` words; no shingle: an empty array."""
    return F.slice(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(0)))


def _hashes(words: Column, width: int) -> Column:
    return F.transform(_starts(words, width), lambda i: F.xxhash64(F.slice(words, i, F.lit(width))))


def probes(docs: DataFrame, text: str, widths: list[int]) -> DataFrame:
    """(doc_id, width, n, h): every shingle's hash for each width, with how many shingles of that width the text has; one reading of the corpus."""
    if len(widths) == 1:
        p = docs.select("doc_id", bound(words_of(text), lambda w: _hashes(w, widths[0])).alias("hs"))
        return p.select("doc_id", F.lit(widths[0]).alias("width"), F.size("hs").alias("n"), F.explode("hs").alias("h"))

    def of(words: Column, width: int) -> Column:
        return bound(_hashes(words, width), lambda hs: F.transform(hs, lambda h: F.struct(F.lit(width).alias("width"), F.size(hs).alias("n"), h.alias("h"))))

    every = bound(words_of(text), lambda w: F.concat(*[of(w, k) for k in widths]))
    return docs.select("doc_id", F.explode(every).alias("p")).select("doc_id", "p.*")


def shingles(text: str, width: Column) -> Column:
    """Distinct shingle strings of ``width`` words."""
    return bound(words_of(text), lambda w: F.array_distinct(F.transform(_starts(w, width), lambda i: F.array_join(F.slice(w, i, width), " "))))


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, n_shingles int, n_common int, containment double) for pairs at ``threshold`` or more."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    i = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("t"))
    i = i.withColumn("width", F.least(F.size(words_of("t")), F.lit(width))).where("width > 0")
    i = i.select("item_id", "width", shingles("t", F.col("width")).alias("q")).withColumn("s", F.size("q"))
    need = F.ceil(F.col("s") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    i = scratch.save(i.withColumn("need", F.greatest(need, F.lit(1))), "items")

    # signatures: the s - need + 1 smallest hashes; size classes are powers of two
    hashed = F.array_sort(F.array_distinct(F.transform("q", lambda x: F.xxhash64(F.split(x, " ")))))
    sig = i.select("item_id", "width", "need", F.floor(F.log2("s")).cast("int").alias("class"), F.explode(F.slice(hashed, F.lit(1), F.col("s") - F.col("need") + 1)).alias("h"))
    least = sig.groupBy("class").agg(F.min("need").alias("least"))
    sig = scratch.save(sig.join(F.broadcast(least), "class").select("item_id", "width", "least", "h"), "signatures")
    n_sig, n_items = sig.count(), i.count()
    widths = [r[0] for r in sig.select("width").distinct().collect()]  # at most ``width`` values

    if not widths:
        kinds = [docs.schema[id_col].dataType, items.schema[item_col].dataType, "int", "int", "double"]
        names = ["doc_id", "item_id", "n_shingles", "n_common", "containment"]
        return d.select(*[F.lit(None).cast(k).alias(n) for k, n in zip(kinds, names)]).where(F.lit(False))
    found = probes(d, "t", sorted(widths)).join(_maybe_broadcast(sig, n_sig), ["h", "width"]).where("n >= least").select("doc_id", "item_id")
    found = scratch.save(found.distinct(), "candidates")
    n_found = found.count()

    # verify on strings
    asked = found.withColumnRenamed("doc_id", "id")
    near = d.join(_maybe_broadcast(asked, n_found), F.col("doc_id").eqNullSafe(F.col("id"))).join(_maybe_broadcast(i, n_items * 64), "item_id")
    common = F.size(F.array_intersect("q", shingles("t", F.col("width"))))
    near = near.groupBy("doc_id", "item_id").agg(F.max(common).alias("n_common"), F.max("s").alias("n_shingles"), F.max("need").alias("need")).where("n_common >= need")
    return near.select("doc_id", "item_id", "n_shingles", "n_common", (F.col("n_common") / F.col("n_shingles")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that contain an item; all columns as they were."""
    leaks = contained_items(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, F.col(id_col).eqNullSafe(F.col("_leak")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH i0 AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), i AS (
  SELECT item_id, w, least(len(w), 5) AS k FROM i0 WHERE len(w) > 0
), q AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM i)
), n AS (
  SELECT item_id, k, count(*) AS s FROM q GROUP BY ALL
), d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), x AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i))
)
SELECT doc_id, item_id, CAST(s AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_common,
       CAST(count(*) AS DOUBLE) / s AS containment
FROM q JOIN n USING (item_id, k) JOIN x USING (k, g)
GROUP BY doc_id, item_id, s HAVING count(*) >= ceil(0.8 * s - 1e-9)
"""
