"""Verbatim passages in documents: candidates by the passages' inner words, then the exact test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Inner words that make a key; passages with fewer use what they have.
KEY = 3
#: Keys and candidates of at most this many rows (some 30 MB) are broadcast, more are shuffled; passages without a key are tried in blocks of ``TRIED``.
BROADCAST_ROWS, TRIED = 500_000, 2_000
BREAK = "[ \n]+"


def verbatim(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id) wherever ``docs`` (doc_id, text) holds a passage of (item_id, text); nulls hold and match nothing.

    A passage's words but the first and last are whole words of every text that holds it, whatever stands around
    it.  Up to three of them are its key, looked up among the word groups of that length; passages without inner
    words are a query set that is tried on every text, in blocks.
    """
    words = F.split("passage", BREAK)
    p = passages.select("item_id", F.col("text").alias("passage")).where("passage IS NOT NULL")
    p = p.withColumn("w", F.slice(words, F.lit(2), F.greatest(F.least(F.size(words) - 2, F.lit(KEY)), F.lit(0))))
    p = p.withColumn("k", F.size("w")).withColumn("h", F.xxhash64(F.concat_ws(" ", "w")))
    sizes = {r.k: r.n for r in p.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # KEY + 1 rows at most
    d = docs.select("doc_id", "text").where("text IS NOT NULL")
    found = None
    for k in sorted(x for x in sizes if x):
        groups = F.expr(f"transform(array(split(text, '{BREAK}')), a -> array_distinct(transform(sequence(1, greatest(size(a) - {k - 1}, 1)), i -> xxhash64(concat_ws(' ', slice(a, i, {k}))))))[0]".replace("\n", "\\n"))
        keys = p.where(F.col("k") == k).select("item_id", "h")
        hits = d.select("doc_id", F.explode(groups).alias("h")).join(F.broadcast(keys) if sizes[k] <= BROADCAST_ROWS else keys, "h").select("doc_id", "item_id")
        found = hits if found is None else found.union(hits)
    out = None
    if found is not None:
        found = found.distinct()
        texts = p.where("k > 0").select("item_id", "passage")
        n = sum(v for k, v in sizes.items() if k)
        near = d.join(found, "doc_id").join(F.broadcast(texts) if n <= BROADCAST_ROWS // 10 else texts, "item_id")
        out = near.where(F.contains("text", "passage")).select("doc_id", "item_id")
    if sizes.get(0):
        bare = p.where("k = 0").select("item_id", "passage")
        n = -(-sizes[0] // TRIED)
        for b in range(n):
            block = bare.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(n)) == b) if n > 1 else bare
            hit = d.join(F.broadcast(block), F.contains("text", "passage")).select("doc_id", "item_id")
            out = hit if out is None else out.union(hit)
    return out.distinct() if out is not None else d.select("doc_id", F.lit(None).cast(passages.schema["item_id"].dataType).alias("item_id")).where(F.lit(False))
