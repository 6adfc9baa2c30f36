"""Feature extraction, vocabulary and bank queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import features as op
from tessera.operators.bank import bank_of
from tessera.registry import query
from tessera.sources.tables import table

TOK = "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents)"
MULT = f"{TOK}, mult AS MATERIALIZED (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY ALL)"
FEAT = f"{MULT}, feat AS MATERIALIZED (SELECT doc_id, token, CAST(unnest(range(1, least(n, 5) + 1)) AS INTEGER) AS k FROM mult)"
VOC = (
    f"{FEAT}, df AS (SELECT token, k, count(*) AS df FROM feat GROUP BY ALL), tot AS (SELECT count(*) AS n FROM documents), "
    "ent AS (SELECT token, k, df, -(p * log2(p) + (1 - p) * log2(1 - p)) AS h FROM (SELECT token, k, df, greatest(1e-12, least(1 - 1e-12, df / n)) AS p FROM df, tot)), "
    "voc AS MATERIALIZED (SELECT token, k, df, h, CAST(row_number() OVER (ORDER BY round(h, 9) DESC, token, k) - 1 AS INTEGER) AS col FROM ent QUALIFY col < 1024)"
)
BANK = f"{VOC}, bank AS MATERIALIZED (SELECT doc_id, col FROM feat JOIN voc USING (token, k)), nnz AS (SELECT d.doc_id, count(b.col) AS nnz FROM documents d LEFT JOIN bank b USING (doc_id) GROUP BY 1)"


def docs(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text")


def parts(spark, sf):
    """(vocabulary, postings) of the documents, from the bank's files."""
    bank = bank_of(spark, sf)
    return bank.vocab, bank.postings()


@query(f"WITH {MULT} SELECT * FROM mult")
def feature_multiset(spark, sf):
    return op.multiset(docs(spark, sf))


@query(f"WITH {FEAT} SELECT * FROM feat")
def feature_thermometer_cap5(spark, sf):
    return op.thermometer(op.multiset(docs(spark, sf)))


@query(f"WITH {MULT} SELECT doc_id, token, CAST(unnest(range(1, n + 1)) AS INTEGER) AS k FROM mult")
def feature_thermometer_uncapped(spark, sf):
    return op.thermometer(op.multiset(docs(spark, sf)), None)


@query(f"WITH {TOK} SELECT DISTINCT doc_id, token FROM tok")
def feature_presence(spark, sf):
    return op.tokens(docs(spark, sf)).distinct()


@query(
    "WITH line AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line FROM documents), "
    "occ AS (SELECT DISTINCT doc_id, line, unnest(regexp_extract_all(line, '[a-z]{3,}')) AS token FROM line) "
    "SELECT doc_id, token, count(*) AS n FROM occ GROUP BY ALL"
)
def feature_unique_occurrences(spark, sf):
    """Occurrences first made distinct on (token, line), then counted."""
    return op.unique_occurrences(docs(spark, sf))


@query(f"WITH {VOC} SELECT token, k, df, col, round(h, 6) AS h FROM voc")
def vocab_entropy_topk(spark, sf):
    """Built anew, not read from the bank's files."""
    d = docs(spark, sf)
    vocab = op.vocabulary(op.thermometer(op.multiset(d)), d.count())
    return vocab.select("token", "k", "df", "col", F.round("h", 6).alias("h"))


@query(f"WITH {BANK} SELECT * FROM bank")
def bank_postings(spark, sf):
    return parts(spark, sf)[1]


@query(f"WITH {BANK} SELECT doc_id, nnz, CASE WHEN nnz > 0 THEN round(1 / sqrt(nnz), 6) ELSE 0 END AS unit FROM nnz")
def bank_nnz(spark, sf):
    """Row sizes with empty rows kept, and the value of a unit-length row's entries."""
    return bank_of(spark, sf).rows.select("doc_id", "nnz", F.when(F.col("nnz") > 0, F.round(1 / F.sqrt("nnz"), 6)).otherwise(0.0).alias("unit"))


@query(f"WITH {VOC} SELECT token, max(k) AS kmax, count(*) AS levels FROM voc GROUP BY token")
def max_level_per_token(spark, sf):
    return parts(spark, sf)[0].groupBy("token").agg(F.max("k").alias("kmax"), F.count(F.lit(1)).alias("levels"))


@query(f"WITH {VOC} SELECT k, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM voc GROUP BY k")
def selected_features_by_level(spark, sf):
    """Histogram of the chosen features by level with each level's share."""
    by = parts(spark, sf)[0].groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("t"))
    return by.crossJoin(F.broadcast(total)).select("k", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("pct"))


@query(
    f"WITH {BANK}, shift AS (SELECT b.doc_id, v.token, v.k, h.col IS NOT NULL AS held FROM bank b JOIN voc v USING (col) "
    "LEFT JOIN voc w ON w.token = v.token AND w.k = v.k + 1 LEFT JOIN bank h ON h.doc_id = b.doc_id AND h.col = w.col) "
    "SELECT doc_id, token, k, CAST(held AS INTEGER) AS value FROM shift"
)
def ladder_shift_down(spark, sf):
    """Each held level takes the value of the level above it; a missing rung gives 0."""
    bank = bank_of(spark, sf)
    above = bank.vocab.select("token", (F.col("k") - 1).alias("k"), F.col("col").alias("up"))
    ladder = bank.vocab.select("token", "k", "col").join(above, ["token", "k"], "left")
    held = bank.rows.select("doc_id", "bits", F.explode(op.columns_of("bits")).alias("col")).join(F.broadcast(ladder), "col")
    value = F.coalesce(F.getbit(F.col("bits")[F.shiftright("up", 6)], F.col("up").bitwiseAND(63)).cast("int"), F.lit(0))
    return held.select("doc_id", "token", "k", value.alias("value"))
