"""Dataset build: round trips through sources and sinks, reports, verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import pipeline as op
from tessera.operators import relational as rel
from tessera.operators.numbering import quantiles
from tessera.operators.shared import new_folder
from tessera.registry import query
from tessera.sources import readers
from tessera.sources.tables import table


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS value FROM customer")
def csv_round_trip(spark, sf):
    """Customers written as CSV and read back under other column names."""
    path = new_folder(spark, "csv")
    table(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal").write.csv(path, header=True)
    return readers.csv(spark, path, "c_custkey long, c_name string, c_acctbal double", {"c_custkey": "id", "c_name": "name", "c_acctbal": "value"})


@query("SELECT s_name AS key, CAST(s_suppkey AS VARCHAR) AS id FROM supplier")
def text_fields_round_trip(spark, sf):
    path = new_folder(spark, "text")
    table(spark, sf, "supplier").select(F.concat_ws("  ", "s_name", "s_suppkey")).write.text(path)
    return readers.fields(spark, path, ["key", "id"])


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def jsonl_last_wins(spark, sf):
    """Orders as gzipped JSON lines; a status filter, then the last record of each key."""
    path = new_folder(spark, "jsonl")
    table(spark, sf, "orders").write.json(path, compression="gzip")
    r = readers.json_lines(spark, path, "o_custkey long, o_orderkey long, o_totalprice double, o_orderstatus string").where("o_orderstatus <> 'P'")
    return rel.last_wins(r, "o_custkey", F.col("o_orderkey"), "o_orderkey", "o_totalprice")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS key FROM part")
def tsv_structures(spark, sf):
    path = new_folder(spark, "tsv")
    table(spark, sf, "part", "p_partkey", "p_name").write.csv(path, sep="\t", header=True)
    return readers.structures(spark, path)


@query("SELECT CAST(p_size AS DOUBLE) AS shift, p_name AS atom, CAST(NULL AS VARCHAR) AS phase FROM part")
def header_synonyms(spark, sf):
    path = new_folder(spark, "synonyms")
    table(spark, sf, "part").select(F.col("p_size").alias("H_PPM"), F.col("p_name").alias("Label")).write.csv(path, header=True)
    s = readers.synonyms(spark, path, {"shift": ["Shift", "h_ppm"], "atom": ["Atom", "label"], "phase": ["Phase"]})
    return s.select(F.col("shift").try_cast("double").alias("shift"), "atom", "phase")


@query("SELECT vec_id AS idx, CAST(len(embedding) AS INTEGER) AS n, CAST(32 AS INTEGER) AS rows_, round(CAST(embedding[3] AS DOUBLE), 6) AS r1c0 FROM embeddings")
def shard_round_trip(spark, sf):
    """Flat shards written per label and rebuilt into rows of two."""
    path = new_folder(spark, "shards")
    e = table(spark, sf, "embeddings")
    op.shards(e, "vec_id", "embedding").write.parquet(path)
    s = spark.read.parquet(path)
    r = s.select("idx", F.col("shape")[0].alias("n")).join(op.rebuilt(s, 2), "idx")
    return r.select("idx", "n", F.size("rows").alias("rows_"), F.round(F.col("rows")[1][0].cast("double"), 6).alias("r1c0"))


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM documents) GROUP BY 1")
def split_routing(spark, sf):
    path = new_folder(spark, "splits")
    d = table(spark, sf, "documents", "doc_id")
    op.write_split(d.withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "val").otherwise("train")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS idx, CASE WHEN quality IS NULL THEN 'absent' WHEN quality = 1 THEN 'chnmr' ELSE 'mnova' END AS h_nmr, CASE WHEN quality = 1 THEN CAST(doc_id + 1000 AS VARCHAR) END AS chnmr_id, quality IS NULL AS is_new FROM documents LEFT JOIN labels USING (doc_id)")
def provenance_table(spark, sf):
    d = table(spark, sf, "documents", "doc_id").join(table(spark, sf, "labels", "doc_id", "quality"), "doc_id", "left")
    q = F.col("quality")
    return d.select(F.col("doc_id").alias("idx"), F.when(q.isNull(), "absent").when(q == 1, "chnmr").otherwise("mnova").alias("h_nmr"), F.when(q == 1, (F.col("doc_id") + 1000).cast("string")).alias("chnmr_id"), q.isNull().alias("is_new"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(lang = 'en' AS INTEGER)), 6) AS english, round(quantile_cont(n_chars, 0.5), 4) AS p50, max(n_chars) AS longest FROM documents")
def run_report(spark, sf):
    """Counts, shares and percentiles of a build in one row."""
    return table(spark, sf, "documents", "lang", "n_chars").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("lang") == "en").cast("int")), 6).alias("english"), F.round(F.percentile("n_chars", F.lit(0.5)), 4).alias("p50"), F.max("n_chars").alias("longest"))


@query("WITH m AS (SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 3) SELECT (SELECT count(*) FROM (SELECT * FROM nation EXCEPT ALL SELECT * FROM m)) AS n_left, (SELECT count(*) FROM (SELECT * FROM m EXCEPT ALL SELECT * FROM nation)) AS n_right, (SELECT count(*) FROM nation) AS n")
def verify_equal(spark, sf):
    """A table against a copy through JSON that lost a row and changed another: rows that either side lacks."""
    path = new_folder(spark, "verify")
    n = table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    n.where("n_nationkey <> 3").withColumn("n_name", F.when(F.col("n_nationkey") == 5, F.lower("n_name")).otherwise(F.col("n_name"))).write.json(path)
    m = op.mismatches(n, spark.read.schema(n.schema).json(path))
    return m.agg(F.count_if(F.col("side") == "left").alias("n_left"), F.count_if(F.col("side") == "right").alias("n_right")).withColumn("n", F.lit(n.count()).cast("long"))


@query("SELECT p_brand, CAST(sum(CASE WHEN p_retailprice > 1200 THEN 1 ELSE 0 END) AS BIGINT) AS has_mass, CAST(sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS BIGINT) AS has_nmr, CAST(sum(CASE WHEN p_retailprice > 1200 OR p_size > 25 THEN 1 ELSE 0 END) AS BIGINT) AS any_, CAST(sum(CASE WHEN p_retailprice > 1200 AND p_size > 25 THEN 1 ELSE 0 END) AS BIGINT) AS all_ FROM part GROUP BY 1")
def modality_filters(spark, sf):
    """How many rows pass has-any and has-all tests."""
    a, b = F.col("p_retailprice") > 1200, F.col("p_size") > 25
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count_if(a).alias("has_mass"), F.count_if(b).alias("has_nmr"), F.count_if(a | b).alias("any_"), F.count_if(a & b).alias("all_"))
