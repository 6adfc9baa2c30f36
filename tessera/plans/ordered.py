"""Ordered and windowed operators, top-k and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import relational as op
from tessera.operators.numbering import average_ranked, numbered_in, running_before
from tessera.registry import query
from tessera.sources.tables import table


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders")
def dense_ids(spark, sf):
    """Position in the sorted keys."""
    return running_before(table(spark, sf, "orders", "o_orderkey"), "o_orderkey", F.lit(1), "id")


@query("SELECT doc_id, n_chars, CAST(coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents")
def running_offsets(spark, sf):
    """Where each list starts when all are laid end to end."""
    return running_before(table(spark, sf, "documents", "doc_id", "n_chars"), "doc_id", F.col("n_chars"), "start")


@query("SELECT l_orderkey, l_linenumber, l_quantity, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_orderkey, l_quantity) - 1) / 2 AS avg_rank FROM lineitem")
def average_ranks(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return average_ranked(li, ["l_orderkey"], "l_quantity", "avg_rank").select("l_orderkey", "l_linenumber", "l_quantity", "avg_rank")


@query("SELECT doc_id, coalesce(l.quality, 99) AS prior, row_number() OVER (PARTITION BY source ORDER BY coalesce(l.quality, 99), md5(concat('q', CAST(doc_id AS VARCHAR)))) AS pos FROM documents LEFT JOIN labels l USING (doc_id)")
def stable_order_keep(spark, sf):
    """Rows known before come first in their order; new ones follow in hash order."""
    d = table(spark, sf, "documents", "doc_id", "source").join(table(spark, sf, "labels", "doc_id", "quality"), "doc_id", "left")
    d = d.select("doc_id", "source", F.coalesce("quality", F.lit(99)).alias("prior"), op.hash_order(F.col("doc_id"), "q").alias("h"))
    return numbered_in(d, ["source"], [F.col("prior"), F.col("h")], "pos").select("doc_id", "prior", (F.col("pos") + 1).alias("pos"))


@query("WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part), s AS (SELECT unnest(range(0, 5)) AS i) SELECT p_brand, CAST(i AS INTEGER) AS i, p_partkey FROM r JOIN s ON r.r = floor(i * (n - 1) / 4)")
def evenly_spaced_strata(spark, sf):
    """Five evenly spaced members of each brand's price order."""
    r = numbered_in(table(spark, sf, "part", "p_partkey", "p_brand", "p_retailprice"), ["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")], "r")
    strata = F.expr("filter(sequence(0, 4), i -> floor(i * (r_of - 1) / 4) = r)")
    return r.select("p_brand", F.explode(strata).alias("i"), "p_partkey")


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 4 AS INTEGER) AS shard FROM orders")
def strided_shards(spark, sf):
    """Position in key order modulo the number of shards."""
    o = running_before(table(spark, sf, "orders", "o_orderkey"), "o_orderkey", F.lit(1), "i")
    return o.select("o_orderkey", (F.col("i") % 4).cast("int").alias("shard"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_100(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT * FROM (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def unexplained_list(spark, sf):
    """Longest first, then dearest: three a brand."""
    w = Window.partitionBy("p_brand").orderBy(F.length("p_name").desc(), F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf, "part").select("p_brand", "p_partkey", "p_name", F.row_number().over(w).cast("long").alias("r")).where("r <= 3")


@query("SELECT s_nationkey, arg_max(s_name, (s_acctbal, s_suppkey)) AS best, arg_min(s_name, (-s_acctbal, s_suppkey)) AS best_low_id, count(*) AS n FROM supplier GROUP BY 1")
def best_by_two_keys(spark, sf):
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.max_by("s_name", F.struct("s_acctbal", "s_suppkey")).alias("best"), F.min_by("s_name", F.struct(-F.col("s_acctbal"), F.col("s_suppkey"))).alias("best_low_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, count(*) AS turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, bool_and(ok) AS alternates FROM (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role, TRUE) AS ok FROM conversations) GROUP BY 1")
def conversation_order(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "role")
    ok = F.coalesce(F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")) != F.col("role"), F.lit(True))
    return c.withColumn("ok", ok).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.bool_and("ok").alias("alternates"))
