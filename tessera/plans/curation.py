"""Curation and evaluation queries that don't fit the other modules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.assignment import assignment_cost, cleaned_reference, two_sided_p
from tessera.operators.numbering import numbered_in, quantiles
from tessera.operators.relational import one_to_one
from tessera.plans.metrics import SYSTEMS, bits, paired_delta
from tessera.registry import query
from tessera.sources.tables import table


@query("SELECT o_orderstatus, count(*) AS n, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS chosen, min(o_orderdate) AS first_date FROM orders GROUP BY 1")
def choose_record(spark, sf):
    """The record with the most, ties to the lowest id."""
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), F.col("o_orderkey"))).alias("chosen"), F.min("o_orderdate").alias("first_date"))


@query(
    "WITH r AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS pos, doc_id, lang FROM documents), "
    "g AS (SELECT source, count(DISTINCT lang) AS langs, arg_min(lang, doc_id) FILTER (WHERE lang <> '') AS first_lang FROM documents GROUP BY 1) "
    "SELECT source, pos, doc_id, CAST(langs AS BIGINT) AS langs, first_lang FROM r JOIN g USING (source)"
)
def group_by_reference(spark, sf):
    """Members of each reference in order, a row each, with its distinct values and its first non-empty one."""
    d = table(spark, sf, "documents", "source", "doc_id", "lang")
    g = d.groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.min_by("lang", F.when(F.col("lang") != "", F.col("doc_id"))).alias("first_lang"))
    placed = numbered_in(d.select("source", "doc_id"), ["source"], [F.col("doc_id")], "pos")
    return placed.join(F.broadcast(g) if g.count() <= 500_000 else g, "source").select("source", "pos", "doc_id", "langs", "first_lang")


TRUE = "b AS (SELECT vec_id, label, CAST(unnest(range(0, 64)) AS INTEGER) AS col, unnest(CAST(embedding AS DOUBLE[])) AS e FROM embeddings), bits AS (SELECT vec_id, label, col, 1 / (1 + exp(-e * 8)) AS p, CAST(e > 0.02 AS INTEGER) AS y FROM b), t AS (SELECT vec_id, col // 8 AS k, sum(y) AS ny, sum(CAST(p >= 0.5 AS INTEGER)) AS nh FROM bits GROUP BY ALL)"


@query(f"WITH {TRUE} SELECT CAST(k AS BIGINT) AS k, round(avg(CASE WHEN ny > 0 THEN CAST(ny = nh AS INTEGER) END), 6) AS present_only, round(avg(CASE WHEN ny > 0 OR nh > 0 THEN CAST(ny = nh AS INTEGER) END), 6) AS union_ FROM t GROUP BY 1")
def exact_count_accuracy(spark, sf):
    """Exact counts per key: over the keys truly there, and over those there or claimed (phantoms cost)."""
    t = bits(spark, sf).groupBy("vec_id", F.floor(F.col("col") / 8).alias("k")).agg(F.sum("y").alias("ny"), F.count_if(F.col("p") >= 0.5).alias("nh"))
    same = (F.col("ny") == F.col("nh")).cast("int")
    return t.groupBy("k").agg(F.round(F.avg(F.when(F.col("ny") > 0, same)), 6).alias("present_only"), F.round(F.avg(F.when((F.col("ny") > 0) | (F.col("nh") > 0), same)), 6).alias("union_"))


@query(
    "WITH g AS (SELECT l_orderkey, list_sort(list(CAST(l_quantity AS DOUBLE))) AS x, list_sort(list(CAST(l_discount AS DOUBLE) * 100) FILTER (WHERE l_discount > 0.02)) AS y FROM lineitem GROUP BY 1), "
    "s AS (SELECT l_orderkey, CASE WHEN len(x) <= len(y) THEN x ELSE y END AS a, CASE WHEN len(x) <= len(y) THEN y ELSE x END AS b FROM g WHERE y IS NOT NULL), "
    "c AS (SELECT l_orderkey, list_reduce(list_concat([list_transform(range(0, len(b) + 1), lambda j: CAST(0 AS DOUBLE))], list_transform(a, lambda e: [e])), "
    "lambda acc, e: list_concat([CAST(1e18 AS DOUBLE)], list_transform(range(1, len(b) + 1), lambda j: list_min(list_transform(range(1, j + 1), lambda i: acc[i] + abs(b[i] - e[1])))))) AS costs FROM s) "
    "SELECT g.l_orderkey, round(costs[-1], 6) AS cost FROM g LEFT JOIN c USING (l_orderkey)"
)
def assignment_of_lists(spark, sf):
    """Optimal one-to-one assignment of an order's quantities to its discounts (in hundredths)."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("a"), F.collect_list(F.when(F.col("l_discount") > 0.02, F.col("l_discount") * 100)).alias("b"))
    return g.select("l_orderkey", F.round(assignment_cost("a", "b"), 6).alias("cost"))


@query(
    f"WITH {SYSTEMS}, t AS (SELECT count(*) AS n, avg(b - a) / (stddev_samp(b - a) / sqrt(count(*))) AS t FROM s), "
    "x AS (SELECT n, t, unnest(range(0, 20001)) AS i FROM t) "
    "SELECT n, round(any_value(t), 5) AS t, round(2 * 0.0005 / 3 * sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(abs(round(t, 5)) + i * 0.0005) * (abs(round(t, 5)) + i * 0.0005) / 2)) / sqrt(2 * pi()), 6) AS p FROM x GROUP BY n"
)
def paired_delta_p(spark, sf):
    """Two-sided normal p of the paired difference; the twin integrates the bell."""
    return paired_delta(spark, sf).select("n", "t", F.round(two_sided_p("t"), 6).alias("p"))


@query("SELECT p_partkey, '10.1000/' || p_partkey || CASE WHEN p_size % 3 = 1 THEN '(a)' ELSE '' END AS ref FROM part")
def reference_cleanup(spark, sf):
    s = F.col("p_size") % 3
    raw = F.concat(F.lit("10.1000/"), "p_partkey", F.when(s == 0, ").,").when(s == 1, "(a)]").otherwise("&amp;x)."))
    return table(spark, sf, "part").select("p_partkey", cleaned_reference(raw).alias("ref"))


@query("SELECT l_returnflag, round(quantile_cont(m, 0.5), 6) AS median_min, round(avg(CAST(m < 5 AS INTEGER)), 6) AS tail FROM (SELECT l_orderkey, l_returnflag, min(l_quantity) AS m FROM lineitem WHERE l_discount > 0 GROUP BY ALL) GROUP BY 1")
def group_minimum_tail(spark, sf):
    """Each group's minimum among clean rows, then the share under a floor."""
    m = table(spark, sf, "lineitem").where("l_discount > 0").groupBy("l_orderkey", "l_returnflag").agg(F.min("l_quantity").alias("m"))
    mid = quantiles(m, ["l_returnflag"], "m", [0.5], ["q"]).select("l_returnflag", F.round("q", 6).alias("median_min"))
    return m.groupBy("l_returnflag").agg(F.round(F.avg((F.col("m") < 5).cast("int")), 6).alias("tail")).join(mid, "l_returnflag").select("l_returnflag", "median_min", "tail")


@query("SELECT user_id, coalesce(min(r) FILTER (WHERE event_type = 'purchase' AND r <= 10), 10) AS first_hit, coalesce(min(r) FILTER (WHERE value > 99), -1) AS rare_hit FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events) GROUP BY 1")
def first_hit_rank(spark, sf):
    """Rank of the first hit within ten (else 10), and of a rare one anywhere (else -1)."""
    r = table(spark, sf, "events").select("user_id", "event_type", "value", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("r"))
    return r.groupBy("user_id").agg(F.coalesce(F.min(F.when((F.col("event_type") == "purchase") & (F.col("r") <= 10), F.col("r"))), F.lit(10)).alias("first_hit"), F.coalesce(F.min(F.when(F.col("value") > 99, F.col("r"))), F.lit(-1)).alias("rare_hit"))


@query("SELECT doc_id, CASE WHEN h < 0.8 THEN 'train' WHEN h < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, CAST(('0x' || substring(md5('w' || doc_id), 1, 6)) AS INTEGER) / 16777216.0 AS h FROM documents)")
def weighted_hash_split(spark, sf):
    """Each row by itself, by thresholds on a hash."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("w"), "doc_id")), 1, 6), 16, 10).cast("long") / 16777216.0
    return table(spark, sf, "documents", "doc_id").select("doc_id", F.when(h < 0.8, "train").when(h < 0.9, "val").otherwise("test").alias("split"))


@query("SELECT s_nationkey, arg_min(s_name, (CASE WHEN s_name LIKE '%007' THEN 0 WHEN s_acctbal > 9000 THEN 1 WHEN s_acctbal < 0 THEN 2 ELSE 3 END, -s_suppkey)) AS pick FROM supplier GROUP BY 1")
def prioritised_pick(spark, sf):
    """Exact name, else best, else last, else newest."""
    rank = F.when(F.col("s_name").like("%007"), 0).when(F.col("s_acctbal") > 9000, 1).when(F.col("s_acctbal") < 0, 2).otherwise(3)
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min_by("s_name", F.struct(rank, -F.col("s_suppkey"))).alias("pick"))


@query("SELECT conv_id, count(*) AS n, round(coalesce(sum(length(text)), 0) / greatest(count(*), 1), 6) AS mean_chars, CAST(sum(CASE WHEN contains(text, '?') THEN 1 ELSE 0 END) AS BIGINT) AS questions FROM conversations GROUP BY 1")
def sharded_mean(spark, sf):
    """Partial sums and counts, divided once."""
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum(F.length("text")), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("mean_chars"), F.count_if(F.contains("text", F.lit("?"))).alias("questions"))


@query("SELECT o_orderkey, o_custkey, l.n AS lines, round(l.revenue, 4) AS revenue, (SELECT count(*) FROM orders) AS n_left, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_right, (SELECT count(*) FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey) AS n_joined FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey")
def validated_merge(spark, sf):
    """One-to-one inner join of orders with their totals: a key repeated on either side is an error; counts before and after."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 4).alias("revenue"))
    return one_to_one(o, l.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
