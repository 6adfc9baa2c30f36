"""Evaluation analytics: calibration, error decomposition, sweeps, summaries, seeds, resampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.numbering import average_ranked, quantiles
from tessera.plans.retrieval import predictions
from tessera.registry import query
from tessera.sources.tables import table

BITS = "b AS (SELECT vec_id, label, CAST(unnest(range(0, 64)) AS INTEGER) AS col, unnest(CAST(embedding AS DOUBLE[])) AS e FROM embeddings), bits AS (SELECT vec_id, label, col, 1 / (1 + exp(-e * 8)) AS p, CAST(e > 0.02 AS INTEGER) AS y FROM b)"


def bits(spark, sf):
    """(vec_id, label, col, p, y): one row per vector and column; p sharpened, y a harder threshold so that errors exist."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("col", "e"))
    return e.select("vec_id", "label", "col", (1 / (1 + F.exp(-F.col("e") * 8))).alias("p"), (F.col("e") > 0.02).cast("int").alias("y"))


@query(f"WITH {BITS} SELECT round(p, 2) AS value, count(*) AS cnt, CAST(sum(y) AS BIGINT) AS pos FROM bits GROUP BY 1")
def calibration_tabulate(spark, sf):
    return bits(spark, sf).groupBy(F.round("p", 2).alias("value")).agg(F.count(F.lit(1)).alias("cnt"), F.sum("y").cast("long").alias("pos"))


def tabulated(spark, sf):
    return bits(spark, sf).groupBy(F.round("p", 2).alias("v")).agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("pos"))


@query(f"WITH {BITS}, t AS (SELECT round(p, 2) AS v, count(*) AS c, sum(y) AS pos FROM bits GROUP BY 1), n AS (SELECT sum(c) AS n FROM t) SELECT round(sum(c * abs(v - pos / c)) / any_value(n), 6) AS ece, round(sum(pos * (1 - v) * (1 - v) + (c - pos) * v * v) / any_value(n), 6) AS brier, round(-sum(pos * ln(greatest(v, 1e-12)) + (c - pos) * ln(greatest(1 - v, 1e-12))) / any_value(n), 6) AS nll FROM t, n")
def calibration_metrics(spark, sf):
    t = tabulated(spark, sf)
    v, c, pos, n = F.col("v"), F.col("c"), F.col("pos"), F.sum("c")
    return t.agg(F.round(F.sum(c * F.abs(v - pos / c)) / n, 6).alias("ece"), F.round(F.sum(pos * (1 - v) * (1 - v) + (c - pos) * v * v) / n, 6).alias("brier"), F.round(-F.sum(pos * F.log(F.greatest(v, F.lit(1e-12))) + (c - pos) * F.log(F.greatest(1 - v, F.lit(1e-12)))) / n, 6).alias("nll"))


@query(f"WITH {BITS} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS conf, round(avg(y), 6) AS acc FROM bits GROUP BY 1")
def reliability_bins(spark, sf):
    return bits(spark, sf).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("conf"), F.round(F.avg("y"), 6).alias("acc"))


@query(
    f"WITH {BITS}, t AS (SELECT round(p, 2) AS v, count(*) AS c, CAST(sum(y) AS BIGINT) AS pos FROM bits GROUP BY 1), "
    "s AS (SELECT a.v AS lo, b.v AS hi, sum(x.pos) / sum(x.c) AS m FROM t a JOIN t b ON b.v >= a.v JOIN t x ON x.v BETWEEN a.v AND b.v GROUP BY ALL), "
    "f AS (SELECT t.v, s.lo, min(s.m) AS m FROM t JOIN s ON s.lo <= t.v AND s.hi >= t.v GROUP BY ALL) "
    "SELECT t.v, c, round(pos / c, 6) AS rate, round((SELECT max(m) FROM f WHERE f.v = t.v), 6) AS fit FROM t"
)
def isotonic_fit(spark, sf):
    """Weighted isotonic regression of the tabulated rate on confidence; monotone and within [0, 1]."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    t = tabulated(spark, sf).select("v", "c", (F.col("pos") / F.col("c")).alias("rate"))
    t = VectorAssembler(inputCols=["v"], outputCol="f").transform(t)
    m = IsotonicRegression(featuresCol="f", labelCol="rate", weightCol="c", predictionCol="fit").fit(t)
    return m.transform(t).select("v", "c", F.round("rate", 6).alias("rate"), F.round(F.least(F.greatest("fit", F.lit(0.0)), F.lit(1.0)), 6).alias("fit"))


@query(f"WITH {BITS}, t AS (SELECT round(p, 2) AS v, sum(y) / count(*) AS rate FROM bits GROUP BY 1) SELECT v, round(max(rate) OVER (ORDER BY v), 6) AS mono FROM t")
def running_max_monotone(spark, sf):
    t = tabulated(spark, sf).select("v", (F.col("pos") / F.col("c")).alias("rate"))  # at most 101 rows
    return t.select("v", F.round(F.max("rate").over(Window.orderBy("v")), 6).alias("mono"))


@query(f"WITH {BITS}, g AS (SELECT vec_id, col // 8 AS gid, sum(p - y) AS r, sum(abs(p - y)) AS a FROM bits GROUP BY ALL) SELECT vec_id, round(sum(a), 6) AS total, round(sum(abs(r)), 6) AS between_, round(sum(a) - sum(abs(r)), 6) AS within_ FROM g GROUP BY 1")
def error_l1_groups(spark, sf):
    g = bits(spark, sf).groupBy("vec_id", F.floor(F.col("col") / 8).alias("gid")).agg(F.sum(F.col("p") - F.col("y")).alias("r"), F.sum(F.abs(F.col("p") - F.col("y"))).alias("a"))
    return g.groupBy("vec_id").agg(F.round(F.sum("a"), 6).alias("total"), F.round(F.sum(F.abs("r")), 6).alias("between_"), F.round(F.sum("a") - F.sum(F.abs("r")), 6).alias("within_"))


@query(f"WITH {BITS}, g AS (SELECT vec_id, col // 8 AS gid, sum(p) AS sp, sum(y) AS sy, max(p) AS mp, max(y) AS my FROM bits GROUP BY ALL) SELECT vec_id, round(sum(sp * sy) / greatest(sqrt(sum(sp * sp)) * sqrt(sum(sy * sy)), 1e-12), 6) AS cos_sum, round(sum(mp * my) / greatest(sqrt(sum(mp * mp)) * sqrt(sum(my * my)), 1e-12), 6) AS cos_or FROM g GROUP BY 1")
def group_projected_cosine(spark, sf):
    g = bits(spark, sf).groupBy("vec_id", F.floor(F.col("col") / 8).alias("gid")).agg(F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.max("p").alias("mp"), F.max("y").alias("my"))
    cos = lambda a, b: F.round(F.sum(F.col(a) * F.col(b)) / F.greatest(F.sqrt(F.sum(F.col(a) * F.col(a))) * F.sqrt(F.sum(F.col(b) * F.col(b))), F.lit(1e-12)), 6)
    return g.groupBy("vec_id").agg(cos("sp", "sy").alias("cos_sum"), cos("mp", "my").alias("cos_or"))


@query(f"WITH {BITS}, e AS (SELECT vec_id, col, CAST(p >= 0.5 AS INTEGER) AS h, y FROM bits), g AS (SELECT vec_id, col // 8 AS gid, sum(h) AS nh, sum(y) AS ny FROM e GROUP BY ALL), x AS (SELECT e.*, nh, ny FROM e JOIN g ON e.vec_id = g.vec_id AND e.col // 8 = g.gid) SELECT CASE WHEN h = 1 AND y = 0 THEN CASE WHEN ny >= nh THEN 'FP_swap' WHEN ny > 0 THEN 'FP_over' ELSE 'FP_new' END WHEN h = 0 AND y = 1 THEN CASE WHEN nh >= ny THEN 'FN_swap' WHEN nh > 0 THEN 'FN_under' ELSE 'FN_missed' END WHEN h = 1 THEN 'TP' ELSE 'TN' END AS kind, count(*) AS n FROM x GROUP BY 1")
def error_taxonomy(spark, sf):
    """Errors by what the rest of their group says: swapped inside it, over or under its count, or a group that is all wrong."""
    e = bits(spark, sf).select("vec_id", F.floor(F.col("col") / 8).alias("gid"), (F.col("p") >= 0.5).cast("int").alias("h"), "y")
    g = e.groupBy("vec_id", "gid").agg(F.sum("h").alias("nh"), F.sum("y").alias("ny"), F.count_if((F.col("h") == 1) & (F.col("y") == 0)).alias("fp"), F.count_if((F.col("h") == 0) & (F.col("y") == 1)).alias("fn"), F.count_if((F.col("h") == 1) & (F.col("y") == 1)).alias("tp"), F.count_if((F.col("h") == 0) & (F.col("y") == 0)).alias("tn"))
    nh, ny = F.col("nh"), F.col("ny")
    fp = F.when(ny >= nh, "FP_swap").when(ny > 0, "FP_over").otherwise("FP_new")
    fn = F.when(nh >= ny, "FN_swap").when(nh > 0, "FN_under").otherwise("FN_missed")
    counts = F.explode(F.array(F.struct(fp.alias("kind"), F.col("fp").alias("c")), F.struct(fn.alias("kind"), F.col("fn").alias("c")), F.struct(F.lit("TP").alias("kind"), F.col("tp").alias("c")), F.struct(F.lit("TN").alias("kind"), F.col("tn").alias("c"))))
    return g.select(counts.alias("x")).groupBy("x.kind").agg(F.sum("x.c").alias("n")).where("n > 0")


@query(f"WITH {BITS}, t AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7]) AS tau), c AS (SELECT tau, vec_id, sum(CAST(p >= tau AS INTEGER) * y) AS tp, sum(CAST(p >= tau AS INTEGER)) AS h, sum(y) AS y FROM bits, t GROUP BY ALL) SELECT CAST(tau AS DOUBLE) AS tau, round(sum(tp) / greatest(sum(y), 1), 6) AS recall, round(sum(tp) / greatest(sum(h), 1), 6) AS precision_, round(avg(CASE WHEN h + y - tp = 0 THEN 1.0 ELSE tp / (h + y - tp) END), 6) AS tanimoto, round(avg(abs(h - y)), 6) AS count_l1 FROM c GROUP BY 1")
def tau_sweep(spark, sf):
    """All thresholds in one pass: each row's counts for every tau side by side, no row multiplied before it is summed."""
    taus = [0.3, 0.4, 0.5, 0.6, 0.7]
    aggs = [F.sum("y").alias("y")]
    for i, t in enumerate(taus):
        aggs += [F.sum(F.when(F.col("p") >= t, F.col("y")).otherwise(0)).alias(f"tp{i}"), F.count_if(F.col("p") >= t).alias(f"h{i}")]
    c = bits(spark, sf).groupBy("vec_id").agg(*aggs)
    c = c.select("y", F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"tp{i}").alias("tp"), F.col(f"h{i}").alias("h")) for i, t in enumerate(taus)])).alias("x")).select("y", "x.*")
    union = F.col("h") + F.col("y") - F.col("tp")
    return c.groupBy("tau").agg(F.round(F.sum("tp") / F.greatest(F.sum("y"), F.lit(1)), 6).alias("recall"), F.round(F.sum("tp") / F.greatest(F.sum("h"), F.lit(1)), 6).alias("precision_"), F.round(F.avg(F.when(union == 0, 1.0).otherwise(F.col("tp") / union)), 6).alias("tanimoto"), F.round(F.avg(F.abs(F.col("h") - F.col("y"))), 6).alias("count_l1"))


@query(f"WITH {BITS}, h AS (SELECT *, CAST(p >= 0.5 AS INTEGER) AS h FROM bits) SELECT label, round(sum(h * y) / sum(h), 6) AS precision_, round(sum(h * y) / sum(y), 6) AS recall, round(2 * sum(h * y) / (sum(h) + sum(y)), 6) AS f1, round(avg(CAST(h = y AS INTEGER)), 6) AS accuracy, CAST(sum(h) AS BIGINT) AS active FROM h GROUP BY 1")
def confusion_metrics(spark, sf):
    b = bits(spark, sf).withColumn("h", (F.col("p") >= 0.5).cast("int"))
    tp = F.sum(F.col("h") * F.col("y"))
    return b.groupBy("label").agg(F.round(tp / F.sum("h"), 6).alias("precision_"), F.round(tp / F.sum("y"), 6).alias("recall"), F.round(2 * tp / (F.sum("h") + F.sum("y")), 6).alias("f1"), F.round(F.avg((F.col("h") == F.col("y")).cast("int")), 6).alias("accuracy"), F.sum("h").cast("long").alias("active"))


@query(f"WITH {BITS}, c AS (SELECT vec_id, sum(CAST(p >= 0.5 AS INTEGER)) AS h, sum(y) AS y FROM bits GROUP BY 1) SELECT CASE WHEN y < 20 THEN '<20' WHEN y < 26 THEN '20-25' ELSE '26+' END AS bin, CAST(greatest(-3, least(3, h - y)) AS INTEGER) AS delta, count(*) AS n FROM c GROUP BY ALL")
def count_delta_bins(spark, sf):
    c = bits(spark, sf).groupBy("vec_id").agg(F.count_if(F.col("p") >= 0.5).alias("h"), F.sum("y").alias("y"))
    b = F.when(F.col("y") < 20, "<20").when(F.col("y") < 26, "20-25").otherwise("26+")
    return c.groupBy(b.alias("bin"), F.greatest(F.lit(-3), F.least(F.lit(3), F.col("h") - F.col("y"))).cast("int").alias("delta")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY embedding[1]) + (count(*) OVER (PARTITION BY label, embedding[1]) - 1) / 2 AS a, rank() OVER (PARTITION BY label ORDER BY embedding[2]) + (count(*) OVER (PARTITION BY label, embedding[2]) - 1) / 2 AS b FROM embeddings) SELECT label, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1")
def spearman_pairs(spark, sf):
    """Rank correlation of two components of the vectors (stand-ins for two measures of a row), by label."""
    e = table(spark, sf, "embeddings").select("label", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    r = average_ranked(average_ranked(e, ["label"], "x", "a"), ["label"], "y", "b")
    return r.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("a", "b"), 6).alias("rho"))


SEED = "m AS (SELECT vec_id % 5 AS metric, label AS seed, avg(embedding[1]) AS v FROM embeddings WHERE label < 3 AND NOT (label = 1 AND vec_id % 5 = 4) GROUP BY ALL)"


def seed_values(spark, sf):
    """(metric, seed, v): three labels stand for seeds, the first component for a measure; one value is missing."""
    e = table(spark, sf, "embeddings").where("label < 3 AND NOT (label = 1 AND vec_id % 5 = 4)")
    return e.groupBy((F.col("vec_id") % 5).alias("metric"), F.col("label").alias("seed")).agg(F.avg(F.col("embedding")[0].cast("double")).alias("v"))


@query(f"WITH {SEED.replace('avg(embedding[1])', 'avg(CAST(embedding[1] AS DOUBLE))')} SELECT metric, CASE WHEN count(*) < 3 THEN NULL ELSE round(avg(v), 6) END AS mean, CASE WHEN count(*) < 3 THEN NULL ELSE round(stddev_samp(v), 6) END AS sd FROM m GROUP BY 1")
def seed_mean_sample_sd(spark, sf):
    """Mean and sample deviation over three seeds; null if any is missing."""
    short = F.count(F.lit(1)) < 3
    return seed_values(spark, sf).groupBy("metric").agg(F.when(~short, F.round(F.avg("v"), 6)).alias("mean"), F.when(~short, F.round(F.stddev_samp("v"), 6)).alias("sd"))


@query(f"WITH {SEED.replace('avg(embedding[1])', 'avg(CAST(embedding[1] AS DOUBLE))')} SELECT metric, count(*) AS seeds, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM m GROUP BY 1")
def seed_mean_pop_sd(spark, sf):
    return seed_values(spark, sf).groupBy("metric").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority))")
def pooled_grouping_sets(spark, sf):
    o = table(spark, sf, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return o.groupingSets([["o_orderpriority", "o_orderstatus"], ["o_orderpriority"]], "o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'X') AS x FROM lineitem GROUP BY 1")
def source_modality_pivot(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F", "X"]).count().na.fill(0)
    return p.select("l_returnflag", F.col("O").alias("o"), F.col("F").alias("f"), F.col("X").alias("x"))


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.05), 6) AS p5, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.95), 6) AS p95 FROM lineitem GROUP BY 1")
def percentiles(spark, sf):
    names = ("p5", "p50", "p95")
    g = quantiles(table(spark, sf, "lineitem", "l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity", [0.05, 0.5, 0.95], list(names))
    return g.select("l_returnflag", *[F.round(n, 6).alias(n) for n in names])


SYSTEMS = "s AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)"


def systems(spark, sf):
    """(vec_id, label, a, b): the first two components of each vector stand for the scores of two systems."""
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))


@query(f"WITH {SYSTEMS} SELECT label, count(*) FILTER (WHERE NOT a > 0 AND b > 0) AS fixed, count(*) FILTER (WHERE a > 0 AND NOT b > 0) AS broke FROM s GROUP BY 1")
def flips_at_k(spark, sf):
    a, b = F.col("a") > 0, F.col("b") > 0
    return systems(spark, sf).groupBy("label").agg(F.count_if(~a & b).alias("fixed"), F.count_if(a & ~b).alias("broke"))


@query(f"WITH {SYSTEMS} SELECT count(*) AS n, round(avg(b - a), 6) AS mean, round(stddev_samp(b - a), 6) AS sd, round(stddev_samp(b - a) / sqrt(count(*)), 6) AS se, round(avg(b - a) / (stddev_samp(b - a) / sqrt(count(*))), 5) AS t, count(*) FILTER (WHERE b > a) AS up, count(*) FILTER (WHERE b < a) AS down FROM s")
def paired_delta(spark, sf):
    d = systems(spark, sf).withColumn("d", F.col("b") - F.col("a"))
    se = F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.stddev_samp("d"), 6).alias("sd"), F.round(se, 6).alias("se"), F.round(F.avg("d") / se, 5).alias("t"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))


#: Poisson(1) cumulative probabilities, fixed values.
POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406)


def poisson_weights(ids: np.ndarray, replicates: int) -> np.ndarray:
    """(rows x replicates) Poisson(1) weights from a multiplicative hash of (row, replicate), the same on any machine."""
    x = (ids[:, None] * 48271 + np.arange(replicates)[None, :] * 69621 + 12345) % 2147483647
    x = (x * 16807) % 2147483647
    x = (x * 48271) % 2147483647
    return np.searchsorted(np.array(POISSON), x / 2147483647, side="right")


def _replicates(batches):
    for b in batches:
        for s in range(0, b.num_rows, 4096):
            ids, d = (b.column(i).slice(s, 4096).to_numpy(zero_copy_only=False) for i in (0, 1))
            w = poisson_weights(ids, 200)
            yield pa.RecordBatch.from_arrays([pa.array(range(200), pa.int32()), pa.array(w.sum(0), pa.int64()), pa.array(d @ w)], ["rep", "w", "wd"])


@query(
    f"WITH {SYSTEMS}, r AS (SELECT vec_id, b - a AS d, unnest(range(0, 200)) AS rep FROM s), x AS (SELECT rep, d, (((vec_id * 48271 + rep * 69621 + 12345) % 2147483647 * 16807) % 2147483647 * 48271) % 2147483647 / 2147483647 AS u FROM r), "
    f"w AS (SELECT rep, d, {' + '.join(f'CAST(u >= {c} AS INTEGER)' for c in POISSON)} AS w FROM x), m AS (SELECT rep, sum(w * d) / sum(w) AS m FROM w GROUP BY 1) "
    "SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, round(avg(CAST(m <= 0 AS INTEGER)), 6) AS p_le_0 FROM m"
)
def bootstrap_ci(spark, sf):
    """Paired bootstrap of the mean difference of two components of the vectors: 200 Poisson-weighted means.

    A task adds up each replicate's weights over its rows as a matrix product, so 200 rows a batch leave it.
    """
    d = systems(spark, sf).select("vec_id", (F.col("b") - F.col("a")).alias("d"))
    one = d.mapInArrow(_replicates, "rep int, w long, wd double").groupBy("rep").agg((F.sum("wd") / F.sum("w")).alias("m"))
    return one.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("hi"), F.round(F.avg((F.col("m") <= 0).cast("int")), 6).alias("p_le_0"))


@query("WITH h AS (SELECT label, CAST(least(floor((embedding[1] + 1) / 2 * 25), 24) AS INTEGER) AS bin FROM embeddings) SELECT bin, count(*) AS n, round(count(*) / (SELECT count(DISTINCT label) FROM embeddings), 6) AS mean_per_seed FROM h GROUP BY 1")
def histogram_25(spark, sf):
    """Bins of the first component (a score's stand-in) over [-1, 1] and their mean per label."""
    e = table(spark, sf, "embeddings")
    seeds = e.agg(F.countDistinct("label").alias("s"))
    h = e.groupBy(F.least(F.floor((F.col("embedding")[0] + F.lit(1).cast("float")) / 2 * 25), F.lit(24)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.crossJoin(F.broadcast(seeds)).select("bin", "n", F.round(F.col("n") / F.col("s"), 6).alias("mean_per_seed"))


@query("SELECT label, col, round(avg(e), 6) AS mean FROM (SELECT label, CAST(unnest(range(0, 64)) AS INTEGER) AS col, unnest(CAST(embedding AS DOUBLE[])) AS e FROM embeddings) GROUP BY ALL")
def consensus_vector(spark, sf):
    """Element-wise mean of each label's vectors."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("col", "e"))
    return e.groupBy("label", "col").agg(F.round(F.avg("e"), 6).alias("mean"))


@query("SELECT l_shipmode_like AS grp, round(sum(x * n) / sum(n), 6) AS pooled, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_returnflag AS l_shipmode_like, l_linestatus, avg(l_discount) AS x, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def weighted_pooled_rates(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("x"), F.count(F.lit(1)).alias("n"))
    return g.groupBy(F.col("l_returnflag").alias("grp")).agg(F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 6).alias("pooled"), F.sum("n").alias("n"))


@query("SELECT round(avg(x), 6) AS share, CASE WHEN avg(x) > 0.5 THEN round(1 - 0.5 / avg(x), 6) ELSE 0 END AS drop_ FROM (SELECT CAST(p_size > 15 AS INTEGER) AS x FROM part)")
def drop_percentage(spark, sf):
    s = F.avg((F.col("p_size") > 15).cast("int"))
    return table(spark, sf, "part").agg(F.round(s, 6).alias("share"), F.when(s > 0.5, F.round(1 - 0.5 / s, 6)).otherwise(0.0).alias("drop_"))


@query(f"WITH {BITS}, t AS (SELECT vec_id, sum(y) AS k FROM bits GROUP BY 1), r AS (SELECT b.vec_id, y, row_number() OVER (PARTITION BY b.vec_id ORDER BY round(p, 9) DESC, col) AS r, k FROM bits b JOIN t USING (vec_id)) SELECT vec_id, CAST(max(k) AS BIGINT) AS k, CAST(sum(y) AS BIGINT) AS hits FROM r WHERE r <= k GROUP BY 1")
def topk_true_count(spark, sf):
    """As many columns per row as it truly has; how many are right.  Sorted inside each row's array of columns."""
    b = bits(spark, sf).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct((-F.round("p", 9)).alias("o"), "col", "y"))).alias("a"), F.sum("y").alias("k"))
    hit = F.aggregate(F.slice("a", F.lit(1), F.col("k").cast("int")), F.lit(0).cast("long"), lambda s, x: s + x["y"])
    return b.where("k > 0").select("vec_id", F.col("k").cast("long").alias("k"), hit.alias("hits"))
