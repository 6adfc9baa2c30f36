"""Rate limiting and other time-keyed queries over ``events``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.limiter import limited
from tessera.operators.shared import new_folder
from tessera.registry import ORACLES, query
from tessera.sources.tables import table
from tessera.streaming.limiter import count_kinds, drained, rate_limited


def hits(spark, sf):
    """(user_id, event_id, sec): events by whole seconds."""
    return table(spark, sf, "events", "user_id", "event_id", "ts").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"))


@query(
    "WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))) AS r FROM events), "
    "w AS (SELECT user_id, r, t AS start, 1 AS n, 1 AS allowed, 0 AS rejected, 1 AS windows FROM e WHERE r = 1 UNION ALL "
    "SELECT e.user_id, e.r, CASE WHEN e.t - start >= 3600 THEN e.t ELSE start END, CASE WHEN e.t - start >= 3600 THEN 1 WHEN n < 2 THEN n + 1 ELSE n END, "
    "allowed + CASE WHEN e.t - start >= 3600 OR n < 2 THEN 1 ELSE 0 END, rejected + CASE WHEN e.t - start >= 3600 OR n < 2 THEN 0 ELSE 1 END, windows + CASE WHEN e.t - start >= 3600 THEN 1 ELSE 0 END "
    "FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1) "
    "SELECT user_id, CAST(max(allowed) AS BIGINT) AS allowed, CAST(max(rejected) AS BIGINT) AS rejected, CAST(max(windows) AS BIGINT) AS windows FROM w GROUP BY 1"
)
def fixed_window_limiter(spark, sf):
    """At most two hits an hour, hours anchored at a user's first hit."""
    return limited(hits(spark, sf), "user_id", "sec", 3600, 2)


@query("SELECT user_id, event_type, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY ALL")
def usage_counters(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


@query(
    "WITH e AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), "
    "g AS (SELECT user_id, bad, r - row_number() OVER (PARTITION BY user_id, bad ORDER BY r) AS island, r FROM e), "
    "s AS (SELECT user_id, bad, min(r) AS start, count(*) AS n FROM g GROUP BY user_id, bad, island) "
    "SELECT user_id, coalesce(min(start) FILTER (WHERE bad AND n >= 2), 0) AS first_run, coalesce(max(n) FILTER (WHERE bad), 0) AS longest FROM s GROUP BY 1"
)
def queue_front(spark, sf):
    """Gaps and islands: where a user's first run of two errors or more starts, and the longest run (0: none)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", (F.col("event_type") == "error").alias("bad"), F.row_number().over(w).cast("long").alias("r"))
    g = e.withColumn("island", F.col("r") - F.row_number().over(Window.partitionBy("user_id", "bad").orderBy("r")))
    s = g.groupBy("user_id", "bad", "island").agg(F.min("r").alias("start"), F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("bad") & (F.col("n") >= 2), F.col("start"))), F.lit(0)).alias("first_run"), F.coalesce(F.max(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("longest"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, count(*) OVER (PARTITION BY user_id) AS queued FROM events WHERE event_type = 'purchase'")
def queue_position(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    return e.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("position"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("queued"))


def _stream(spark, sf):
    """Events as a stream of files, one file a micro-batch, in time order."""
    folder = new_folder(spark, "events")
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    days = [r.d for r in e.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]  # 30 days
    cut = [days[len(days) * i // 3] for i in (1, 2)] if len(days) >= 3 else []
    part = F.lit(0)
    for c in cut:
        part = part + (F.to_date("ts") >= F.lit(c)).cast("int")
    for i in range(len(cut) + 1):  # three files, so three flushes
        e.where(part == i).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query(ORACLES["fixed_window_limiter"])
def stream_limiter(spark, sf):
    """The limiter as a stream over three files: the last state of each user."""
    stream = _stream(spark, sf).select("user_id", F.unix_seconds("ts").alias("sec"))
    flushed = drained(spark, rate_limited(stream, 3600, 2), "limiter")
    return flushed.groupBy("user_id").agg(*[F.max_by(c, "batch").alias(c) for c in ("allowed", "rejected", "windows")])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, sf):
    """Counters by kind and hour, flushed at each micro-batch; the last flush of each counts."""
    flushed = drained(spark, count_kinds(_stream(spark, sf), "event_type", late="40 days"), "counts")
    last = flushed.groupBy(F.col("w.start").alias("hour"), "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")
