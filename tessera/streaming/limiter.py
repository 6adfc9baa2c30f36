"""The anchored-window limiter as a stateful stream, counters by window, and runs over what a folder holds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.shared import new_folder

EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"
SCHEMA = "user_id long, allowed long, rejected long, windows long"


def rate_limited(stream: DataFrame, period: int, limit: int, key: str = "user_id", at: str = "sec", keep: int = 2) -> DataFrame:
    """Running (allowed, rejected, windows) per key; state is five numbers a key and goes ``keep`` periods after its last hit."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n, allowed, rejected, windows = state.get if state.exists else (-1, 0, 0, 0, 0)
        hits = sorted(int(t) for f in frames for t in f[at])
        for t in hits:
            if start < 0 or t - start >= period:
                start, n, allowed, windows = t, 1, allowed + 1, windows + 1
            elif n < limit:
                n, allowed = n + 1, allowed + 1
            else:
                rejected += 1
        state.update((start, n, allowed, rejected, windows))
        state.setTimeoutDuration(max(1, period) * 1000 * keep)
        yield pd.DataFrame({"user_id": [k[0]], "allowed": [allowed], "rejected": [rejected], "windows": [windows]})

    return stream.groupBy(key).applyInPandasWithState(fold, SCHEMA, "start long, n long, allowed long, rejected long, windows long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def count_kinds(stream: DataFrame, kind: str, late: str = "1 hour", width: str = "1 hour", at: str = "ts") -> DataFrame:
    """Events by kind and tumbling window, with a watermark for late ones."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))


def drained(spark: SparkSession, result: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Run a stream over all that its source holds now; (batch, result columns) of every flush, from the shared folder."""
    folder = new_folder(spark, name)

    def flush(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/flushed/part={batch}")

    kept = spark.conf.get(EMPTY)
    spark.conf.set(EMPTY, "false")  # a state with a timeout would ask for empty batches without end
    try:
        q = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(flush).start()
    finally:
        spark.conf.set(EMPTY, kept)
    q.awaitTermination()
    return spark.read.option("basePath", f"{folder}/flushed").parquet(f"{folder}/flushed/*").drop("part")
