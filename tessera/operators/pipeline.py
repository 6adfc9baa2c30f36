"""Dataset-build steps: report, provenance, split routing, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_split(df: DataFrame, path: str, by: str = "split", known: tuple[str, ...] = ("train", "val", "test")) -> None:
    """Route rows to one folder per split; an unknown split is an error.  A new version: nothing being read is overwritten."""
    checked = df.withColumn(by, F.when(F.col(by).isin(*known), F.col(by)).otherwise(F.raise_error(F.concat(F.lit("unknown split "), F.coalesce(F.col(by), F.lit("null"))))))
    checked.write.mode("errorifexists").partitionBy(by).parquet(path)


def shards(df: DataFrame, key: str, values: str) -> DataFrame:
    """(idx, data, shape): flattened rows sorted by id inside their files, for row-group skipping."""
    return df.select(F.col(key).cast("long").alias("idx"), F.col(values).alias("data"), F.array(F.size(values)).alias("shape")).sortWithinPartitions("idx")


def rebuilt(df: DataFrame, width: int) -> DataFrame:
    """Rows of ``width`` values back from flat data."""
    return df.select("idx", F.transform(F.sequence(F.lit(0), (F.size("data") / width).cast("int") - 1), lambda i: F.slice("data", i * width + 1, width)).alias("rows"))


def mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with their side; none if equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
