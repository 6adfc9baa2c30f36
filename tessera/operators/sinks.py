"""Sinks: routed writes, versions swapped by a pointer, packed stores, reports, best-effort caches."""

from __future__ import annotations

import json
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.numbering import running_before
from tessera.operators.shared import saved
from tessera.sources.readers import exists

SPLITS = ("train", "val", "test")


def routed(column: str, known: tuple[str, ...] = SPLITS) -> Column:
    """The split of a row; one that isn't known is an error in its row."""
    c = F.col(column)
    return F.when(c.isin(*known), c).otherwise(F.raise_error(F.concat(F.lit("unknown split "), F.coalesce(c, F.lit("null")))))


def write_jsonl(df: DataFrame, path: str, by: str = "split", known: tuple[str, ...] = SPLITS) -> None:
    """JSON lines in a folder for each split."""
    df.withColumn(by, routed(by, known)).write.mode("errorifexists").partitionBy(by).json(path)


def write_shards(df: DataFrame, path: str, by: tuple[str, ...] = ("split", "modality")) -> DataFrame:
    """(idx, data, shape) in a folder for each split and modality; a modality without rows has none."""
    return saved(df.sortWithinPartitions(*by, "idx"), path, by)


def commit(df: DataFrame, root: str) -> str:
    """Write a new version under ``root`` and make it the current one by renaming a pointer file; what is being read is never touched."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root}/{version}")
    _put(spark, f"{root}/current", version)
    return version


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed into it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    at = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = to.getFileSystem(conf)
    out = files.create(at)
    out.write(text.encode())
    out.close()
    if files.exists(to):
        files.delete(to, False)
    if not files.rename(at, to):
        raise OSError(f"{path} can't be replaced")


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that the pointer names."""
    version = spark.read.text(f"{root}/current", wholetext=True).first()[0]
    return spark.read.parquet(f"{root}/{version}")


def cached(df: DataFrame, path: str) -> DataFrame:
    """Best effort: write and read back, or go on with ``df`` and a warning."""
    try:
        return saved(df, path)
    except Exception as e:  # a cache that can't be written is no failure
        warnings.warn(f"{path} is not written: {e.__class__.__name__}", stacklevel=2)
        return df


def pack(shards: DataFrame, path: str) -> DataFrame:
    """(idx, start, data) sorted by idx, ``start`` being where a row's data begins when all are laid end to end; a pack that is there is kept."""
    spark = shards.sparkSession
    if exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    placed = running_before(shards.select("idx", "data", "shape"), "idx", F.size("data").cast("long"), "start")
    return saved(placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "idx").sortWithinPartitions("idx"), path)


def open_store(spark: SparkSession, folder: str) -> DataFrame:
    """(idx, data, shape) of a store: its pack where there is one, else its shards."""
    packed = f"{folder}/packed"
    return spark.read.parquet(packed if exists(spark, f"{packed}/_SUCCESS") else f"{folder}/shards").select("idx", "data", "shape")


def squeezed(df: DataFrame) -> DataFrame:
    """(idx, json): rows of a (n, d) shard rebuilt, a list of numbers where d is 1."""
    d, n = F.col("shape")[1], F.col("shape")[0]
    rows = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("data", i * d + 1, d))).otherwise(F.array().cast("array<array<double>>"))
    whole = F.to_json(F.struct(rows.alias("v")))
    flat = F.to_json(F.struct(F.col("data").alias("v")))
    return df.select("idx", F.get_json_object(F.when(d == 1, flat).otherwise(whole), "$.v").alias("json"))


def report(counts: DataFrame, path: str) -> dict:
    """One row of counts as a JSON file; gives it back."""
    row = json.loads(counts.select(F.to_json(F.struct(*counts.columns)).alias("j")).first().j)
    _put(counts.sparkSession, path, json.dumps(row, sort_keys=True, indent=1))
    return row


def write_listing(df: DataFrame, folder: str, order: list[Column], title: str = "Queue") -> None:
    """An ordered listing as CSV, as plain text and as a Markdown table, each in a folder of its own."""
    rows = df.orderBy(*order)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    escaped = [F.replace(c, F.lit("|"), F.lit("\\|")) for c in text]
    rows.write.csv(f"{folder}/csv", header=True)
    rows.select(F.concat_ws("\t", *text).alias("value")).write.text(f"{folder}/txt")
    head = df.sparkSession.createDataFrame([(f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'-|' * len(df.columns)}",)], "value string")
    head.coalesce(1).write.text(f"{folder}/md/head")
    rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *escaped), F.lit(" |")).alias("value")).write.text(f"{folder}/md/rows")
