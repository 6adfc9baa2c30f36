"""Tables kept in the cluster's shared folder: what is read again is written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to a new folder and read it back: cuts lineage and survives lost executors."""
    out = df.write.mode("errorifexists")
    (out.partitionBy(*by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def signature(spark: SparkSession, *paths: str) -> str:
    """What tells whether files have changed: names, lengths and times of everything under the paths."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(conf).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return repr(sorted(out))
