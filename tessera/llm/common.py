"""What the operators share: scratch tables in the cluster's shared folder, batching, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Graphs of at most this many edges are closed by one task (16 MB of edges); larger ones are contracted first.
FINISH_EDGES = 1_000_000
#: Arrow batches end at this size as well as at their number of rows, so that long texts don't make huge ones.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written for one call, under a folder of its own in the shared folder.

    Writing and rereading cuts lineage and survives lost executors.  ``drop`` frees a table once
    nothing that is still to run reads it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        if spark.conf.get(BATCH_CONF) == "67108864b":  # only Spark's own default is lowered
            spark.conf.set(BATCH_CONF, BATCH_BYTES)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def tidy(run):
    """A ``mapInArrow`` function that hands its memory back when its task ends; workers outlive tasks and take turns."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not every C library has it
            pass

    return tidied


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column's values; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


# ---------------------------------------------------------------- connected components


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of the edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))
    half = len(u)
    for a, b in zip(at[:half].tolist(), at[half:].tolist()):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    root = np.asarray(parent, dtype=np.int64)
    while len(root) and not np.array_equal(root, jumped := root[root]):
        root = jumped
    return nodes, nodes[root] if len(nodes) else nodes


def forest(batches):
    """Edges of one partition -> a star for each component that they form; bounded by windows of edges."""
    us, vs, held = [], [], 0

    def flush():
        nodes, root = union_find(np.concatenate(us), np.concatenate(vs))
        keep = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(root[keep]), pa.array(nodes[keep])], ["u", "v"])

    for b in batches:
        us.append(b.column(0).to_numpy(zero_copy_only=False))
        vs.append(b.column(1).to_numpy(zero_copy_only=False))
        held += b.num_rows
        if held >= FINISH_EDGES:
            yield flush()
            us, vs, held = [], [], 0
    if held:
        yield flush()


def _roots(batches):
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for b in batches:
        us.append(b.column(0).to_numpy(zero_copy_only=False))
        vs.append(b.column(1).to_numpy(zero_copy_only=False))
    nodes, root = union_find(np.concatenate(us), np.concatenate(vs))
    for s in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[s : s + 50_000]), pa.array(root[s : s + 50_000])], ["node", "root"])


def connected_components(edges: DataFrame, scratch: Scratch, finish_edges: int = FINISH_EDGES, stars: bool = False) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long); root is some node of the component.

    ``stars``: whoever made the edges has put them through ``forest`` already, in the same worker.

    Each round replaces a partition's edges by stars, hooks every node to the neighbour that comes
    first in an order salted by the round, and contracts: at least half the nodes that are not first
    among their neighbours go, whatever the graph's shape, so rounds grow with the logarithm of its
    size.  When no more than ``finish_edges`` edges are left, one task closes the rest.
    """
    spark, n = scratch.spark, 0
    parts = shuffle_partitions(spark)
    e = scratch.save(edges if stars else edges.where("u <> v").mapInArrow(tidy(forest), "u long, v long"), "edges0")
    maps: list[DataFrame] = []
    while (left := e.count()) > finish_edges:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(n)).alias("h"), F.col("v").alias("to"))).alias("m"))
        own = F.xxhash64("u", F.lit(n))
        hook = scratch.save(first.select(F.col("u").alias("node"), F.when((F.col("m.h") < own) | ((F.col("m.h") == own) & (F.col("m.to") < F.col("u"))), F.col("m.to")).otherwise(F.col("u")).alias("root")), f"hook{n}")
        maps.append(hook)
        moved = e.join(hook.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").join(hook.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
        moved = moved.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        e = scratch.save(moved.mapInArrow(tidy(forest), "u long, v long"), f"edges{n + 1}")
        scratch.drop(f"edges{n}")
        n += 1
    last = scratch.save(e.coalesce(1).mapInArrow(tidy(_roots), "node long, root long"), "roots") if left else None
    out = None
    for m in maps:
        out = m if out is None else scratch.save(out.join(m.select(F.col("node").alias("root"), F.col("root").alias("r2")), "root", "left").select("node", F.coalesce("r2", "root").alias("root")).repartition(parts, "node"), f"map{len(maps)}-{id(m)}")
    if last is None:
        return out if out is not None else e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if out is None:
        return last
    return out.join(last.select(F.col("node").alias("root"), F.col("root").alias("r2")), "root", "left").select("node", F.coalesce("r2", "root").alias("root"))
