"""Dense ids and running sums over a whole table, without one task that sorts or scans it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.shared import new_folder, saved


def running_before(df: DataFrame, order: str, value: Column, name: str, parts: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all rows that come before in ``order`` (a unique number).

    Rows are ranged by ``order``; each range sums by itself and starts from the total of the ranges before it
    (one row a range).  The ranges are cut once, by exact bounds, so both passes see the same ones.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.select(F.percentile_approx(order, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    cuts = sorted(set(bounds or []))
    part = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col(order))) if cuts else F.lit(0)
    ranged = df.withColumn("_r", part).withColumn("_v", value)
    totals = ranged.groupBy("_r").agg(F.sum("_v").alias("_t"))
    before = totals.select("_r", F.coalesce(F.sum("_t").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.coalesce(F.sum("_v").over(Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(before), "_r").withColumn(name, own + F.col("_b")).drop("_r", "_v", "_b")


def _ranged(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` dealt into ranges of ``order`` and written once, with the number of its range in ``_r``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("_r", F.spark_partition_id())
    return saved(dealt, new_folder(df.sparkSession, name))


def numbered(df: DataFrame, order: list[Column], name: str, first: Column | int = 0) -> DataFrame:
    """Adds the place of each row in ``order`` (any types; a total order), counted from ``first``."""
    ranged = _ranged(df, order, "numbered")
    sizes = ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    start = first if isinstance(first, Column) else F.lit(first)
    place = F.row_number().over(Window.partitionBy("_r").orderBy(*order)) - 1
    return ranged.join(F.broadcast(before), "_r").withColumn(name, place + F.col("_b") + start).drop("_r", "_b")


def numbered_in(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds the place from 0 of each row in the ``order`` of its group and the group's size as ``<name>_of``.

    A group may hold any share of the table: rows are ranged by (group, order), so it spans many tasks, and
    each range starts from what the ranges before it hold of the group (a row for each group and range).
    """
    ranged = _ranged(df, [*map(F.col, group), *order], "numbered")
    sizes = ranged.groupBy(*group, "_r").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*group)
    told = sizes.select(*group, "_r", F.coalesce(F.sum("_n").over(own.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_n").over(own).alias(f"{name}_of"))
    told = told.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_r").alias("_p"), "_b", f"{name}_of")
    place = F.row_number().over(Window.partitionBy(*group, "_r").orderBy(*order)) - 1
    on = F.col("_r") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = ranged.withColumn("_i", place).join(told, on)
    return out.withColumn(name, F.col("_i") + F.col("_b")).drop("_r", "_p", "_b", "_i", *[f"_g{i}" for i in range(len(group))])


def average_ranked(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Adds ranks from 1 with ties averaged, inside each group: from counts of distinct values, so ties and large groups cost no task more."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    ranged = _ranged(counts, [*map(F.col, group), F.col(value)], "ranked")
    sizes = ranged.groupBy(*group, "_r").agg(F.sum("_c").alias("_n"))
    before = sizes.select(*group, "_r", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.coalesce(F.sum("_c").over(Window.partitionBy(*group, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = ranged.withColumn("_i", inside).join(before, [*group, "_r"])
    told = told.select(*group, value, (F.col("_i") + F.col("_b") + (F.col("_c") + 1) / 2).alias(name))
    return df.join(told, [*group, value])


def quantiles(df: DataFrame, group: list[str], value: str, at: list[float], names: list[str]) -> DataFrame:
    """Exact quantiles, linearly interpolated, of each group of any size: from ranged places, never a group in one buffer."""
    placed = numbered_in(df.where(F.col(value).isNotNull()).select(*group, value), group, [F.col(value)], "_at")
    out = []
    for q, name in zip(at, names):
        spot = (F.col("_at_of") - 1) * F.lit(q)
        low, share = F.floor(spot), spot - F.floor(spot)
        part = F.when(F.col("_at") == low, 1 - share).when(F.col("_at") == low + 1, share)
        out.append(F.sum(F.when(part > 0, F.col(value) * part)).alias(name))
    return placed.groupBy(*group).agg(*out)
