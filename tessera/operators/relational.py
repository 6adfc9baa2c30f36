"""Reusable relational steps: first and last record, source priority, outer merge, allocation, band join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """One row per key, the one that comes last; a partial aggregate, no window."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def first_wins(df: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def outer_merge(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Full outer merge on ``key`` in one shuffle: a nullable struct column for each source (last row wins).

    Each source has ``key``, ``seq`` and ``rec`` (a struct, the same for all).
    """
    tagged = None
    for name, df in sources.items():
        t = df.select(key, "seq", "rec", F.lit(name).alias("src"))
        tagged = t if tagged is None else tagged.unionByName(t)
    picks = [F.max_by(F.when(F.col("src") == n, F.col("rec")), F.when(F.col("src") == n, F.col("seq"))).alias(n) for n in sources]
    return tagged.groupBy(key).agg(*picks)


def by_priority(df: DataFrame, key: str, source: str, order: list[str], value: str) -> DataFrame:
    """(key, source, value): the first source in ``order`` that has something for the key."""
    rank = F.coalesce(*[F.when(F.col(source) == s, F.lit(i)) for i, s in enumerate(order)], F.lit(len(order)))
    return df.groupBy(key).agg(F.min_by(F.struct(source, value), F.struct(rank, F.col(value))).alias("r")).select(key, f"r.{source}", f"r.{value}")


def hash_order(key: Column, seed: str) -> Column:
    """A reproducible shuffle, portable to SQL."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def band_join(values: DataFrame, lines: DataFrame, value: str, center: str, width: float) -> DataFrame:
    """Rows of both within ``width``: an equi-join on buckets of that width (each line asks in three), then the exact test."""
    v = values.withColumn("_b", F.floor(F.col(value) / width))
    at = F.floor(F.col(center) / width)
    m = lines.withColumn("_b", F.explode(F.array(at - 1, at, at + 1)))
    return v.join(m, "_b").where(F.abs(F.col(value) - F.col(center)) <= width).drop("_b")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that must be unique on both sides, with n_left, n_right and n_joined; a repeated key is an error in its row."""
    tagged = left.select(key, F.struct(*left.columns).alias("l"), F.lit(None).cast(right.schema).alias("r")).unionByName(right.select(key, F.lit(None).cast(left.schema).alias("l"), F.struct(*right.columns).alias("r")))
    once = tagged.groupBy(key).agg(F.count("l").alias("nl"), F.count("r").alias("nr"), F.first("l", True).alias("l"), F.first("r", True).alias("r"))
    bad = F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("boolean")
    once = once.withColumn("ok", F.when((F.col("nl") > 1) | (F.col("nr") > 1), bad).otherwise(F.lit(True)))
    counts = once.agg(F.count_if((F.col("nl") > 0) & F.col("ok")).alias("n_left"), F.count_if(F.col("nr") > 0).alias("n_right"), F.count_if((F.col("nl") > 0) & (F.col("nr") > 0)).alias("n_joined"))
    rest = [c for c in right.columns if c != key]
    return once.where("nl > 0 AND nr > 0").crossJoin(F.broadcast(counts)).select("l.*", *[f"r.{c}" for c in rest], "n_left", "n_right", "n_joined")


def first_failure(reasons: dict[str, Column]) -> Column:
    """Name of the first test that a row fails, 'kept' if none."""
    out = None
    for name, bad in reasons.items():
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out.otherwise("kept")


def has_any(df: DataFrame, have: str, inputs: list[str], spectral: tuple[str, ...]) -> DataFrame:
    """Rows whose list of modalities holds any spectral one of ``inputs``."""
    wanted = [x for x in inputs if x in spectral]
    return df.where(F.arrays_overlap(have, F.array(*[F.lit(x) for x in wanted])) if wanted else F.lit(False))


def has_all(df: DataFrame, have: str, required: list[str], never: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose list of modalities holds all of ``required`` but those that never gate."""
    wanted = F.array(*[F.lit(x) for x in required if x not in never]).cast("array<string>")
    return df.where(F.size(F.array_except(wanted, have)) == 0)


def _known(df: DataFrame, column: str, what: str) -> None:
    if df.where(F.col(column).isNotNull()).limit(1).count() == 0:
        raise ValueError(f"the bank has no {what} to filter by")


def range_filter(df: DataFrame, column: str, lo: float | None, hi: float | None) -> DataFrame:
    """Both ends count, unknown values are kept; no bound keeps all, no value at all is an error."""
    if lo is None and hi is None:
        return df
    if lo is not None and hi is not None and lo > hi:
        raise ValueError("the lower bound exceeds the upper one")
    _known(df, column, column)
    ok = (F.col(column) >= lo if lo is not None else F.lit(True)) & (F.col(column) <= hi if hi is not None else F.lit(True))
    return df.where(F.col(column).isNull() | ok)


def count_filter(df: DataFrame, column: str, bounds: dict[str, tuple[int | None, int | None]]) -> DataFrame:
    """Rows of a count map with every element (absent: 0) within its bounds; unknown maps are kept, no map at all is an error."""
    if not bounds:
        return df
    for name, (lo, hi) in bounds.items():
        if lo is None and hi is None or lo is not None and hi is not None and lo > hi:
            raise ValueError(f"bounds of {name}: a minimum or a maximum, in order")
    _known(df, column, column)
    ok = F.lit(True)
    for name, (lo, hi) in bounds.items():
        n = F.coalesce(F.try_element_at(column, F.lit(name)), F.lit(0))
        ok = ok & (n >= lo if lo is not None else F.lit(True)) & (n <= hi if hi is not None else F.lit(True))
    return df.where(F.col(column).isNull() | ok)


def blanked(df: DataFrame, listed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` null where the key is listed, and whether it was."""
    marked = df.join(listed.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.col("_hit").isNotNull()
    return marked.select(*[F.when(~hit, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns], hit.alias("blanked"))


def dealt(place: Column, needs: list[tuple[str, int]], rest: str) -> Column:
    """The split of a place (from 0) in a shuffled pool: the first rows to each split as many as it needs, the rest to ``rest``."""
    out, top = None, 0
    for name, n in needs:
        top += n
        out = F.when(place < top, name) if out is None else out.when(place < top, name)
    return F.lit(rest) if out is None else out.otherwise(rest)


def stacked(parts: list[DataFrame]) -> DataFrame:
    """Shards of one shape laid together, repeats kept."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
