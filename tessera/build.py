"""Staged build: ``python -m tessera.build --data DIR --out DIR [--from S] [--to S] [--only S ...]``.

Each stage reads what the ones before it have written under ``--out`` and writes its own folder; a stage that
isn't asked for must be there already.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import features as fop
from tessera.operators import relational as rel
from tessera.operators.passages import verbatim
from tessera.operators.sinks import report


def _read(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{name}")


def records(spark, data, out):
    """One row per id, the last one wins; rows without text go."""
    d = spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL")
    return rel.last_wins(d, "doc_id", F.col("n_chars"), "text", "lang", "source")


def splits(spark, data, out):
    """Leaks to test, the others by their hash."""
    d = _read(spark, out, "records")
    leaks = verbatim(d, spark.read.parquet(f"{data}/benchmark.parquet")).select("doc_id").distinct().withColumn("leak", F.lit(True))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    return d.select("doc_id").join(leaks, "doc_id", "left").select("doc_id", F.when(F.col("leak") | (h == 9), "test").when(h == 8, "val").otherwise("train").alias("split"))


def vocabulary(spark, data, out):
    d = _read(spark, out, "records")
    return fop.vocabulary(fop.thermometer(fop.multiset(d)), d.count())


def rows(spark, data, out):
    d = _read(spark, out, "records")
    return fop.packed(d, fop.bank(fop.thermometer(fop.multiset(d)), _read(spark, out, "vocabulary")))


def verified(spark, data, out):
    """Counts that must agree: every record has a split and a row, and no row is without a record."""
    d, s, r = (_read(spark, out, n) for n in ("records", "splits", "rows"))
    lost = d.join(s, "doc_id", "left_anti").count() + d.join(r, "doc_id", "left_anti").count() + r.join(d, "doc_id", "left_anti").count()
    if lost:
        raise ValueError(f"{lost} rows of the build don't match")
    n = s.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("split") == "test").alias("test"), F.count_if(F.col("split") == "val").alias("val"))
    report(n, f"{out}/report.json")
    return n


STAGES: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {f.__name__: f for f in (records, splits, vocabulary, rows, verified)}


def chosen(first: str | None = None, last: str | None = None, only: list[str] | None = None) -> list[str]:
    """Names of the stages to run, in order; an unknown name or a reversed range is an error."""
    names = list(STAGES)
    for x in (first, last, *(only or [])):
        if x is not None and x not in names:
            raise ValueError(f"no stage {x!r}; there are {', '.join(names)}")
    if only:
        return [n for n in names if n in only]
    a, b = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
    if a > b:
        raise ValueError(f"{first} comes after {last}")
    return names[a : b + 1]


def run(spark: SparkSession, data: str, out: str, stages: list[str]) -> None:
    for name in stages:
        STAGES[name](spark, data, out).write.mode("overwrite").parquet(f"{out}/{name}")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--from", dest="first")
    p.add_argument("--to", dest="last")
    p.add_argument("--only", nargs="*")
    a = p.parse_args(args)
    run(SparkSession.builder.getOrCreate(), a.data, a.out, chosen(a.first, a.last, a.only))


if __name__ == "__main__":
    main()
