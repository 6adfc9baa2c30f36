"""Evaluation over named combinations of inputs: generators, resumable runs, pooled reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.readers import exists

#: Inputs in canonical order, and the named spectral bases of an evaluation, fixed values.
INPUTS = ("hsqc", "c_nmr", "h_nmr", "mass_spec", "mass_spec_neg", "mw", "formula")
SPECTRAL = INPUTS[:5]
PAIRS = (("hsqc", "c_nmr"), ("hsqc", "h_nmr"), ("c_nmr", "h_nmr"))
DELTAS = ("mw", "formula")


def subsets(base: list[str], deltas: bool = False) -> dict[str, list[str]]:
    """Named subsets of a model's inputs, each cut to what the model has; with ``deltas`` the spectral ones again with a scalar added."""
    nmr, ms = ([x for x in group if x in base] for group in (INPUTS[:3], INPUTS[3:5]))
    out = {"all": list(base)}
    if nmr:
        out["nmr"] = nmr
    if ms:
        out["msms"] = ms
    out |= {x: [x] for x in SPECTRAL if x in base}
    out |= {f"{a}_{b}": [a, b] for a, b in PAIRS if a in base and b in base}
    if nmr and ms:
        out["nmr_msms"] = nmr + ms
    if nmr:
        out["nmr_mw_formula"] = nmr + [x for x in DELTAS if x in base]
    if deltas:
        single = [k for k in ("h_nmr", "c_nmr", "hsqc", *(f"{a}_{b}" for a, b in PAIRS), "nmr", "nmr_msms") if k in out]
        out |= {f"{k}_{x}": [*out[k], x] for k in single for x in reversed(DELTAS) if x in base}
    return out


def combinations_of(bases: dict[str, list[str]], everything: list[str] | None = None) -> dict[str, list[str]]:
    """Every base alone, with the formula and with the weight; all inputs first, if given."""
    out = {"all_inputs": list(everything)} if everything else {}
    for name, inputs in bases.items():
        out |= {name: list(inputs), f"{name}+formula": [*inputs, "formula"], f"{name}+mw": [*inputs, "mw"]}
    return out


def evaluated(spark: SparkSession, folder: str, combos: dict[str, list[str]], run: Callable[[list[str]], DataFrame]) -> DataFrame:
    """Per-item results of every combination, one folder each; a combination that is done is not run again."""
    for name, inputs in combos.items():
        if not exists(spark, f"{folder}/combo={name}/_SUCCESS"):
            run(inputs).write.mode("overwrite").parquet(f"{folder}/combo={name}")
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/combo={name}" for name in combos])


def summarised(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean_cos, strict/tie rank@1/5/10 in per cent) of items (cos, strict_rank, tie_rank)."""
    rate = lambda c, k: F.round(F.avg(F.when(F.col(f"{c}_rank") < k, 100.0).otherwise(0.0)), 2).alias(f"{c}_top{k}")
    return items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cos"), 4).alias("mean_cos"), *[rate(c, k) for c in ("strict", "tie") for k in (1, 5, 10)])


def averaged(reports: DataFrame, by: list[str], seed: str, values: list[str]) -> DataFrame:
    """Seeds' reports averaged; ``n`` is the first seed's, and 0 with null means if any seed has none."""
    g = reports.groupBy(*by).agg(F.min("n").alias("least"), F.min_by("n", seed).alias("first"), *[F.avg(v).alias(v) for v in values])
    return g.select(*by, F.when(F.col("least") == 0, F.lit(0)).otherwise(F.col("first")).cast("long").alias("n"), *[F.when(F.col("least") > 0, F.round(v, 6)).alias(v) for v in values])
