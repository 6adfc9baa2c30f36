"""Column expressions: parsing, clamping, interpolation, peak lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_number(c: str) -> Column:
    """The number that a text starts with, else null."""
    return F.regexp_extract(c, r"^-?\d+(?:\.\d+)?", 0).try_cast("double")


def range_midpoint(c: str) -> Column:
    """'a-b' -> the mean of both; one number -> itself; else null."""
    a = F.regexp_extract(c, r"^(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)$", 1).try_cast("double")
    b = F.regexp_extract(c, r"^(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)$", 2).try_cast("double")
    return F.coalesce((a + b) / 2, F.regexp_extract(c, r"^-?\d+(?:\.\d+)?$", 0).try_cast("double"))


def formula_counts(c: str) -> Column:
    """Element symbol -> count; a blank count is 1, repeated symbols add up."""
    symbols, counts = (F.regexp_extract_all(c, F.lit(r"([A-Z][a-z]?)(\d*)"), F.lit(i)) for i in (1, 2))
    pairs = F.zip_with(symbols, counts, lambda s, n: F.struct(s.alias("s"), F.when(n == "", 1).otherwise(n.try_cast("int")).alias("n")))
    names = F.array_sort(F.array_distinct(symbols))
    return F.map_from_arrays(names, F.transform(names, lambda e: F.aggregate(pairs, F.lit(0), lambda t, p: t + F.when(p["s"] == e, p["n"]).otherwise(0))))


def formula_vector(counts: str, vocabulary: list[str]) -> Column:
    """Counts in the vocabulary's order, and those of all other elements in a last slot."""
    known = F.array(*[F.coalesce(F.try_element_at(counts, F.lit(e)), F.lit(0)) for e in vocabulary])
    total = F.aggregate(F.map_values(counts), F.lit(0), lambda t, n: t + n)
    return F.concat(known, F.array(total - F.aggregate(known, F.lit(0), lambda t, n: t + n)))


def one_known_name(c: str, names: dict[str, str]) -> Column:
    """Class of the one known name in a free text; none or several: 'other'; blank: null."""
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(F.lower(c), F.lit(k)), F.lit(v)) for k, v in names.items()])))
    return F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", None).when(F.size(hits) == 1, F.try_element_at(hits, F.lit(1))).otherwise("other")


def band(c: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """Label of the first edge that the value lies under."""
    out = None
    for edge, name in edges:
        out = F.when(c < edge, name) if out is None else out.when(c < edge, name)
    return out.otherwise(last)


def interpolate(x: Column, grid: list[float], curve: list[float]) -> Column:
    """Piecewise linear through (grid, curve), held flat outside; the curve is a model, of fixed size."""
    out = F.when(x <= grid[0], F.lit(curve[0]))
    for (a, b), (p, q) in zip(zip(grid, grid[1:]), zip(curve, curve[1:])):
        out = out.when(x <= b, F.lit(p) + (x - a) * ((q - p) / (b - a)))
    return out.otherwise(F.lit(curve[-1]))


def normalise_peaks(peaks: str, least: float = 0.01, most: int = 100) -> Column:
    """array<struct<mz,i>>: base peak to 1, weak peaks dropped, the ``most`` strongest kept, by mz; no positive peak: unchanged."""
    top = F.array_max(F.transform(peaks, lambda p: p["i"]))
    scaled = F.filter(F.transform(peaks, lambda p: F.struct(p["mz"].alias("mz"), (p["i"] / top).alias("i"))), lambda p: p["i"] >= least)
    strongest = F.slice(F.sort_array(F.transform(scaled, lambda p: F.struct((-p["i"]).alias("o"), p["mz"].alias("mz"), p["i"].alias("i")))), 1, most)
    back = F.sort_array(F.transform(strongest, lambda p: F.struct(p["mz"].alias("mz"), p["i"].alias("i"))))
    return F.when(top > 0, back).otherwise(F.col(peaks))


def anchored_collapse(values: str, tolerance: float) -> Column:
    """Sorted values of which each kept one is more than ``tolerance`` above the last that was kept (a fold, not a lag)."""
    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), lambda kept, v: F.when((F.size(kept) == 0) | (v - F.coalesce(F.try_element_at(kept, F.lit(-1)), v) > tolerance), F.concat(kept, F.array(v))).otherwise(kept))


def fourier(x: Column, n: int) -> Column:
    """sin and cos of x at n octaves."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.array(F.sin(x * F.pow(F.lit(2.0), k)), F.cos(x * F.pow(F.lit(2.0), k)))))


def pad_to(values: str, n: Column) -> Column:
    return F.concat(values, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(values), F.lit(0)).cast("int")))
