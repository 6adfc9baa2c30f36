"""Column expressions over flat and packed arrays: spectra, element counts, labels, maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the element slots of a formula vector; the last takes all other elements
ELEMENTS = "H C O N S Cl Br P F I Si B Se As Fe Mg Co Na Te V Al Zn Sn Au Mo Cu W Ni Bi Ga K Pb Ca Gd Sb Sr Ru Ho Cr".split()
#: Codes of the streams that ``stacked`` lays end to end.
STREAMS = ("hsqc", "c_nmr", "h_nmr", "mass_spec")


def _groups(flat: Column, width: int, of) -> Column:
    """One array element for every ``width`` numbers; ``of`` gets the place of the first."""
    n = (F.size(flat) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: of(i * width)))


def reordered(flat: Column) -> Column:
    """Triplets (h, c, i) laid flat -> (c, h, i); a null intensity becomes 0."""
    out = _groups(flat, 3, lambda i: F.array(flat[i + 1], flat[i], F.coalesce(flat[i + 2], F.lit(0.0))))
    return F.coalesce(F.flatten(out), F.array().cast("array<double>"))


def stacked(streams: dict[str, tuple[Column, int]]) -> Column:
    """array<struct<a, b, c, type>>: flat streams of 1, 2 or 3 numbers a peak, padded with 0 and marked with their code."""
    kind = "array<struct<a:double,b:double,c:double,type:int>>"
    parts = []
    for name, (flat, width) in streams.items():
        cell = lambda i, k, flat=flat, width=width: F.coalesce(flat[i + k], F.lit(0.0)).cast("double") if k < width else F.lit(0.0)
        rows = _groups(flat, width, lambda i, cell=cell, name=name: F.struct(cell(i, 0).alias("a"), cell(i, 1).alias("b"), cell(i, 2).alias("c"), F.lit(STREAMS.index(name)).alias("type")))
        parts.append(F.coalesce(rows, F.array().cast(kind)))
    return F.concat(*parts)


def signed_rows(peaks: str) -> Column:
    """array<struct<h, c, sign>> of struct<h, c, kind>: CH2 counts negative, all else positive."""
    return F.transform(peaks, lambda p: F.struct(p["h"].alias("h"), p["c"].alias("c"), F.when(p["kind"] == "CH2", -1).otherwise(1).alias("sign")))


def complete_rows(peaks: str) -> Column:
    """Rows of struct<h, c, i> whose two shifts are finite numbers."""
    return F.filter(peaks, lambda p: finite(p["h"]) & finite(p["c"]))


def all_or_none(flags: Column) -> Column:
    """Whether all or none of an array of booleans hold."""
    return F.forall(flags, lambda x: x) | ~F.exists(flags, lambda x: x)


def coverage(found: Column, distinct: Column) -> Column:
    """found / distinct, 1 where there is nothing to cover."""
    return F.when(distinct > 0, found / distinct).otherwise(1.0)


def from_indices(indices: Column, width: int) -> Column:
    """Indices -> an array of 0 and 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_contains(indices, i).cast("int"))


def nonzero(dense: Column) -> Column:
    """Places of what isn't zero, ascending."""
    return F.filter(F.transform(dense, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())


def at_maximum(values: Column) -> Column:
    """1 where an array has its largest value, else 0."""
    return F.transform(values, lambda x: (x == F.array_max(values)).cast("int"))


def labels_of(ids: Column, table: Column) -> Column:
    """Interned labels back to text; an id outside the table is an error."""
    bad = lambda i: F.raise_error(F.concat(F.lit("no label "), i.cast("string"))).cast("string")
    return F.transform(ids, lambda i: F.when((i < 0) | (i >= F.size(table)), bad(i)).otherwise(table[i]))


def union_largest(a: str, b: str) -> Column:
    """Union of two count maps, the larger count where both have a key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def finite(x: Column) -> Column:
    return F.coalesce(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False))


def guarded(x: Column, lo: float, hi: float, otherwise: float = 0.0) -> Column:
    """Clamped to [lo, hi]; null and non-finite values become ``otherwise``."""
    return F.when(finite(x), F.least(F.greatest(x.cast("double"), F.lit(lo)), F.lit(hi))).otherwise(otherwise)


def set_similarity(a: str, b: str) -> Column:
    """Jaccard similarity of two column sets; of two empty ones 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
