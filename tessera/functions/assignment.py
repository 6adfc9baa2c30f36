"""Optimal assignment of sorted lists, the normal tail, reference clean-up."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def least_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the least sum of distances that puts every value of ``a`` on a value of ``b`` of its own.

    Both have a row per problem, ascending, ``a`` no wider than ``b``.
    """
    cost = np.zeros((len(b), b.shape[1] + 1))  # cost[:, j]: the values so far on the first j of b
    for i in range(a.shape[1]):
        step = np.full_like(cost, np.inf)
        step[:, 1:] = cost[:, :-1] + np.abs(b - a[:, i : i + 1])
        cost = np.minimum.accumulate(step, axis=1)
    return cost[:, -1]


def _assign(a: pa.Array, b: pa.Array) -> pa.Array:
    """Problems of one shape are solved together."""
    rows = [sorted(([v for v in x or [] if v is not None], [v for v in y or [] if v is not None]), key=len) for x, y in zip(a.to_pylist(), b.to_pylist())]
    shapes, out = defaultdict(list), np.full(len(rows), np.nan)
    for i, (x, y) in enumerate(rows):
        if x:
            shapes[len(x), len(y)].append(i)
    for at in shapes.values():
        out[at] = least_costs(np.sort(np.array([rows[i][0] for i in at], float), 1), np.sort(np.array([rows[i][1] for i in at], float), 1))
    return pa.array(out, pa.float64(), from_pandas=True)


def assignment_cost(a: str, b: str) -> Column:
    """Cost of the best one-to-one assignment of the shorter list to the longer; null where either has no value."""

    def cost(x: pa.Array, y: pa.Array) -> pa.Array:
        return _assign(x, y)

    cost.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(cost, "double")(a, b)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0: a series of positive terms below 3, a continued fraction above."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(x.alias("t"), x.alias("s")),
        lambda acc, n: F.struct((acc["t"] * 2 * x * x / (2 * n + 1)).alias("t"), (acc["s"] + acc["t"] * 2 * x * x / (2 * n + 1)).alias("s")),
        lambda acc: acc["s"],
    )
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda acc, n: x + n / 2.0 / acc)
    bell = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x < 3, 1 - 2 * bell * terms).otherwise(bell / tail)


def two_sided_p(t: str) -> Column:
    """Two-sided normal tail beyond ``t``."""
    return erfc(F.abs(F.col(t)) / math.sqrt(2))


def cleaned_reference(text: Column) -> Column:
    """A reference cut at its first entity, without trailing marks, its closing brackets balanced."""
    marks = r"[.,;:]+$"

    def balanced(s: Column, opening: str, closing: str) -> Column:
        count = lambda v, c: F.length(v) - F.length(F.replace(v, F.lit(c), F.lit("")))
        over = lambda v: F.endswith(v, F.lit(closing)) & (count(v, closing) > count(v, opening))
        steps = F.sequence(F.lit(0), count(s, closing))  # each takes off one bracket at most
        return F.aggregate(steps, s, lambda v, _: F.when(over(v), F.regexp_replace(F.substring(v, F.lit(1), F.length(v) - 1), marks, "")).otherwise(v))

    return balanced(balanced(F.regexp_replace(F.substring_index(text, "&", 1), marks, ""), "(", ")"), "[", "]")
