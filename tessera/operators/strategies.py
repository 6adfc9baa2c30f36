"""Vocabulary strategies by name: each turns entities into features, and its features into a bank.

A strategy is a class registered under a name; a name that nobody registered is an error.  All of
them yield (doc_id, feature, radius): what a feature is called, and how many neighbours it takes in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import features as op

_NAMED: dict[str, type["Strategy"]] = {}


def strategy(name: str, **options) -> "Strategy":
    """The strategy registered under ``name``."""
    if name not in _NAMED:
        raise NotImplementedError(f"no strategy {name!r}; there are {', '.join(sorted(_NAMED))}")
    return _NAMED[name](**options)


class Strategy:
    """Base of all strategies; ``radius`` says whether its features have one that a filter can use."""

    name = ""
    keyed_by_radius = False

    def __init__(self, max_radius: int = 0):
        self.max_radius = max_radius

    def __init_subclass__(cls) -> None:
        _NAMED[cls.name] = cls

    def features(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def within(self, features: DataFrame, radius: int) -> DataFrame:
        """Features up to a radius; strategies without one pass them all."""
        return features.where(F.col("radius") <= radius) if self.keyed_by_radius else features


class Thermometer(Strategy):
    """(token, level) features, as the bank has them."""

    name = "thermometer"

    def __init__(self, max_radius: int = 0, cap: int | None = 5):
        super().__init__(max_radius)
        self.cap = cap

    def features(self, docs: DataFrame) -> DataFrame:
        t = op.thermometer(op.multiset(docs), self.cap)
        return t.select("doc_id", F.concat_ws("#", "token", "k").alias("feature"), F.lit(0).alias("radius"))


class NGram(Strategy):
    """A word with up to ``max_radius`` words behind it."""

    name = "ngram"
    keyed_by_radius = True

    def features(self, docs: DataFrame) -> DataFrame:
        words = F.regexp_extract_all(F.lower("text"), F.lit(op.TOKEN), F.lit(0))

        def grams(r: int):
            starts = F.slice(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), F.lit(1), F.greatest(F.size("w") - r, F.lit(0)))
            return F.transform(starts, lambda i: F.struct(F.array_join(F.slice("w", i, F.lit(r + 1)), " ").alias("feature"), F.lit(r).alias("radius")))

        return docs.select("doc_id", words.alias("w")).select("doc_id", F.inline(F.concat(*map(grams, range(self.max_radius + 1)))))


def extracted(rows: DataFrame, key: str, extract: Callable[[str, dict], Iterator[str]], state: dict) -> DataFrame:
    """(key, feature) by a Python function of a key and a read-only state, for what columns can't express.

    The state is broadcast once and opened once a task; features are distinct per key.
    """
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        held = shared.value
        for b in batches:
            keys, feats = [], []
            for k in b.column(0).to_pylist():
                own = sorted(set(extract(k, held))) if k is not None else []
                keys += [k] * len(own)
                feats += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(feats, pa.string())], ["key", "feature"])

    return rows.select(F.col(key).cast("string").alias("key")).mapInArrow(run, "key string, feature string")
