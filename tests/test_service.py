"""The in-process surface, the staged build, strategies and edge fixtures of filters and ranks."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import build, service
from tessera.functions.arrays import all_or_none
from tessera.functions.assignment import least_costs
from tessera.operators import bank as bk
from tessera.operators import features as fop
from tessera.operators import numbering, sinks, strategies
from tessera.operators import relational as rel
from tessera.operators import similarity as sim
from tessera.operators.limiter import limited
from tessera.operators.passages import verbatim
from tessera.operators.shared import new_folder


@pytest.fixture(scope="module")
def bank(spark):
    texts = ["alpha beta gamma", "alpha beta gamma", "alpha alpha delta", "", "beta delta epsilon zeta", None]
    return bk.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=64)


def test_engine(spark, bank):
    masses = spark.createDataFrame([(0, 10.0, {"C": 1}), (1, None, None), (2, 30.0, {"C": 5})], "doc_id long, mass double, elems map<string,int>")
    e = service.Engine(spark, bank, masses, predict_bits=lambda r: [0, 1])
    assert [r["doc_id"] for r in e.search("alpha beta gamma", 2)] == [0, 1]
    assert len(e.predict({"hsqc": [1.0, 2.0, None]}, k=9)) == 6  # fewer rows than k: all
    assert {r["doc_id"] for r in e.predict({"text": "alpha", "mw_min": 5, "mw_max": 20})} == {0, 1}  # unknown mass is kept
    assert {r["doc_id"] for r in e.predict({"text": "alpha", "formula": {"C": (2, None)}})} == {1, 2}
    card = e.card("alpha alpha nothing")
    assert card["n"] == len(card["features"]) and ("alpha", 2) in card["features"]
    told = e.explain(card["columns"], 0, limit=1)
    assert told["shown"] == 1 and told["available"] == sum(told["totals"].values())
    assert all("delta" not in r for r in e.refine(card["columns"], remove=["delta"], require=["beta"]))
    assert {r["doc_id"] for r in e.refine(card["columns"], require=["beta"])} == {0, 1, 4}
    for bad in ({}, {"hsqc": [1.0]}, {"hsqc": [None, 1.0, 1.0]}, {"hsqc": [1.0, 1.0, None, 1.0, 1.0, 2.0]}, {"mass_spec": [1.0]}, {"text": "x", "mw_min": 2, "mw_max": 1}):
        with pytest.raises(ValueError):
            e.predict(bad)
    with pytest.raises(KeyError):
        e.explain([0], 99)
    assert e.status()["rows"] == 6 and e.status()["used"]["predict"] >= 3


def test_admission_and_kept(spark):
    a = service.Admission(spark, workers=1, waiting=1, timeout=0.2)
    with a.slot("one"):
        with pytest.raises(service.Refused), a.slot("two"):
            pass
    full = service.Admission(spark, workers=1, waiting=0)
    with pytest.raises(service.Refused), full.slot("x"):
        pass
    kept = service.Kept(2)
    for key in "abca":
        kept.get(key, lambda: spark.range(1), pin=key == "a")
    assert set(kept.held) == {"a", "c"}


def test_staged_build(spark, tmp_path):
    data, out = "/root/testdata/sf0.001", f"file://{tmp_path}/out"
    assert build.chosen("splits", "rows") == ["splits", "vocabulary", "rows"] and build.chosen(only=["rows", "records"]) == ["records", "rows"]
    for bad in (("rows", "splits", None), ("none", None, None), (None, None, ["none"])):
        with pytest.raises(ValueError):
            build.chosen(*bad)
    build.run(spark, data, out, build.chosen())
    assert spark.read.parquet(f"{out}/rows").count() == spark.read.parquet(f"{out}/records").count()


def test_ranks_on_edges(spark):
    """Twins, a gold that shares nothing, an empty row: every row counts."""
    def bits(*columns):
        words = [0] * 16
        for c in columns:
            words[c >> 6] |= 1 << (c & 63)
        return [w - (1 << 64) if w >> 63 else w for w in words]

    rows = spark.createDataFrame([(0, bits(1, 2)), (1, bits(1, 2)), (2, bits(3)), (3, bits()), (4, bits(63, 64))], "doc_id long, bits array<long>")
    q = spark.createDataFrame([(10, bits(1, 2), 1.0), (11, bits(1), 0.0)], "qid long, bits array<long>, thr double")
    got = {r.qid: (r.at_least - 1, r.above, r.n) for r in sim.rank_counts(rows, q, "cosine", "doc_id", "bits", "qid", "thr").collect()}
    assert got == {10: (1, 0, 5), 11: (4, 2, 5)}
    back = {r.doc_id: r.c for r in rows.select("doc_id", fop.columns_of("bits").alias("c")).collect()}
    assert back == {0: [1, 2], 1: [1, 2], 2: [3], 3: [], 4: [63, 64]}


def test_filters_without_data_are_errors(spark):
    df = spark.createDataFrame([(1, None, None)], "doc_id long, mass double, elems map<string,int>")
    assert rel.range_filter(df, "mass", None, None).count() == 1
    with pytest.raises(ValueError):
        rel.range_filter(df, "mass", 1.0, None)
    with pytest.raises(ValueError):
        rel.count_filter(df, "elems", {"C": (1, None)})
    with pytest.raises(ValueError):
        rel.count_filter(df, "elems", {"C": (None, None)})


def test_lookup_misses_and_unknown_names(spark, bank):
    stored = bk.write_postings(bank, bank.rows.select("doc_id", F.lit("train").alias("split")), new_folder(spark, "postings"))
    assert bk.lookup(stored, bank.rows).count() == 6
    with pytest.raises(Exception, match="no such key"):
        bk.lookup(stored, spark.createDataFrame([(77,)], "doc_id long")).collect()
    with pytest.raises(NotImplementedError):
        strategies.strategy("nope")
    with pytest.raises(Exception, match="unknown split"):
        spark.createDataFrame([("odd",)], "split string").select(sinks.routed("split")).collect()
    with pytest.raises(Exception, match="repeated key"):
        twice = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
        rel.one_to_one(twice, twice.select("k").distinct().withColumn("w", F.lit(1)), "k").collect()
    assert sorted(r.feature for r in strategies.extracted(spark.createDataFrame([("ab",), (None,)], "key string"), "key", lambda k, s: (c + s["x"] for c in k), {"x": "!"}).collect()) == ["a!", "b!"]


def test_short_passages(spark):
    docs = spark.createDataFrame([(0, "xx aa bb cc yy"), (1, "xaa bb ccy"), (2, "aa"), (3, None), (4, "one two three four fives")], "doc_id long, text string")
    items = spark.createDataFrame([(0, "aa bb cc"), (1, "aa"), (2, "two three four five"), (3, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in verbatim(docs, items).collect())
    assert got == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 1), (4, 2)]


def test_places_in_large_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v), i) for i, (g, v) in enumerate(zip(rng.choice([0, 0, 0, 1, 2], 700), rng.integers(0, 40, 700)))] + [(None, 1.0, 900), (None, 0.0, 901)]
    df = spark.createDataFrame(rows, "g int, v double, i long")
    got = {r.i: (r.p, r.p_of) for r in numbering.numbered_in(df, ["g"], [F.col("v"), F.col("i")], "p").collect()}
    for g in (0, 1, 2, None):
        own = sorted((v, i) for gg, v, i in rows if gg == g)
        assert [got[i] for _, i in own] == [(k, len(own)) for k in range(len(own))]
    q = {r.g: (r.a, r.b) for r in numbering.quantiles(df.where("g IS NOT NULL"), ["g"], "v", [0.1, 0.5], ["a", "b"]).collect()}
    for g in (0, 1, 2):
        own = [v for gg, v, _ in rows if gg == g]
        assert np.allclose(q[g], np.quantile(own, [0.1, 0.5]))


def test_limiter_against_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(int(u), int(t)) for u, t in zip(rng.choice([1, 1, 1, 2, 3], 900), rng.integers(0, 500, 900))] + [(None, 3), (4, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {r.u: (r.allowed, r.rejected, r.windows) for r in limited(spark.createDataFrame(rows, "u long, t long"), "u", "t", 20, 3).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for u in (1, 2, 3):
        hits, start, n, ok, no, w = sorted(t for x, t in rows if x == u), None, 0, 0, 0, 0
        for t in hits:
            if start is None or t - start >= 20:
                start, n, ok, w = t, 1, ok + 1, w + 1
            elif n < 3:
                n, ok = n + 1, ok + 1
            else:
                no += 1
        assert got[u] == (ok, no, w)


def test_assignment_against_all_choices():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (2, 4), (3, 3), (3, 6)):
        a, b = np.sort(rng.integers(0, 30, (5, n)).astype(float), 1), np.sort(rng.integers(0, 30, (5, m)).astype(float), 1)
        best = [min(sum(abs(x - y) for x, y in zip(p, c)) for c in itertools.permutations(q, n)) for p, q in zip(a, b)]
        assert np.allclose(least_costs(a, b), best)


def test_all_or_none(spark):
    df = spark.createDataFrame([([True, True],), ([False],), ([True, False],), ([],)], "f array<boolean>")
    assert [r[0] for r in df.select(all_or_none(F.col("f"))).collect()] == [True, True, False, True]
