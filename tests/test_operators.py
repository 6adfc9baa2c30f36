"""Small fixtures for edge semantics."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import expressions as ex
from tessera.operators import bank as bk
from tessera.operators import features as fop
from tessera.operators import relational as rel
from tessera.operators.limiter import limited
from tessera.operators.numbering import running_before
from tessera.operators.pipeline import write_split
from tessera.plans.retrieval import in_counts, in_range


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()[0]


def test_collapse_is_anchored(spark):
    assert one(spark, [1.0003, 1.0, 1.00015, 1.00005], "array<double>", ex.anchored_collapse("x", 1e-4)) == [1.0, 1.00015, 1.0003]


def test_peaks_without_a_positive_one_stay(spark):
    kind = "array<struct<mz:double,i:double>>"
    assert one(spark, [(1.0, 0.0), (2.0, -1.0)], kind, ex.normalise_peaks("x")) == [(1.0, 0.0), (2.0, -1.0)]
    assert one(spark, [], kind, ex.normalise_peaks("x")) == []
    assert one(spark, [(3.0, 50.0), (2.0, 100.0), (1.0, 0.5)], kind, ex.normalise_peaks("x")) == [(2.0, 1.0), (3.0, 0.5)]


@pytest.mark.parametrize("formula,counts", [("C10H12N2OCl", {"C": 10, "H": 12, "N": 2, "O": 1, "Cl": 1}), ("CH3CH3", {"C": 2, "H": 6}), ("", {})])
def test_formula(spark, formula, counts):
    assert one(spark, formula, "string", ex.formula_counts("x")) == counts


def test_unknown_values_pass_the_filters(spark):
    assert one(spark, None, "double", in_range("x", 1.0, 2.0)) is True
    assert one(spark, None, "map<string,int>", in_counts("x", {"C": (1, 2)})) is True
    assert one(spark, {"H": 1}, "map<string,int>", in_counts("x", {"C": (1, 2)})) is False


def test_interpolation_is_flat_outside(spark):
    for x, y in ((-1.0, 0.1), (0.0, 0.1), (0.5, 0.3), (1.0, 0.5), (9.0, 0.5)):
        assert one(spark, x, "double", ex.interpolate(F.col("x"), [0.0, 1.0], [0.1, 0.5])) == pytest.approx(y)


def test_solvent_names(spark):
    names = {"cdcl3": "CDCl3", "cd3od": "CD3OD", "dmso": "DMSO-d6"}
    for text, want in (("CDCl3-CD3OD (9:1)", "other"), ("", None), (None, None), ("DMSO-d6", "DMSO-d6"), ("water", "other")):
        assert one(spark, text, "string", ex.one_known_name("x", names)) == want


def test_limiter_restarts_at_the_first_hit_after_expiry(spark):
    h = spark.createDataFrame([(1, t) for t in (0, 10, 20, 3599, 3600, 7300)], "u long, t long")
    assert tuple(limited(h, "u", "t", 3600, 2).first()) == (1, 4, 2, 3)


def test_running_sum_crosses_ranges(spark):
    df = spark.range(1, 101).withColumn("v", F.col("id"))
    got = {r.id: r.b for r in running_before(df, "id", F.col("v"), "b", 7).collect()}
    assert got == {i: i * (i - 1) // 2 for i in range(1, 101)}


def test_last_and_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, s int, v string")
    assert sorted(map(tuple, rel.last_wins(df, "k", F.col("s"), "v").collect())) == [("a", "y"), ("b", None)]
    assert sorted(map(tuple, rel.first_wins(df, "k", F.col("s"), "v").collect())) == [("a", "x"), ("b", None)]


def test_unknown_split_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "odd")], "i int, split string")
    with pytest.raises(Exception, match="unknown split"):
        write_split(df, str(tmp_path / "out"))


def test_band_join_meets_across_buckets(spark):
    v = spark.createDataFrame([(0.95,), (1.05,), (1.31,)], "v double")
    c = spark.createDataFrame([(1.0,), (1.2,)], "c double")
    assert sorted(map(tuple, rel.band_join(v, c, "v", "c", 0.1).collect())) == [(0.95, 1.0), (1.05, 1.0)]


def test_stream_matches_batch(spark, tmp_path):
    from tessera.streaming.limiter import drained, rate_limited

    rows = [(u, t) for u in (1, 2) for t in (0, 5, 9, 100, 103, 104)]
    spark.createDataFrame(rows, "user_id long, sec long").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("user_id long, sec long").parquet(str(tmp_path / "in"))
    flushed = drained(spark, rate_limited(s, 100, 2), "limited")
    last = flushed.groupBy("user_id").agg(*[F.max_by(c, "batch").alias(c) for c in ("allowed", "rejected", "windows")])
    batch = limited(spark.createDataFrame(rows, "user_id long, sec long"), "user_id", "sec", 100, 2)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def test_assignment_and_references(spark):
    from itertools import permutations
    from random import Random

    from tessera.functions.assignment import assignment_cost, cleaned_reference

    rng, rows = Random(3), []
    for i in range(40):
        rows.append((i, *([rng.random() * 9 for _ in range(rng.randint(1, 5))] for _ in range(2))))
    df = spark.createDataFrame([*rows, (40, [], [1.0]), (41, None, [1.0]), (42, [2.0, None], [1.0])], "i int, a array<double>, b array<double>")
    got = {r.i: r.c for r in df.select("i", assignment_cost("a", "b").alias("c")).collect()}
    for i, a, b in rows:
        s, t = sorted((a, b), key=len)
        assert got[i] == pytest.approx(min(sum(abs(x - y) for x, y in zip(s, p)) for p in permutations(t, len(s))))
    assert got[40] is None and got[41] is None and got[42] == 1.0
    refs = spark.createDataFrame([("10.1/x(1).)",), (None,), ("10.1/y)).,&amp;z",), ("[a]]",)], "t string")
    assert [r[0] for r in refs.select(cleaned_reference(F.col("t"))).collect()] == ["10.1/x(1)", None, "10.1/y", "[a]"]


def test_unique_occurrences_are_counted_in_the_row(spark):
    docs = spark.createDataFrame([(1, "Aaa bbb aaa\nccc\naaa bbb aaa\naaa"), (2, ""), (3, None)], "doc_id long, text string")
    got = fop.unique_occurrences(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, "aaa", 2), (1, "bbb", 1), (1, "ccc", 1)]


def test_unique_occurrences_of_ids_with_several_rows(spark, monkeypatch):
    rows = [(1, "aaa\nbbb aaa"), (1, "aaa\naaa ccc"), (1, "aaa"), (2, "aaa"), (None, "aaa\nddd"), (None, "aaa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, "aaa", 3), (1, "bbb", 1), (1, "ccc", 1), (2, "aaa", 1), (None, "aaa", 1), (None, "ddd", 1)}
    for most in (fop.BROADCAST_ROWS, 0):
        monkeypatch.setattr(fop, "BROADCAST_ROWS", most)
        got = list(map(tuple, fop.unique_occurrences(docs).collect()))
        assert len(got) == len(want) and set(got) == want


def test_augmented_rows_whose_new_keys_the_bank_has(spark, tmp_path):
    import duckdb

    from tessera import registry

    texts = ["aaa bbb aaa", "ccc the", None, "", "bbb and and", "ddd eee"]
    rows = [(4 * i + far, t) for far in (0, 100_000) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.queries()["bank_augmented"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(c.sql(registry.oracle_sql()["bank_augmented"]).fetchall())
    assert len(got) == 10  # null texts have no row
    bank = bk.bank_of(spark, str(tmp_path))
    new = spark.createDataFrame([(0, "aaa"), (7_777, "bbb")], "doc_id long, text string")
    assert [r.doc_id for r in bk.extended(bank, new).collect()] == [7_777]
    assert sorted(r.doc_id for r in bk.under(bank, new).collect()) == [0, 7_777]


def test_attribution_of_occurrences_without_positions(spark, tmp_path):
    import duckdb

    from tessera import registry

    rows = [(1, 0, 0.1), (1, -2, 0.1), (1, 1, 0.07), (1, 7, 0.02), (2, 0, 0.1), (3, None, 0.1), (4, 2, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["atom_attribution"](spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, c.sql(registry.oracle_sql()["atom_attribution"]).fetchall()))
