"""Filters with error rules, request validation, hygiene and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as ar
from tessera.functions import checks as ck
from tessera.operators import bank as bk
from tessera.operators import features as fop
from tessera.operators import relational as rel
from tessera.operators.bank import bank_of
from tessera.operators.numbering import numbered
from tessera.plans.features import BANK, TOK, docs
from tessera.plans.retrieval import in_counts, in_range, part_bank
from tessera.registry import query
from tessera.sources.tables import table

MODS = "m AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'val' ELSE 'train' END AS split, list_filter([CASE WHEN p_size % 2 = 0 THEN 'hsqc' END, CASE WHEN p_size % 3 = 0 THEN 'c_nmr' END, CASE WHEN p_size % 5 = 0 THEN 'mass_spec' END, CASE WHEN p_size % 7 < 4 THEN 'mw' END, CASE WHEN p_size > 10 THEN 'formula' END], lambda x: x IS NOT NULL) AS mods FROM part)"


def modalities(spark, sf):
    """(p_partkey, split, mods): parts with the list of inputs that they have."""
    s = F.col("p_size")
    mods = F.array_compact(F.array(F.when(s % 2 == 0, "hsqc"), F.when(s % 3 == 0, "c_nmr"), F.when(s % 5 == 0, "mass_spec"), F.when(s % 7 < 4, "mw"), F.when(s > 10, "formula")))
    return table(spark, sf, "part").select("p_partkey", F.when(s % 10 == 0, "val").otherwise("train").alias("split"), mods.alias("mods"))


@query(f"WITH {MODS} SELECT p_partkey FROM m WHERE split = 'train' AND len(list_intersect(mods, ['hsqc', 'c_nmr'])) > 0")
def rows_with_any_input(spark, sf):
    """Rows of a split that have any of the spectral inputs."""
    return rel.has_any(modalities(spark, sf).where("split = 'train'"), "mods", ["hsqc", "c_nmr", "mw"], ck.SPECTRAL).select("p_partkey")


@query(f"WITH {MODS} SELECT p_partkey FROM m WHERE list_has_all(mods, ['hsqc', 'mw'])")
def rows_with_all_inputs(spark, sf):
    """Rows that have every required input; a formula never gates."""
    return rel.has_all(modalities(spark, sf), "mods", ["hsqc", "mw", "formula"], ("formula",)).select("p_partkey")


@query(f"WITH {MODS} SELECT p_partkey, array_to_string(list_filter(mods, lambda x: x IN ('hsqc', 'mw')), '+') AS kept FROM m WHERE list_contains(mods, 'hsqc')")
def restricted_records(spark, sf):
    """Records cut to some of their inputs; those left without a spectral one are skipped."""
    m = modalities(spark, sf).withColumn("rec", F.map_from_arrays("mods", F.transform("mods", F.length)))
    cut = m.withColumn("rec", F.map_filter("rec", lambda k, _: k.isin("hsqc", "mw")))
    left = cut.where(F.size(F.array_intersect(F.map_keys("rec"), F.array(*[F.lit(x) for x in ck.SPECTRAL]))) > 0)
    return left.select("p_partkey", F.array_join(F.map_keys("rec"), "+").alias("kept"))


@query(f"WITH {MODS} SELECT p_partkey, unnest(list_filter(['hsqc', 'c_nmr', 'mass_spec'], lambda x: NOT list_contains(mods, x))) AS missing FROM m")
def missing_modality(spark, sf):
    return modalities(spark, sf).select("p_partkey", F.explode(F.array_except(F.array(F.lit("hsqc"), F.lit("c_nmr"), F.lit("mass_spec")), "mods")).alias("missing"))


@query("SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS id, p_partkey FROM part WHERE p_retailprice <= 1400 AND p_size >= 3")
def survivors_numbered(spark, sf):
    """Rows that pass both limits, with dense ids."""
    kept = table(spark, sf, "part").where((F.col("p_retailprice") <= 1400) & (F.col("p_size") >= 3)).select("p_partkey")
    return numbered(kept, [F.col("p_partkey")], "id").select("id", "p_partkey")


@query("SELECT CASE WHEN p_retailprice > 1400 THEN 'too heavy' WHEN p_size < 3 THEN 'too small' ELSE 'kept' END AS reason, count(*) AS n FROM part GROUP BY 1")
def filter_reason_counts(spark, sf):
    """How many rows fail each test first."""
    why = rel.first_failure({"too heavy": F.col("p_retailprice") > 1400, "too small": F.col("p_size") < 3})
    return table(spark, sf, "part").groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


PARTS = "b AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_retailprice END AS mass, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS c, 2 * p_size AS h FROM part)"


@query(f"WITH {PARTS} SELECT p_partkey FROM b WHERE mass IS NULL OR mass >= 1200")
def filter_range_checked(spark, sf):
    """A range filter with one bound; a bank without any mass would be an error, not all rows."""
    return rel.range_filter(part_bank(spark, sf), "mass", 1200.0, None).select("p_partkey")


@query(f"WITH {PARTS} SELECT p_partkey FROM b WHERE c IS NULL OR (c >= 10 AND h <= 60)")
def filter_map_checked(spark, sf):
    """Element bounds, open on a side; a bank without any map would be an error, a bound without ends too."""
    return rel.count_filter(part_bank(spark, sf), "elems", {"C": (10, None), "H": (None, 60), "N": (0, 0)}).select("p_partkey")


@query(f"WITH {BANK}, k AS (SELECT row_number() OVER () - 1 AS pos, doc_id FROM (SELECT unnest([7, 3, 7, 0, 199]) AS doc_id)) SELECT CAST(CASE pos WHEN 0 THEN 0 ELSE pos END AS INTEGER) AS pos, CAST(k.doc_id AS BIGINT) AS doc_id, nnz FROM k JOIN nnz ON nnz.doc_id = k.doc_id")
def bank_row_subset(spark, sf):
    """Rows of the bank in a given order, repeats kept."""
    kept = spark.createDataFrame(list(enumerate([7, 3, 7, 0, 199])), "pos int, doc_id long")
    return bk.subset(bank_of(spark, sf), kept).select("pos", "doc_id", "nnz")


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature, 1 AS radius FROM t UNION ALL SELECT doc_id, unnest(w), 0 FROM t), d AS (SELECT feature, radius, count(DISTINCT doc_id) AS df FROM g GROUP BY ALL) SELECT radius, count(*) AS features, CAST(max(df) AS BIGINT) AS most FROM d WHERE radius <= 1 GROUP BY 1")
def vocabulary_radius_filter(spark, sf):
    """Features of a keyed vocabulary up to a radius (the number of neighbours that a part is taken with)."""
    from tessera.operators.strategies import strategy

    feats = strategy("ngram", max_radius=2).features(docs(spark, sf)).where("radius <= 1")
    d = feats.select("doc_id", "feature", "radius").distinct().groupBy("feature", "radius").agg(F.count(F.lit(1)).alias("df"))
    return d.groupBy("radius").agg(F.count(F.lit(1)).alias("features"), F.max("df").alias("most"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS blanked, CASE WHEN l.doc_id IS NULL THEN d.source END AS source, CASE WHEN l.doc_id IS NULL THEN d.lang END AS lang FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)")
def blank_two_columns(spark, sf):
    """Listed rows stay, both their columns blanked."""
    return rel.blanked(table(spark, sf, "documents", "doc_id", "source", "lang"), table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", ["source", "lang"])


@query("SELECT p_partkey, p_size % 4 IN (0, 2) AS dropped FROM part")
def exchangeable_labels(spark, sf):
    label = F.when(F.col("p_size") % 4 == 0, "o h").when(F.col("p_size") % 4 == 2, "3-nh2").otherwise("CH3")
    return table(spark, sf, "part").select("p_partkey", label.alias("l")).select("p_partkey", ck.exchangeable("l").alias("dropped"))


@query("WITH f AS (SELECT p_partkey, p_size, p_retailprice < 1300 AND p_size % 9 <> 0 AS ok FROM part) SELECT a.p_partkey AS i, b.p_partkey AS j, a.ok AND b.ok AND least(a.p_size, b.p_size) >= 6 AS clean, a.p_size % 11 <> 0 AS complete FROM f a JOIN f b ON b.p_partkey = a.p_partkey + 1")
def pair_flags(spark, sf):
    """Clean and complete flags of pairs: both ends sound and large enough."""
    f = table(spark, sf, "part").select("p_partkey", "p_size", ((F.col("p_retailprice") < 1300) & (F.col("p_size") % 9 != 0)).alias("ok"))
    a, b = f.toDF("i", "si", "oi"), f.select((F.col("p_partkey") - 1).alias("i"), F.col("p_partkey").alias("j"), F.col("p_size").alias("sj"), F.col("ok").alias("oj"))
    return a.join(b, "i").select("i", "j", (F.col("oi") & F.col("oj") & (F.least("si", "sj") >= 6)).alias("clean"), (F.col("si") % 11 != 0).alias("complete"))


@query(
    "SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'no spectrum' WHEN p_size % 6 = 1 THEN 'hsqc not in triplets' WHEN p_size % 6 = 2 THEN 'hsqc shift missing' WHEN p_size % 6 = 3 THEN 'hsqc signs incomplete' "
    "WHEN p_size % 6 = 4 AND p_size % 4 = 0 THEN 'mass spectrum not in pairs' WHEN p_size % 6 = 4 AND p_size % 4 = 2 THEN 'range reversed' END AS error FROM part"
)
def request_errors(spark, sf):
    """The first thing wrong with each request."""
    kind = F.col("p_size") % 6
    one, none = F.lit(1.0), F.lit(None).cast("double")
    whole = F.array(one, one, none, one, one, none)  # signs wholly absent are fine
    hsqc = F.when(kind == 1, F.array(one, one)).when(kind == 2, F.array(one, none, one)).when(kind == 3, F.array(one, one, one, one, one, none)).when(kind >= 4, whole)
    ms = F.when((kind == 4) & (F.col("p_size") % 4 == 0), F.array(one))
    hi = F.when((kind == 4) & (F.col("p_size") % 4 == 2), 50.0).otherwise(200.0)
    p = table(spark, sf, "part").select("p_partkey", hsqc.alias("hsqc"), ms.alias("ms"), hi.alias("hi"))
    return p.select("p_partkey", ck.request_error(F.col("hsqc"), F.col("ms"), F.lit(100.0), F.col("hi")).alias("error"))


@query("SELECT l_orderkey, l_linenumber, CAST(center AS DOUBLE) AS center, CAST(c2 AS DOUBLE) AS c2 FROM lineitem, (VALUES (10000.0, 10.0), (30000.0, 30.0), (50000.0, 45.0)) t(center, c2) WHERE abs(l_extendedprice - center) <= 500 AND abs(l_quantity - c2) <= 5")
def box_window(spark, sf):
    """Peaks within a two-dimensional box around a line."""
    lines = spark.createDataFrame([(10000.0, 10.0), (30000.0, 30.0), (50000.0, 45.0)], "center double, c2 double")
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    near = rel.band_join(li, F.broadcast(lines), "l_extendedprice", "center", 500.0)
    return near.where(F.abs(F.col("l_quantity") - F.col("c2")) <= 5).select("l_orderkey", "l_linenumber", "center", "c2")


@query("SELECT l_orderkey, count(*) AS n, CAST(count(*) FILTER (WHERE l_discount >= 0.05) AS BIGINT) AS confident FROM lineitem WHERE l_tax >= 0.01 GROUP BY 1 HAVING max(l_discount) >= 0.05")
def confidence_floors(spark, sf):
    """Rows above the row floor, groups above the bucket floor, and how many of theirs are confident."""
    g = table(spark, sf, "lineitem").where("l_tax >= 0.01").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") >= 0.05).alias("confident"), F.max("l_discount").alias("top"))
    return g.where("top >= 0.05").select("l_orderkey", "n", "confident")


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_tax > 0) AS rows_, bool_and(l_discount > 0) FILTER (WHERE l_tax > 0) OR NOT bool_or(l_discount > 0) FILTER (WHERE l_tax > 0) AS signs_ok FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_tax > 0) > 0")
def hsqc_hygiene(spark, sf):
    """Rows with both shifts finite; whether all or none of them have a sign."""
    peak = F.struct(F.col("l_quantity").alias("h"), F.when(F.col("l_tax") > 0, F.col("l_extendedprice")).otherwise(F.lit(float("nan"))).alias("c"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("i"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(peak).alias("p")).select("l_orderkey", ar.complete_rows("p").alias("p")).where(F.size("p") > 0)
    return g.select("l_orderkey", F.size("p").cast("long").alias("rows_"), ar.all_or_none(F.transform("p", lambda x: x["i"].isNotNull())).alias("signs_ok"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not a formula' WHEN 2 THEN 'unknown element Xx' END AS error FROM part")
def formula_errors(spark, sf):
    s = F.col("p_size")
    f = F.when(s % 4 == 0, F.concat(F.lit("C"), s.cast("string"), F.lit("H12NaCl"))).when(s % 4 == 1, "c10h12").when(s % 4 == 2, "C2Xx3Yy").otherwise("  ")
    return table(spark, sf, "part").select("p_partkey", f.alias("f")).select("p_partkey", ck.formula_error("f").alias("error"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'needs a min or a max' WHEN p_size % 3 = 1 AND p_size > 10 THEN 'min exceeds max' END AS error FROM part")
def bound_errors(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", ck.bound_error(F.when(s % 3 != 0, s), F.when(s % 3 == 1, 10)).alias("error"))
