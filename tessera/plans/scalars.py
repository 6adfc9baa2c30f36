"""Scalar, array, map and text functions on driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import expressions as ex
from tessera.registry import query
from tessera.sources.tables import table

FORMULA = "f AS (SELECT p_partkey, 'C' || p_size || 'H' || (2 * p_size) || 'NO' || (p_size % 4 + 1) || CASE WHEN p_size % 3 = 0 THEN 'Cl' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN 'CH3Xe' ELSE '' END AS formula FROM part), e AS (SELECT p_partkey, formula, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)(\\d*)', 1)) AS el, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)(\\d*)', 2)) AS n FROM f), g AS (SELECT p_partkey, formula, el, CAST(sum(CASE WHEN n = '' THEN 1 ELSE CAST(n AS INTEGER) END) AS INTEGER) AS n FROM e GROUP BY ALL)"


def formulas(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_size")
    s = F.col("p_size")
    return p.select("p_partkey", F.concat(F.lit("C"), s, F.lit("H"), 2 * s, F.lit("NO"), s % 4 + 1, F.when(s % 3 == 0, "Cl").otherwise(""), F.when(s % 5 == 0, "CH3Xe").otherwise("")).alias("formula"))


@query(f"WITH {FORMULA} SELECT p_partkey, el, n FROM g")
def formula_parse(spark, sf):
    return formulas(spark, sf).select("p_partkey", F.explode(ex.formula_counts("formula")).alias("el", "n"))


@query(f"WITH {FORMULA} SELECT p_partkey, array_to_string(list_concat(list_transform(['C','H','N','O','Cl'], lambda v: coalesce(m[v], 0)), [list_sum(map_values(m)) - list_sum(list_transform(['C','H','N','O','Cl'], lambda v: coalesce(m[v], 0)))]), ',') AS vec FROM (SELECT p_partkey, map_from_entries(list((el, n))) AS m FROM g GROUP BY 1)")
def formula_vector(spark, sf):
    v = formulas(spark, sf).select("p_partkey", ex.formula_counts("formula").alias("m"))
    return v.select("p_partkey", F.array_join(F.transform(ex.formula_vector("m", ["C", "H", "N", "O", "Cl"]), lambda x: x.cast("string")), ",").alias("vec"))


@query(f"WITH {FORMULA} SELECT el, count(*) AS entities, max(n) AS most, round(100.0 * count(*) / (SELECT count(*) FROM part), 6) AS pct FROM g GROUP BY 1")
def element_prevalence(spark, sf):
    e = formula_parse(spark, sf)
    return e.groupBy("el").agg(F.count(F.lit(1)).alias("entities"), F.max("n").alias("most"), F.round(100.0 * F.count(F.lit(1)) / table(spark, sf, "part").count(), 6).alias("pct"))


@query("SELECT p_partkey, CASE WHEN trim(coalesce(p_type, '')) = '' THEN NULL WHEN len(h) = 1 THEN h[1] ELSE 'other' END AS class FROM (SELECT p_partkey, p_type, list_distinct(list_filter([CASE WHEN contains(lower(p_type), 'copper') THEN 'Cu' END, CASE WHEN contains(lower(p_type), 'brass') THEN 'CuZn' END, CASE WHEN contains(lower(p_type), 'steel') THEN 'Fe' END, CASE WHEN contains(lower(p_type), 'plated') THEN 'plated' END], lambda x: x IS NOT NULL)) AS h FROM part)")
def solvent_class(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ex.one_known_name("p_type", {"copper": "Cu", "brass": "CuZn", "steel": "Fe", "plated": "plated"}).alias("class"))


@query("SELECT p_partkey, CASE WHEN v < 0.05 THEN 'none' WHEN v < 0.5 THEN 'weak' WHEN v < 0.9 THEN 'likely' ELSE 'confident' END AS band FROM (SELECT p_partkey, p_size / 50.0 AS v FROM part)")
def band_label(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ex.band(F.col("p_size") / 50.0, [(0.05, "none"), (0.5, "weak"), (0.9, "likely")], "confident").alias("band"))


@query("SELECT p_partkey, TRY_CAST(regexp_extract(t, '^-?\\d+(?:\\.\\d+)?') AS DOUBLE) AS num FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_retailprice || ' ppm' ELSE 'ca. ' || p_size END AS t FROM part)")
def leading_number(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_retailprice").cast("string"), F.lit(" ppm"))).otherwise(F.concat(F.lit("ca. "), "p_size")).alias("t"))
    return p.select("p_partkey", ex.leading_number("t").alias("num"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size + 1.0 WHEN p_size % 3 = 1 THEN p_size * 1.0 END AS mid FROM part")
def range_midpoint(spark, sf):
    s = F.col("p_size")
    t = F.when(s % 3 == 0, F.concat(s, F.lit("-"), s + 2)).when(s % 3 == 1, s.cast("string")).otherwise("multiplet")
    return table(spark, sf, "part").select("p_partkey", t.alias("t")).select("p_partkey", ex.range_midpoint("t").alias("mid"))


HTML = "regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g')"


@query(f"SELECT page_id, trim(regexp_replace({HTML}, '[ \\n\\r\\t]+', ' ', 'g')) AS text FROM pages")
def html_strip(spark, sf):
    h = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    h = F.regexp_replace(F.regexp_replace(h, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(h, r"[ \n\r\t]+", " ")).alias("text"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS INTEGER) AS n_links, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))), ' ') AS links FROM pages")
def html_refs(spark, sf):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).alias("n_links"), F.array_join(F.array_sort(F.array_distinct(links)), " ").alias("links"))


@query("SELECT page_id, regexp_extract(url, '://([^/?]+)', 1) AS host, replace(replace(url, '|', '\\|'), ' ', '%20') AS escaped, CASE WHEN length(url) > 40 THEN substring(url, 1, 39) || '…' ELSE url END AS short FROM pages")
def url_scalars(spark, sf):
    p = table(spark, sf, "pages", "page_id", "url")
    return p.select("page_id", F.regexp_extract("url", "://([^/?]+)", 1).alias("host"), F.replace(F.replace("url", F.lit("|"), F.lit("\\|")), F.lit(" "), F.lit("%20")).alias("escaped"), F.when(F.length("url") > 40, F.concat(F.substring("url", 1, 39), F.lit("…"))).otherwise(F.col("url")).alias("short"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'nmr|shift') THEN 'strong' WHEN regexp_matches(lower(text), 'the .* of') THEN 'weak' ELSE 'none' END AS grade FROM documents")
def evidence_grade(spark, sf):
    t = F.lower("text")
    return table(spark, sf, "documents").select("doc_id", F.when(t.rlike("nmr|shift"), "strong").when(t.rlike("the .* of"), "weak").otherwise("none").alias("grade"))


@query("SELECT p_partkey, arg_max(c, (len(c), -i)) AS largest FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS c, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) GROUP BY 1")
def largest_component(spark, sf):
    """The longest piece of a name, the first of equals."""
    p = table(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "c"))
    return p.groupBy("p_partkey").agg(F.max_by("c", F.struct(F.length("c"), -F.col("i"))).alias("largest"))


@query("SELECT p_partkey, translate('C' || p_size || 'H' || (2 * p_size), '0123456789', '₀₁₂₃₄₅₆₇₈₉') AS pretty FROM part")
def subscripts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.translate(F.concat(F.lit("C"), "p_size", F.lit("H"), 2 * F.col("p_size")), "0123456789", "₀₁₂₃₄₅₆₇₈₉").alias("pretty"))


SPEC = "lineitem_peaks AS (SELECT l_orderkey, list({'mz': l_extendedprice, 'i': l_quantity} ORDER BY l_extendedprice, l_quantity) AS peaks, max(l_quantity) AS top FROM lineitem GROUP BY 1)"


def spectra(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("i")))).alias("peaks"))


@query("WITH n AS (SELECT l_orderkey, l_extendedprice AS mz, l_quantity / max(l_quantity) OVER (PARTITION BY l_orderkey) AS i FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY -i, mz) AS r FROM n WHERE i >= 0.2) SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY mz, i) AS INTEGER) - 1 AS pos, mz, round(i, 6) AS i FROM r WHERE r <= 3")
def peak_normalise_topn(spark, sf):
    n = spectra(spark, sf).select("l_orderkey", F.posexplode(ex.normalise_peaks("peaks", 0.2, 3)).alias("pos", "p"))
    return n.select("l_orderkey", "pos", "p.mz", F.round("p.i", 6).alias("i"))


@query("SELECT l_orderkey, count(*) AS n, round(sum(mz), 4) AS total FROM (SELECT l_orderkey, l_extendedprice AS mz FROM lineitem WHERE l_quantity > 5 AND l_extendedprice > 1000) GROUP BY 1")
def drop_sentinels(spark, sf):
    """Peaks with a coordinate under its floor go; spectra that this empties go with them."""
    kept = F.transform(F.filter("peaks", lambda p: (p["i"] > 5) & (p["mz"] > 1000)), lambda p: p["mz"])
    return spectra(spark, sf).select("l_orderkey", kept.alias("kept")).where(F.size("kept") > 0).select("l_orderkey", F.size("kept").cast("long").alias("n"), F.round(F.aggregate("kept", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(
    "WITH RECURSIVE s AS (SELECT l_orderkey AS k, l_extendedprice AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS r FROM lineitem), "
    "w AS (SELECT k, r, v AS last, v AS kept FROM s WHERE r = 1 UNION ALL SELECT s.k, s.r, CASE WHEN s.v - w.last > 5000 THEN s.v ELSE w.last END, CASE WHEN s.v - w.last > 5000 THEN s.v END FROM w JOIN s ON s.k = w.k AND s.r = w.r + 1) "
    "SELECT k AS l_orderkey, count(kept) AS n_kept, round(sum(kept), 4) AS total FROM w GROUP BY 1"
)
def peak_collapse_anchored(spark, sf):
    v = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("v"))
    kept = v.select("l_orderkey", ex.anchored_collapse("v", 5000.0).alias("kept"))
    return kept.select("l_orderkey", F.size("kept").cast("long").alias("n_kept"), F.round(F.aggregate("kept", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("SELECT l_orderkey, len(v) AS n, round(list_sum(v), 4) AS s, len(list_concat(v, list_transform(range(1, greatest(0, 7 - len(v)) + 1), lambda x: 0.0))) AS padded, array_to_string(list_transform(v, lambda x: printf('%.2f', x)), '; ') AS block FROM (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS v FROM lineitem GROUP BY 1)")
def pad_and_format(spark, sf):
    """Lists padded to a common length, and as fixed-precision text."""
    v = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"]).alias("v"))
    return v.select("l_orderkey", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("s"), F.size(ex.pad_to("v", F.lit(7))).cast("long").alias("padded"), F.array_join(F.transform("v", lambda x: F.format_string("%.2f", x)), "; ").alias("block"))


@query("SELECT p_partkey, round(CASE WHEN x <= 0.1 THEN 0.05 WHEN x <= 0.5 THEN 0.05 + (x - 0.1) * 0.75 WHEN x <= 0.9 THEN 0.35 + (x - 0.5) * 1.25 ELSE 0.85 END, 6) AS p FROM (SELECT p_partkey, p_size / 50.0 AS x FROM part)")
def interpolated_calibration(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(ex.interpolate(F.col("p_size") / 50.0, [0.1, 0.5, 0.9], [0.05, 0.35, 0.85]), 6).alias("p"))


@query("SELECT p_partkey, round(sin(x), 6) AS s0, round(cos(x), 6) AS c0, round(sin(2 * x), 6) AS s1, round(cos(2 * x), 6) AS c1, round(1 / (1 + exp(-x)), 6) AS sig, abs(x - 2.5) <= 1e-8 + 1e-5 * 2.5 AS near FROM (SELECT p_partkey, p_size / 10.0 AS x FROM part)")
def math_functions(spark, sf):
    x = F.col("p_size") / 10.0
    f = table(spark, sf, "part").select("p_partkey", x.alias("x"), ex.fourier(x, 2).alias("f"))
    r = lambda i: F.round(F.col("f")[i], 6)
    return f.select("p_partkey", r(0).alias("s0"), r(1).alias("c0"), r(2).alias("s1"), r(3).alias("c1"), F.round(1 / (1 + F.exp(-F.col("x"))), 6).alias("sig"), (F.abs(F.col("x") - 2.5) <= 1e-8 + 1e-5 * 2.5).alias("near"))


@query("SELECT s_suppkey, '{\"id\":' || s_suppkey || ',\"name\":\"' || s_name || '\"}' AS js FROM supplier")
def json_emit(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).alias("js"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract_string(props, '$.missing') AS BIGINT), -1) AS m, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def json_and_time(spark, sf):
    e = table(spark, sf, "events", "event_id", "props", "ts")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing").cast("long"), F.lit(-1)).alias("m"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("WITH s AS (SELECT lang, min(doc_id) AS f FROM documents GROUP BY 1), l AS (SELECT lang, row_number() OVER (ORDER BY f) - 1 AS id FROM s) SELECT doc_id, CAST(id AS INTEGER) AS lang_id FROM documents JOIN l USING (lang)")
def intern_labels(spark, sf):
    """Labels numbered in the order in which they are first seen."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents", "doc_id", "lang")
    names = d.groupBy("lang").agg(F.min("doc_id").alias("f"))  # one row per label
    ids = names.select("lang", (F.row_number().over(Window.orderBy("f")) - 1).alias("lang_id"))
    return d.join(ids, "lang").select("doc_id", "lang_id")


@query("SELECT p_partkey, CASE WHEN p_size < 3 THEN 'too_small' WHEN p_retailprice > 1800 THEN 'too_heavy' WHEN p_type LIKE '%TIN%' THEN 'element' ELSE 'kept' END AS reason FROM part")
def filter_reasons(spark, sf):
    from tessera.operators.relational import first_failure

    return table(spark, sf, "part").select("p_partkey", first_failure({"too_small": F.col("p_size") < 3, "too_heavy": F.col("p_retailprice") > 1800, "element": F.col("p_type").like("%TIN%")}).alias("reason"))
