"""Arrays, maps and texts: reordering, stacking, guards, set similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as ar
from tessera.functions import checks as ck
from tessera.functions import expressions as ex
from tessera.operators import features as fop
from tessera.operators import similarity as sim
from tessera.operators.bank import bank_of
from tessera.plans.features import BANK
from tessera.plans.retrieval import DENSE, predictions, vectors
from tessera.plans.scalars import FORMULA, formulas
from tessera.registry import query
from tessera.sources.tables import table

FLAT = "f AS (SELECT p_partkey, p_size, [CAST(p_size AS DOUBLE), p_retailprice, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 1.5 END, CAST(p_partkey AS DOUBLE), 2.5, -1.0] AS hsqc, [p_retailprice] AS c, [CAST(p_size AS DOUBLE), 0.5] AS ms FROM part)"


def flat(spark, sf):
    """Parts as flat streams: two triplets (the first with a null intensity now and then), a shift, a pair."""
    p = table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice")
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    hsqc = F.array(size, price, F.when(F.col("p_size") % 4 != 0, 1.5), F.col("p_partkey").cast("double"), F.lit(2.5), F.lit(-1.0))
    return p.select("p_partkey", "p_size", hsqc.alias("hsqc"), F.array(price).alias("c"), F.array(size, F.lit(0.5)).alias("ms"))


@query(f"WITH {FLAT}, r AS (SELECT p_partkey, [hsqc[2], hsqc[1], coalesce(hsqc[3], 0), hsqc[5], hsqc[4], hsqc[6]] AS v FROM f) SELECT p_partkey, CAST(unnest(range(0, 6)) AS INTEGER) AS pos, round(unnest(v), 6) AS value FROM r")
def triplet_reorder(spark, sf):
    """(h, c, i) triplets as (c, h, i), null intensities 0."""
    return flat(spark, sf).select("p_partkey", F.posexplode(ar.reordered(F.col("hsqc"))).alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(
    f"WITH {FLAT} SELECT p_partkey, hsqc[1] AS a, hsqc[2] AS b, coalesce(hsqc[3], 0) AS c, 0 AS type FROM f UNION ALL SELECT p_partkey, hsqc[4], hsqc[5], hsqc[6], 0 FROM f "
    "UNION ALL SELECT p_partkey, c[1], 0, 0, 1 FROM f UNION ALL SELECT p_partkey, ms[1], ms[2], 0, 3 FROM f"
)
def typed_stream(spark, sf):
    """Streams of three widths stacked into rows of three numbers and a type code."""
    s = ar.stacked({"hsqc": (F.col("hsqc"), 3), "c_nmr": (F.col("c"), 1), "mass_spec": (F.col("ms"), 2)})
    return flat(spark, sf).select("p_partkey", F.explode(s).alias("r")).select("p_partkey", "r.*")


ELEMENT_LIST = "[" + ", ".join(f"'{e}'" for e in ar.ELEMENTS) + "]"


@query(f"WITH {FORMULA}, m AS (SELECT p_partkey, map_from_entries(list((el, n))) AS m FROM g GROUP BY 1), k AS (SELECT p_partkey, m, list_transform({ELEMENT_LIST}, lambda v: coalesce(m[v], 0)) AS v FROM m) SELECT p_partkey, array_to_string(list_concat(v, [list_sum(map_values(m)) - list_sum(v)]), ',') AS vec FROM k")
def formula_vector_40(spark, sf):
    """All forty slots; what no slot names counts in the last."""
    v = formulas(spark, sf).select("p_partkey", ex.formula_counts("formula").alias("m"))
    return v.select("p_partkey", F.array_join(F.transform(ex.formula_vector("m", ar.ELEMENTS), lambda x: x.cast("string")), ",").alias("vec"))


@query("SELECT p_partkey, array_to_string(list_transform(range(0, 16), lambda i: CASE WHEN i IN (p_size % 16, p_size * 3 % 16) THEN 1 ELSE 0 END), '') AS dense, array_to_string(list_sort(list_distinct([p_size % 16, p_size * 3 % 16])), ',') AS back FROM part")
def dense_and_nonzero(spark, sf):
    """Indices to a dense array and back."""
    d = ar.from_indices(F.array(F.col("p_size") % 16, F.col("p_size") * 3 % 16), 16)
    text = lambda a: F.transform(a, lambda x: x.cast("string"))
    p = table(spark, sf, "part").select("p_partkey", d.alias("d"))
    return p.select("p_partkey", F.array_join(text(F.col("d")), "").alias("dense"), F.array_join(text(ar.nonzero(F.col("d"))), ",").alias("back"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS h, l_extendedprice AS c, CAST(CASE WHEN l_linenumber % 3 = 2 THEN -1 ELSE 1 END AS INTEGER) AS sign FROM lineitem")
def hsqc_sign_rows(spark, sf):
    """Peak rows with the sign that their kind gives."""
    kind = F.concat(F.lit("CH"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise((F.col("l_linenumber") % 3).cast("string")))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ar.signed_rows(F.array(F.struct(F.col("l_quantity").alias("h"), F.col("l_extendedprice").alias("c"), kind.alias("kind")))).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", F.inline("r"))


@query("SELECT o_orderkey, count(l_orderkey) FILTER (WHERE l_discount > 0.05) AS found, count(DISTINCT l_partkey) AS kinds, round(CASE WHEN count(DISTINCT l_partkey) > 0 THEN count(l_orderkey) FILTER (WHERE l_discount > 0.05) / count(DISTINCT l_partkey) ELSE 1 END, 6) AS coverage FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def shift_coverage(spark, sf):
    o, l = table(spark, sf, "orders", "o_orderkey"), table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_discount")
    g = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count_if(F.col("l_discount") > 0.05).alias("found"), F.countDistinct("l_partkey").alias("kinds"))
    return g.withColumn("coverage", F.round(ar.coverage(F.col("found"), F.col("kinds")), 6))


@query("WITH t AS (SELECT list_sort(list(DISTINCT lang)) AS names FROM documents) SELECT doc_id, lang || '/' || names[CAST(doc_id % len(names) AS INTEGER) + 1] AS labels FROM documents, t")
def deintern_labels(spark, sf):
    """Interned ids back to text through the label table."""
    d = table(spark, sf, "documents", "doc_id", "lang")
    t = d.agg(F.array_sort(F.collect_set("lang")).alias("names"))  # a row for the few labels
    ids = F.array(F.array_position("names", F.col("lang")).cast("int") - 1, (F.col("doc_id") % F.size("names")).cast("int"))
    return d.crossJoin(F.broadcast(t)).select("doc_id", F.array_join(ar.labels_of(ids, F.col("names")), "/").alias("labels"))


@query(
    "WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS mae, l_linenumber % 2 = 0 AS charged, CASE WHEN l_tax > 0.06 THEN 'partial' ELSE 'ok' END AS status, l_discount = 0 AS absent, l_discount * 10 AS cover FROM lineitem), "
    "b AS (SELECT *, CASE WHEN mae > 2 THEN CASE WHEN charged THEN 'kept_charged' WHEN mae > 4 THEN 'kept_mae_gt_trust' ELSE 'fell_back' END END AS bucket FROM x) "
    "SELECT l_orderkey, l_linenumber, bucket, CASE WHEN bucket = 'fell_back' THEN 'mae' WHEN status <> 'ok' THEN 'hsqc_' || status WHEN absent THEN 'absent' WHEN cover < 0.5 THEN 'low_c_coverage' END AS reason FROM b"
)
def guard_decision(spark, sf):
    """Which spectrum to trust: the bucket of the guard, and why a row's own is not used."""
    x = table(spark, sf, "lineitem").withColumn("bucket", ck.guard(F.col("l_quantity") / 10, 2.0, 4.0, F.col("l_linenumber") % 2 == 0))
    status = F.when(F.col("l_tax") > 0.06, "partial").otherwise("ok")
    return x.select("l_orderkey", "l_linenumber", "bucket", ck.guard_reason(F.col("bucket"), status, F.col("l_discount") == 0, F.col("l_discount") * 10, 0.5).alias("reason"))


@query("SELECT vec_id, CAST(list_sum(list_transform(e, lambda x: CAST(x = list_max(e) AS INTEGER))) AS BIGINT) AS ones, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS first_one FROM (SELECT vec_id, embedding AS e FROM embeddings)")
def max_valued_bits(spark, sf):
    """Vectors rounded to the bits that have the largest value."""
    b = vectors(spark, sf).select("vec_id", ar.nonzero(ar.at_maximum(F.col("embedding"))).alias("at"))
    return b.select("vec_id", F.size("at").cast("long").alias("ones"), F.col("at")[0].alias("first_one"))


@query("WITH s AS (SELECT vec_id, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings ORDER BY md5(concat('audit', CAST(vec_id AS VARCHAR))) LIMIT 3) SELECT count(*) AS sampled, CAST(sum(CASE WHEN n > 0 AND abs(n - 1) > 1e-3 THEN 1 ELSE 0 END) AS BIGINT) AS off FROM s")
def unit_norm_audit(spark, sf):
    """Three rows in hash order (the sample is the feature): how many are neither of unit length nor zero."""
    v = vectors(spark, sf).withColumn("e", F.col("embedding").cast("array<double>"))
    s = v.orderBy(F.md5(F.concat(F.lit("audit"), F.col("vec_id").cast("string")))).limit(3).select(sim.norm("e").alias("n"))
    return s.agg(F.count(F.lit(1)).alias("sampled"), F.count_if((F.col("n") > 0) & (F.abs(F.col("n") - 1) > 1e-3)).alias("off"))


PAIRS = "v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: CAST(0 AS DOUBLE)) ELSE CAST(embedding AS DOUBLE[]) END AS a, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x) - 0.05) AS b FROM embeddings), d AS (SELECT vec_id, list_dot_product(a, b) AS ab, list_dot_product(a, a) AS aa, list_dot_product(b, b) AS bb FROM v)"


@query(f"WITH {PAIRS}, s AS (SELECT vec_id, CASE WHEN aa * bb > 0 THEN greatest(0, least(1, ab / (sqrt(aa) * sqrt(bb)))) ELSE 0 END AS c, CASE WHEN aa + bb - ab <> 0 THEN greatest(0, least(1, ab / (aa + bb - ab))) ELSE 0 END AS t FROM d) SELECT vec_id, round(CASE WHEN c < 1e-9 THEN 0 ELSE c END, 6) AS cosine, round(CASE WHEN t < 1e-9 THEN 0 ELSE t END, 6) AS tanimoto FROM s")
def clamped_similarity(spark, sf):
    """Cosine and generalised Tanimoto within [0, 1]; zero vectors score 0, arrays of different length are an error."""
    e = F.col("embedding").cast("array<double>")
    v = vectors(spark, sf).select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.transform(e, lambda x: F.lit(0.0))).otherwise(e).alias("a"), F.transform(e, lambda x: F.abs(x) - 0.05).alias("b"))
    return v.select("vec_id", F.round(sim.safe_cosine("a", "b"), 6).alias("cosine"), F.round(sim.safe_tanimoto("a", "b"), 6).alias("tanimoto"))


@query(f"WITH {DENSE}, p AS (SELECT qid, list_transform(qe, lambda x: greatest(x, 0)) AS qe FROM q), s AS (SELECT qid, vec_id, d / greatest(list_dot_product(e, e) + list_dot_product(qe, qe) - d, 1e-12) AS score FROM (SELECT *, list_dot_product(qe, e) AS d FROM p, v)) SELECT qid, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def knn_tanimoto_clamped(spark, sf):
    """Real-valued Tanimoto of queries clamped at zero."""
    v = vectors(spark, sf)
    s = sim.scores(v, v.where("vec_id % 50 = 0"), "tanimoto_clamped", 10, "vec_id", "embedding")
    return sim.top_k(s, 10, "qid", "vec_id").select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"WITH {DENSE}, g AS (SELECT vec_id, list_transform(range(0, 8), lambda i: list_sum(e[i * 8 + 1 : i * 8 + 8])) AS e FROM v), s AS (SELECT a.vec_id AS qid, b.vec_id, list_dot_product(a.e, b.e) / greatest(sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)), 1e-12) AS score FROM g a, g b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), "
    "r AS (SELECT qid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) SELECT qid, CAST(coalesce(min(rank) FILTER (WHERE score > 0.99), -1) AS INTEGER) AS hit_rank, round(max(score), 6) AS best FROM r WHERE rank <= 10 GROUP BY 1"
)
def projected_hits(spark, sf):
    """Cosine of vectors summed in groups of eight: the 1-based rank of the first other row above 0.99 among ten, -1 if none."""
    e = F.col("embedding").cast("array<double>")
    sums = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.aggregate(F.slice(e, i * 8 + 1, 8), F.lit(0.0), lambda s, x: s + x))
    v = vectors(spark, sf).select("vec_id", sums.alias("g"))
    s = sim.scores(v, v.where("vec_id % 50 = 0"), "cosine", 11, "vec_id", "g").where("qid <> vec_id")
    top = sim.top_k(s, 10, "qid", "vec_id")
    return top.groupBy("qid").agg(F.coalesce(F.min(F.when(F.col("score") > 0.99, F.col("rank"))), F.lit(-1)).alias("hit_rank"), F.round(F.max("score"), 6).alias("best"))


@query("SELECT p_partkey, 'C=' || greatest(p_size, 20) || ',H=' || greatest(0, p_size % 5) || ',O=' || greatest(0, 3) AS u FROM part")
def map_union(spark, sf):
    """Two element maps united, the larger count kept."""
    a, b = F.create_map(F.lit("C"), F.col("p_size"), F.lit("H"), F.col("p_size") % 5), F.create_map(F.lit("C"), F.lit(20), F.lit("O"), F.lit(3))
    p = table(spark, sf, "part").select("p_partkey", a.alias("a"), b.alias("b")).select("p_partkey", ar.union_largest("a", "b").alias("u"))
    return p.select("p_partkey", F.concat_ws(",", *[F.concat(F.lit(f"{e}="), F.col("u")[e]) for e in ("C", "H", "O")]).alias("u"))


@query(f"WITH {BANK}, c AS (SELECT n.doc_id, coalesce(list(col) FILTER (WHERE col IS NOT NULL), []) AS cols FROM nnz n LEFT JOIN bank USING (doc_id) GROUP BY 1) SELECT a.doc_id, len(list_intersect(a.cols, b.cols)) AS common, len(list_distinct(list_concat(a.cols, b.cols))) AS united, round(CASE WHEN len(a.cols) + len(b.cols) = 0 THEN 1 ELSE len(list_intersect(a.cols, b.cols)) / len(list_distinct(list_concat(a.cols, b.cols))) END, 6) AS similarity FROM c a JOIN c b ON b.doc_id = a.doc_id + 1")
def column_set_similarity(spark, sf):
    """Column sets of neighbouring rows: sizes of intersection and union, and their ratio (two empty sets: 1)."""
    rows = bank_of(spark, sf).rows.select("doc_id", fop.columns_of("bits").alias("a"))
    other = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    both = rows.join(other, "doc_id")
    return both.select("doc_id", F.size(F.array_intersect("a", "b")).cast("long").alias("common"), F.size(F.array_union("a", "b")).cast("long").alias("united"), F.round(ar.set_similarity("a", "b"), 6).alias("similarity"))


@query("WITH t AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber) FILTER (WHERE l_discount > 0.02)) AS act, list_sort(list(DISTINCT l_linenumber)) AS surv FROM lineitem GROUP BY 1) SELECT l_orderkey, coalesce(len(act), 0) AS active, act IS NULL OR surv[1 : len(act)] = act AS prefix FROM t")
def prefix_levels(spark, sf):
    """Whether the active levels are the first ones of those that survive."""
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_discount") > 0.02, F.col("l_linenumber")))).alias("act"), F.array_sort(F.collect_set("l_linenumber")).alias("surv"))
    return t.select("l_orderkey", F.size("act").cast("long").alias("active"), F.expr("slice(surv, 1, size(act)) = act").alias("prefix"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size ELSE -1 END AS hits, CASE WHEN p_size % 5 <> 0 THEN [1, 60, 3600][p_size % 3 + 1] ELSE -1 END AS seconds FROM part")
def rate_specs(spark, sf):
    """'30 per minute' as hits and seconds; what doesn't read so is null, shown as -1."""
    unit = F.when(F.col("p_size") % 3 == 0, "second").when(F.col("p_size") % 3 == 1, " Minute ").otherwise("HOUR")
    spec = F.when(F.col("p_size") % 5 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" a "), unit)).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" per "), unit))
    return table(spark, sf, "part").select("p_partkey", spec.alias("s")).select("p_partkey", ck.rate_spec("s").alias("r")).select("p_partkey", *[F.coalesce(f"r.{c}", F.lit(-1)).alias(c) for c in ("hits", "seconds")])


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0 ELSE greatest(-1, least(1, p_retailprice / 1000 - 1)) END AS safe FROM part")
def finite_guard(spark, sf):
    """Clamped to [-1, 1]; null and non-finite values become 0."""
    x = F.when(F.col("p_size") % 8 == 0, F.lit(float("nan"))).when(F.col("p_size") % 8 == 4, F.lit(float("-inf"))).otherwise(F.col("p_retailprice") / 1000 - 1)
    return table(spark, sf, "part").select("p_partkey", ar.guarded(x, -1.0, 1.0).alias("safe"))


@query("SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH) AS INTEGER) AS days, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, CAST(isodow(o_orderdate) AS INTEGER) AS weekday FROM orders")
def date_arithmetic(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.date_diff(F.add_months(d, 2), d).alias("days"), F.date_format(F.trunc(d, "month"), "yyyy-MM-dd").alias("month"), (F.weekday(d) + 1).alias("weekday"))


@query("SELECT p_partkey, 'Name & <' || p_name || '> \"x\"' AS clean FROM part")
def metadata_clean(spark, sf):
    """Markup stripped, references decoded, white space collapsed."""
    raw = F.concat(F.lit("  <b class='x'>Name</b>\n &amp; &lt;"), F.col("p_name"), F.lit("&gt;<!-- no --> &quot;x&quot; <script>y()</script>"))
    return table(spark, sf, "part").select(F.col("p_partkey"), raw.alias("h")).select("p_partkey", ck.plain_text("h").alias("clean"))


@query("SELECT p_partkey, translate('C' || p_size || 'H' || p_partkey, '0123456789', '₀₁₂₃₄₅₆₇₈₉') AS shown, 'C' || p_size || 'H' || p_partkey AS back FROM part")
def subscripts_both_ways(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit("H"), F.col("p_partkey").cast("string")).alias("f"))
    p = p.select("p_partkey", ck.subscripted("f").alias("shown"))
    return p.select("p_partkey", "shown", ck.unsubscripted("shown").alias("back"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'https://a.example/c/' || p_partkey WHEN p_size % 3 = 1 THEN 'https://b.example/l/' || p_name WHEN p_size % 2 = 0 THEN 'https://c.example/n/' || p_size END AS link FROM part")
def source_links(spark, sf):
    """The link of the first source that has an id for the row."""
    size = F.col("p_size")
    links = [("https://a.example/c/", F.when(size % 3 == 0, F.col("p_partkey").cast("string"))), ("https://b.example/l/", F.when(size % 3 == 1, F.col("p_name"))), ("https://c.example/n/", F.when(size % 2 == 0, size.cast("string")))]
    return table(spark, sf, "part").select("p_partkey", ck.first_link(links).alias("link"))


@query("SELECT p_partkey, CASE WHEN p_size >= 20 THEN 'spectra' ELSE 'no spectra' END AS kind FROM part")
def paper_text_class(spark, sf):
    text = F.concat(F.lit("The 1H NMR and 13 C-NMR data: "), F.repeat(F.lit("7.26, 128.4, x "), F.col("p_size") * 2))
    return table(spark, sf, "part").select("p_partkey", text.alias("t")).select("p_partkey", ck.paper_kind("t").alias("kind"))


@query("SELECT p_partkey, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'C' || p_size END AS smiles, '10.1000/' || p_partkey || '|10.1000/b' || p_size AS dois, CASE WHEN p_size % 3 = 0 THEN '13C|1H' ELSE '1H' END AS spectra FROM part")
def html_cards(spark, sf):
    """Compound cards read from HTML: name, structure, references, kinds of spectra."""
    s = F.col("p_size")
    h = F.concat(F.lit("<div><h2> "), F.col("p_name"), F.lit("</h2>"), F.when(s % 2 == 0, F.concat(F.lit("<span class='smiles'>C"), s, F.lit("</span>"))).otherwise(""), F.lit("<a href=\"https://doi.org/10.1000/b"), s, F.lit(".\">ref</a> https://doi.org/10.1000/"), F.col("p_partkey"), F.lit("<ul><li>1H NMR<li class=x> 1h again"), F.when(s % 3 == 0, "<li>13c data").otherwise(""), F.lit("</ul></div>"))
    c = table(spark, sf, "part").select("p_partkey", h.alias("h")).select("p_partkey", ck.card("h").alias("c"))
    return c.select("p_partkey", "c.name", "c.smiles", F.array_join("c.dois", "|").alias("dois"), F.array_join("c.spectra", "|").alias("spectra"))
