"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import relational as op
from tessera.operators import similarity as sim
from tessera.operators.bank import bank_of
from tessera.operators.numbering import numbered, quantiles
from tessera.operators.passages import verbatim
from tessera.plans.features import BANK, docs
from tessera.registry import query
from tessera.sources.tables import table


def _source(df, key, seq, name, amount):
    return df.select(F.col(key).cast("long").alias("key"), F.col(seq).cast("long").alias("seq"), F.struct(F.col(name).alias("name"), amount.alias("amount")).alias("rec"))


@query(
    "WITH c AS (SELECT c_nationkey AS key, arg_max(c_name, c_custkey) AS cn, arg_max(c_acctbal, c_custkey) AS ca FROM customer GROUP BY 1), "
    "s AS (SELECT s_nationkey AS key, arg_max(s_name, s_suppkey) AS sn, arg_max(s_acctbal, s_suppkey) AS sa FROM supplier GROUP BY 1), n AS (SELECT n_nationkey AS key, n_name AS nn FROM nation) "
    "SELECT CAST(coalesce(c.key, s.key, n.key) AS BIGINT) AS key, cn AS customer_name, ca AS customer_amount, sn AS supplier_name, sa AS supplier_amount, nn AS nation_name "
    "FROM c FULL JOIN s ON c.key = s.key FULL JOIN n ON coalesce(c.key, s.key) = n.key"
)
def source_merge_outer(spark, sf):
    """Three sources merged on nation key; within a source the last row wins."""
    c = _source(table(spark, sf, "customer"), "c_nationkey", "c_custkey", "c_name", F.col("c_acctbal"))
    s = _source(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey", "s_name", F.col("s_acctbal"))
    n = _source(table(spark, sf, "nation"), "n_nationkey", "n_nationkey", "n_name", F.lit(None).cast("double"))
    m = op.outer_merge({"customer": c, "supplier": s, "nation": n}, "key")
    return m.select("key", F.col("customer.name").alias("customer_name"), F.col("customer.amount").alias("customer_amount"), F.col("supplier.name").alias("supplier_name"), F.col("supplier.amount").alias("supplier_amount"), F.col("nation.name").alias("nation_name"))


PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "WITH r AS (SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(list_position(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'], o_orderpriority), 6), o_orderkey) AS n FROM orders) "
    "SELECT o_custkey, o_orderpriority, o_orderkey FROM r WHERE n = 1"
)
def source_priority(spark, sf):
    return op.by_priority(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", PRIORITY, "o_orderkey")


@query("SELECT o_custkey, max(o_orderkey) AS last_key, arg_max(o_totalprice, o_orderkey) AS last_price, min(o_orderkey) AS first_key, arg_min(o_totalprice, o_orderkey) AS first_price FROM orders GROUP BY 1")
def first_last_record(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    last = op.last_wins(o, "o_custkey", F.col("o_orderkey"), "o_orderkey", "o_totalprice").toDF("o_custkey", "last_key", "last_price")
    first = op.first_wins(o, "o_custkey", F.col("o_orderkey"), "o_orderkey", "o_totalprice").toDF("o_custkey", "first_key", "first_price")
    return last.join(first, "o_custkey")


SPLIT = (
    "b AS (SELECT DISTINCT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)), "
    "s AS (SELECT d.doc_id, CASE WHEN b.doc_id IS NOT NULL THEN 'test' WHEN l.quality = 0 THEN 'val' WHEN l.quality = 1 THEN 'train' END AS forced FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN labels l USING (doc_id)), "
    "f AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('split', CAST(doc_id AS VARCHAR)))) AS r, count(*) OVER () AS n FROM s WHERE forced IS NULL) "
)


def _leaks(spark, sf):
    """(doc_id, item_id): documents that hold a passage verbatim."""
    return verbatim(docs(spark, sf), table(spark, sf, "benchmark", "item_id", "text"))


@query("SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def leakage_flags(spark, sf):
    return _leaks(spark, sf)


@query(
    f"WITH {SPLIT} SELECT s.doc_id, coalesce(forced, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.9) THEN 'val' ELSE 'test' END) AS split, forced IS NOT NULL AS was_forced FROM s LEFT JOIN f USING (doc_id)"
)
def split_forced_free(spark, sf):
    """Prioritised assignment: leaks test, then labelled splits; the rest dealt by hash order to 80/10/10.

    Ranks come from per-bucket counts of the hash order, so no task holds all free rows.
    """
    leaks = _leaks(spark, sf).select("doc_id").distinct().withColumn("leak", F.lit(True))
    s = docs(spark, sf).select("doc_id").join(leaks, "doc_id", "left").join(table(spark, sf, "labels", "doc_id", "quality"), "doc_id", "left")
    forced = F.when(F.col("leak"), "test").when(F.col("quality") == 0, "val").when(F.col("quality") == 1, "train")
    s = s.select("doc_id", forced.alias("forced"))
    free = s.where("forced IS NULL").select("doc_id", op.hash_order(F.col("doc_id"), "split").alias("h")).withColumn("bucket", F.substring("h", 1, 3))
    sizes = free.groupBy("bucket").count()  # 4,096 rows at most
    before = sizes.select("bucket", F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy()).alias("n"))
    ranked = free.join(F.broadcast(before), "bucket").withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("h")) + F.col("before"))
    dealt = F.when(F.col("r") <= F.floor(F.col("n") * 0.8), "train").when(F.col("r") <= F.floor(F.col("n") * 0.9), "val").otherwise("test")
    return s.join(ranked.select("doc_id", dealt.alias("dealt")), "doc_id", "left").select("doc_id", F.coalesce("forced", "dealt").alias("split"), F.col("forced").isNotNull().alias("was_forced"))


@query("SELECT l.doc_id FROM labels l ANTI JOIN (SELECT doc_id FROM documents WHERE n_chars > 500) d USING (doc_id)")
def retrieval_superset_check(spark, sf):
    """Rows that the bank (here: documents of some length) is missing; fine if none."""
    return table(spark, sf, "labels", "doc_id").join(table(spark, sf, "documents").where("n_chars > 500").select("doc_id"), "doc_id", "left_anti")


@query("SELECT md5(text) AS key, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_key_check(spark, sf):
    return docs(spark, sf).groupBy(F.md5("text").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


@query("SELECT count(*) AS total, count(DISTINCT doc_id) AS distinct_ids, count(*) = count(DISTINCT doc_id) AS disjoint FROM (SELECT doc_id, quality FROM labels)")
def split_disjoint_check(spark, sf):
    return table(spark, sf, "labels").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("doc_id").alias("distinct_ids"), (F.count(F.lit(1)) == F.countDistinct("doc_id")).alias("disjoint"))


@query("SELECT key, src FROM ((SELECT c_nationkey AS key, 'customer_only' AS src FROM customer EXCEPT SELECT s_nationkey, 'customer_only' FROM supplier) UNION ALL (SELECT s_nationkey, 'supplier_only' FROM supplier EXCEPT SELECT c_nationkey, 'supplier_only' FROM customer) UNION ALL (SELECT c_nationkey, 'both' FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier))")
def set_difference_and_intersection(spark, sf):
    c, s = (table(spark, sf, n).select(F.col(k).alias("key")) for n, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    tag = lambda df, t: df.withColumn("src", F.lit(t))
    return tag(c.subtract(s), "customer_only").union(tag(s.subtract(c), "supplier_only")).union(tag(c.intersect(s), "both"))


@query("SELECT DISTINCT key FROM (SELECT p_brand AS key FROM part UNION SELECT p_type FROM part UNION SELECT c_mktsegment FROM customer UNION SELECT o_orderpriority FROM orders UNION SELECT n_name FROM nation) WHERE key <> ''")
def union_of_keys(spark, sf):
    """Distinct union of five key sets without empty ones."""
    cols = (("part", "p_brand"), ("part", "p_type"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("nation", "n_name"))
    out = None
    for t, c in cols:
        k = table(spark, sf, t).select(F.col(c).alias("key")).distinct()
        out = k if out is None else out.union(k)
    return out.where("key <> ''").distinct()


@query("SELECT array_to_string(list_filter(['hsqc','c_nmr','h_nmr','mass_spec','mw','formula'], lambda x, i: (m >> (i - 1)) & 1 = 1), '+') AS combo, CAST(bit_count(m) AS INTEGER) AS n FROM (SELECT CAST(unnest(range(1, 64)) AS INTEGER) AS m) WHERE (m & 15) <> 0")
def modality_power_set(spark, sf):
    """Every set of inputs with at least one spectral member, as a key in canonical order; reads no table."""
    m = spark.range(1, 64).select(F.col("id").cast("int").alias("m")).where("(m & 15) <> 0")
    return m.selectExpr("array_join(filter(array('hsqc','c_nmr','h_nmr','mass_spec','mw','formula'), (x, i) -> (shiftright(m, i) & 1) = 1), '+') AS combo", "bit_count(m) AS n")


@query(f"WITH {BANK}, k AS (SELECT doc_id, list_sort(list(col)) AS cols FROM bank GROUP BY 1), g AS (SELECT cols, count(*) AS n FROM k GROUP BY 1) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows_, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_in_tie, max(n) AS largest FROM g")
def tie_groups(spark, sf):
    """Rows with the same set of columns: equal packed bits; empty rows, which the posting form lacks, are left out."""
    g = bank_of(spark, sf).rows.where("nnz > 0").groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows_"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_in_tie"), F.max("n").alias("largest"))


@query("WITH g AS (SELECT p_brand, p_size, count(*) AS n, CASE WHEN count(p_retailprice) < 2 THEN 0 ELSE max(p_retailprice) - min(p_retailprice) END AS span FROM part GROUP BY 1, 2) SELECT CASE WHEN span < 50 THEN '[0,50)' WHEN span < 200 THEN '[50,200)' ELSE '[200,)' END AS bin, count(*) AS groups, CAST(sum(n) AS BIGINT) AS members, round(median(span), 6) AS median_span FROM g GROUP BY 1")
def tie_group_span_bins(spark, sf):
    g = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"), F.when(F.count("p_retailprice") < 2, 0.0).otherwise(F.max("p_retailprice") - F.min("p_retailprice")).alias("span"))
    b = F.when(F.col("span") < 50, "[0,50)").when(F.col("span") < 200, "[50,200)").otherwise("[200,)")
    g = g.withColumn("bin", b)
    mid = quantiles(g, ["bin"], "span", [0.5], ["m"]).select("bin", F.round("m", 6).alias("median_span"))
    return g.groupBy("bin").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("members")).join(mid, "bin")


@query(
    f"WITH {BANK}, g AS (SELECT md5(text) AS gid, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY md5(concat('pairs', CAST(doc_id AS VARCHAR)))) AS r FROM documents QUALIFY r <= 5), p AS (SELECT a.doc_id AS i, b.doc_id AS j FROM g a JOIN g b ON a.gid = b.gid AND a.doc_id < b.doc_id), "
    "x AS (SELECT i, j, count(*) AS inter FROM p JOIN bank u ON u.doc_id = i JOIN bank v ON v.doc_id = j AND v.col = u.col GROUP BY ALL) "
    "SELECT i, j, CASE WHEN a.nnz + b.nnz = 0 THEN 1.0 ELSE round(coalesce(inter, 0) / (a.nnz + b.nnz - coalesce(inter, 0)), 6) END AS tanimoto FROM p LEFT JOIN x USING (i, j) JOIN nnz a ON a.doc_id = i JOIN nnz b ON b.doc_id = j"
)
def pairs_within_group(spark, sf):
    """Pairs of at most five members of each group (a hash-ordered sample is the feature), with their Tanimoto similarity."""
    w = Window.partitionBy("gid").orderBy(op.hash_order(F.col("doc_id"), "pairs"))
    g = docs(spark, sf).select(F.md5("text").alias("gid"), "doc_id").withColumn("r", F.row_number().over(w)).where("r <= 5")
    a, b = g.select("gid", F.col("doc_id").alias("i")), g.select("gid", F.col("doc_id").alias("j"))
    p = a.join(b, "gid").where("i < j").select("i", "j")
    rows = bank_of(spark, sf).rows
    both = p.join(rows.select(F.col("doc_id").alias("i"), F.col("bits").alias("u"), F.col("nnz").alias("a")), "i").join(rows.select(F.col("doc_id").alias("j"), F.col("bits").alias("v"), F.col("nnz").alias("b")), "j")
    m = sim.common_bits("u", "v")
    return both.select("i", "j", F.when(F.col("a") + F.col("b") == 0, 1.0).otherwise(F.round(m / (F.col("a") + F.col("b") - m), 6)).alias("tanimoto"))


LINES = "ln(center, kind) AS (VALUES (10000.0, 'line'), (30000.0, 'line'), (50000.0, 'line'), (20500.0, 'control'), (40500.0, 'control'))"


def _lines(spark):
    return spark.createDataFrame([(10000.0, "line"), (30000.0, "line"), (50000.0, "line"), (20500.0, "control"), (40500.0, "control")], "center double, kind string")


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, CAST(center AS DOUBLE) AS center, kind FROM lineitem JOIN ln ON abs(l_extendedprice - center) <= 150")
def band_join_peaks(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    return op.band_join(li, F.broadcast(_lines(spark)), "l_extendedprice", "center", 150.0).select("l_orderkey", "l_linenumber", "center", "kind")


@query(f"WITH {LINES}, h AS (SELECT CAST(center AS DOUBLE) AS center, kind, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN ln ON abs(l_extendedprice - center) <= 150 GROUP BY ALL), t AS (SELECT count(DISTINCT l_orderkey) AS t FROM lineitem) SELECT center, round(n / t, 6) AS share, round((n / t) / (SELECT avg(n) / max(t) FROM h, t WHERE kind = 'control'), 6) AS ratio FROM h, t WHERE kind = 'line'")
def band_join_controls(spark, sf):
    """Share of orders with a hit in a line's window, against the mean of the control windows."""
    hit = band_join_peaks(spark, sf).groupBy("center", "kind").agg(F.countDistinct("l_orderkey").alias("n"))
    total = table(spark, sf, "lineitem").agg(F.countDistinct("l_orderkey").alias("t"))
    base = hit.where("kind = 'control'").agg(F.avg("n").alias("base"))
    h = hit.where("kind = 'line'").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(base))
    return h.select("center", F.round(F.col("n") / F.col("t"), 6).alias("share"), F.round(F.col("n") / F.col("base"), 6).alias("ratio"))


@query(
    "WITH m(id, inputs, score) AS (VALUES ('full', ['hsqc','c_nmr','mw'], 0.9), ('nmr', ['hsqc','c_nmr'], 0.8), ('c', ['c_nmr'], 0.5), ('ms', ['mass_spec'], 0.6)), r(req) AS (VALUES (['hsqc','c_nmr']), (['c_nmr']), (['mass_spec']), (['c_nmr','mw'])) "
    "SELECT array_to_string(req, '+') AS request, id AS model FROM (SELECT req, id, row_number() OVER (PARTITION BY req ORDER BY score DESC, id DESC) AS n FROM r JOIN m ON len(list_filter(req, lambda x: NOT list_contains(inputs, x))) = 0) WHERE n = 1"
)
def model_select_combo(spark, sf):
    """Best model whose inputs hold the whole request; both sides are small fixed tables (``best_model`` reads one)."""
    m = spark.createDataFrame([("full", ["hsqc", "c_nmr", "mw"], 0.9), ("nmr", ["hsqc", "c_nmr"], 0.8), ("c", ["c_nmr"], 0.5), ("ms", ["mass_spec"], 0.6)], "id string, inputs array<string>, score double")
    r = spark.createDataFrame([(["hsqc", "c_nmr"],), (["c_nmr"],), (["mass_spec"],), (["c_nmr", "mw"],)], "req array<string>")
    fit = r.crossJoin(F.broadcast(m)).where(F.size(F.array_except("req", "inputs")) == 0)
    return fit.groupBy(F.array_join("req", "+").alias("request")).agg(F.max_by("id", F.struct("score", "id")).alias("model"))


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(array_to_string(list_sort(list(o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL)), ','), '') AS keys FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join_default_empty(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    c = table(spark, sf, "customer", "c_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("keys", F.array().cast("array<long>")).alias("keys")).select("c_custkey", F.size("keys").cast("long").alias("n"), F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS blanked, CASE WHEN l.doc_id IS NOT NULL THEN '' ELSE d.source END AS source FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)")
def blank_blacklisted(spark, sf):
    """Rows on the blacklist stay, with their column blanked."""
    bad = table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("bad"))
    return table(spark, sf, "documents", "doc_id", "source").join(bad, "doc_id", "left").select("doc_id", F.col("bad").isNotNull().alias("blanked"), F.when(F.col("bad"), "").otherwise(F.col("source")).alias("source"))


@query("SELECT substring(c_name, 1, 14) AS prefix, count(*) AS n, CAST(sum(CASE WHEN s.p IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS listed FROM customer LEFT JOIN (SELECT DISTINCT substring(replace(s_name, 'Supplier', 'Customer'), 1, 14) AS p FROM supplier) s ON substring(c_name, 1, 14) = s.p GROUP BY 1")
def prefix_key_membership(spark, sf):
    s = table(spark, sf, "supplier").select(F.substring(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")), 1, 14).alias("prefix")).distinct().withColumn("hit", F.lit(1))
    c = table(spark, sf, "customer").select(F.substring("c_name", 1, 14).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    return c.join(s, "prefix", "left").select("prefix", "n", F.coalesce(F.col("hit") * F.col("n"), F.lit(0)).alias("listed"))


@query("WITH b AS (SELECT s_name AS key, s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 0) SELECT key, (SELECT max(id) FROM b) + row_number() OVER (ORDER BY key) AS id FROM (SELECT DISTINCT s_name AS key FROM supplier) k ANTI JOIN b USING (key)")
def append_new_ids(spark, sf):
    """Keys that the bank lacks continue its ids in key order."""
    s = table(spark, sf, "supplier", "s_name", "s_suppkey")
    bank = s.where("s_suppkey % 3 <> 0").select(F.col("s_name").alias("key"), F.col("s_suppkey").alias("id"))
    top = bank.agg(F.max("id")).first()[0] or 0
    new = s.select(F.col("s_name").alias("key")).distinct().join(bank, "key", "left_anti")
    return numbered(new, [F.col("key")], "id", top + 1).select("key", "id")
