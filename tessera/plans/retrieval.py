"""Top-k, rank-of-truth, filtered and edited retrieval.  Queries are the rows whose id 50 divides."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import features as fop
from tessera.operators import similarity as sim
from tessera.operators.bank import bank_of
from tessera.plans.features import BANK
from tessera.registry import query
from tessera.sources.tables import table

OVER = (
    f"{BANK}, q AS (SELECT doc_id AS qid, col FROM bank WHERE doc_id % 50 = 0), nq AS (SELECT doc_id AS qid, nnz AS nq FROM nnz WHERE doc_id % 50 = 0), "
    "met AS (SELECT qid, b.doc_id, count(*) AS inter FROM q JOIN bank b USING (col) GROUP BY ALL), "
    "ov AS MATERIALIZED (SELECT qid, doc_id, coalesce(inter, 0) AS inter, nq, nnz AS nb FROM nq CROSS JOIN nnz LEFT JOIN met USING (qid, doc_id))"
)
COSINE = "CASE WHEN nq * nb > 0 THEN inter / sqrt(nq * nb) ELSE 0 END"


def _topk_sql(score: str) -> str:
    return f"WITH {OVER}, s AS (SELECT qid, doc_id, {score} AS score FROM ov) SELECT qid, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"


def _queries(bank):
    return bank.rows.where("doc_id % 50 = 0")


def _nearest(rows, queries, kernel, k=10):
    """The best ``k`` rows (all, if fewer) per query, rows without a common bit included."""
    s = sim.scores(rows, queries, kernel, k, "doc_id", "bits")
    return sim.top_k(s, k).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


def _topk(spark, sf, kernel):
    bank = bank_of(spark, sf)
    return _nearest(bank.rows, _queries(bank), kernel)


@query(_topk_sql(COSINE))
def knn_cosine_sparse(spark, sf):
    return _topk(spark, sf, "cosine")


@query(_topk_sql("inter / greatest(nq + nb - inter, 1)"))
def knn_jaccard_sparse(spark, sf):
    return _topk(spark, sf, "jaccard")


@query(_topk_sql("inter / greatest(inter + 1.0 * (nq - inter) + CAST(0.2 AS DOUBLE) * (nb - inter), 1e-9)"))
def knn_tversky_sparse(spark, sf):
    return _topk(spark, sf, "tversky")


@query(_topk_sql("CAST(inter AS DOUBLE)"))
def knn_dot_sparse(spark, sf):
    """Whole common bits, as a unit-length bank's products times the square roots of the row sizes give them."""
    return _topk(spark, sf, "dot")


#: The gold row of a query is the row of the next id; a query whose gold the bank lacks is left out.
GOLD = f"gold AS (SELECT qid, inter, nq, nb, {COSINE} AS thr FROM ov WHERE doc_id = qid + 1)"


def gold_of(bank):
    """(qid, bits, thr, jac): each query with its gold row's cosine and Jaccard similarity."""
    q = _queries(bank).select(F.col("doc_id").alias("qid"), "bits", F.col("nnz").alias("nq"))
    g = bank.rows.select((F.col("doc_id") - 1).alias("qid"), F.col("bits").alias("gold"), F.col("nnz").alias("nb"))
    inter = sim.common_bits("bits", "gold")
    both = g.join(F.broadcast(q) if q.count() <= 100_000 else q, "qid")  # 150 bytes a row
    return both.select("qid", "bits", sim.cosine(inter, F.col("nq"), F.col("nb")).alias("thr"), sim.jaccard(inter, F.col("nq"), F.col("nb")).alias("jac"))


def ranks(spark, sf):
    """(qid, thr, jac, strict_rank, tie_rank, n)."""
    bank = bank_of(spark, sf)
    gold = gold_of(bank)
    found = sim.rank_counts(bank.rows, gold, "cosine", "doc_id", "bits", "qid", "thr")
    return gold.join(found, "qid").select("qid", "thr", "jac", (F.col("at_least") - 1).alias("strict_rank"), F.col("above").alias("tie_rank"), "n")


RANKS = (
    f"{OVER}, {GOLD}, r AS (SELECT s.qid, any_value(thr) AS thr, any_value(gold.inter / greatest(gold.nq + gold.nb - gold.inter, 1)) AS jac, count(*) FILTER (WHERE score >= thr OR abs(score - thr) <= 1e-8 + 1e-5 * abs(thr)) - 1 AS strict_rank, "
    f"count(*) FILTER (WHERE score > thr AND NOT abs(score - thr) <= 1e-8 + 1e-5 * abs(thr)) AS tie_rank, count(*) AS n FROM (SELECT qid, {COSINE} AS score FROM ov) s JOIN gold ON s.qid = gold.qid GROUP BY s.qid)"
)


@query(f"WITH {RANKS} SELECT qid, round(thr, 6) AS threshold, strict_rank, tie_rank, n FROM r")
def rank_of_gold(spark, sf):
    """Both rank conventions of each query's gold row among all rows, those without overlap included.

    Strict counts what ties with the gold against it and takes one off for the gold itself; tie-aware counts only what is clearly above.
    """
    return ranks(spark, sf).select("qid", F.round("thr", 6).alias("threshold"), "strict_rank", "tie_rank", "n")


@query(
    f"WITH {RANKS}, l AS (SELECT r.*, d.lang FROM r JOIN documents d ON d.doc_id = r.qid), g AS (SELECT * FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('none')) t(lang)) "
    "SELECT g.lang, count(qid) AS n, round(avg(thr), 4) AS mean_cos, round(avg(jac), 4) AS mean_tani, "
    + ", ".join(f"round(avg(CASE WHEN {c}_rank < {k} THEN 100.0 WHEN qid IS NOT NULL THEN 0 END), 2) AS {c}_top{k}" for c in ("strict", "tie") for k in (1, 5, 10))
    + " FROM g LEFT JOIN l USING (lang) GROUP BY 1"
)
def topk_summary(spark, sf):
    """Rank@1/5/10 in per cent by both conventions, mean cosine and Tanimoto and n, by language; a group without entries has nulls."""
    l = ranks(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), "lang"), "qid")
    groups = spark.createDataFrame([(x,) for x in ("de", "en", "es", "fr", "none")], "lang string")
    rate = lambda c, k: F.round(F.avg(F.when(F.col(f"{c}_rank") < k, 100.0).when(F.col("qid").isNotNull(), 0.0)), 2).alias(f"{c}_top{k}")
    measures = [F.count("qid").alias("n"), F.round(F.avg("thr"), 4).alias("mean_cos"), F.round(F.avg("jac"), 4).alias("mean_tani")]
    return groups.join(l, "lang", "left").groupBy("lang").agg(*measures, *[rate(c, k) for c in ("strict", "tie") for k in (1, 5, 10)])


@query(f"WITH {OVER}, g AS (SELECT qid, inter / greatest(nq + nb - inter, 1) AS thr FROM ov WHERE doc_id = qid + 1) SELECT ov.qid, count(*) FILTER (WHERE inter / greatest(nq + nb - inter, 1) >= thr OR abs(inter / greatest(nq + nb - inter, 1) - thr) <= 1e-8 + 1e-5 * thr) - 1 AS rank FROM ov JOIN g ON g.qid = ov.qid GROUP BY 1")
def jaccard_rank_of_gold(spark, sf):
    """Rank of the gold row by binary Jaccard similarity, ties against it."""
    bank = bank_of(spark, sf)
    found = sim.rank_counts(bank.rows, gold_of(bank), "jaccard", "doc_id", "bits", "qid", "jac")
    return found.select("qid", (F.col("at_least") - 1).alias("rank"))


DENSE = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS qid, e AS qe FROM v WHERE vec_id % 50 = 0)"
DENSE_TOP = "CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank"


def vectors(spark, sf):
    return table(spark, sf, "embeddings", "vec_id", "embedding")


def _dense(spark, sf, kernel):
    v = vectors(spark, sf)
    s = sim.scores(v, v.where("vec_id % 50 = 0"), kernel, 10, "vec_id", "embedding")
    return sim.top_k(s, 10, "qid", "vec_id").select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {DENSE}, s AS (SELECT qid, vec_id, list_dot_product(qe, e) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) AS score FROM q, v) SELECT qid, vec_id, round(score, 6) AS score, {DENSE_TOP} FROM s QUALIFY rank <= 10")
def knn_cosine_dense(spark, sf):
    return _dense(spark, sf, "cosine")


@query(f"WITH {DENSE}, s AS (SELECT qid, vec_id, d / (list_dot_product(e, e) + list_dot_product(qe, qe) - d) AS score FROM (SELECT *, list_dot_product(qe, e) AS d FROM q, v)) SELECT qid, vec_id, round(score, 6) AS score, {DENSE_TOP} FROM s QUALIFY rank <= 10")
def knn_tanimoto_dense(spark, sf):
    return _dense(spark, sf, "tanimoto")


SIG = "p AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: 1 / (1 + exp(-x))) AS p, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS g FROM embeddings)"


def predictions(spark, sf):
    """(vec_id, label, p array<double>, g array<int>): probabilities and true bits."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", "label", F.transform("e", lambda x: 1 / (1 + F.exp(-x))).alias("p"), F.transform("e", lambda x: (x > 0).cast("int")).alias("g"))


@query(f"WITH {SIG} SELECT vec_id, round(list_dot_product(p, CAST(g AS DOUBLE[])) / (sqrt(list_dot_product(p, p)) * sqrt(greatest(list_sum(g), 1e-12))), 6) AS cos_prob, round(s / greatest(a + b - s, 1), 6) AS tanimoto_bits FROM (SELECT *, list_sum(g) AS b, len(list_filter(p, lambda x: x >= 0.5)) AS a, list_sum(list_transform(range(1, 65), lambda i: CAST(p[i] >= 0.5 AS INTEGER) * g[i])) AS s FROM p)")
def paired_similarity(spark, sf):
    """Each prediction against its own truth: cosine over probabilities and Tanimoto over bits (union clamped to 1)."""
    p = predictions(spark, sf).withColumn("b", F.transform("p", lambda x: (x >= 0.5).cast("int")))
    gd = p.withColumn("gd", F.col("g").cast("array<double>"))
    inter = F.aggregate(F.zip_with("b", "g", lambda x, y: x * y), F.lit(0), lambda s, x: s + x)
    ones = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    union = F.greatest(ones("b") + ones("g") - inter, F.lit(1))
    return gd.select("vec_id", F.round(sim.dot("p", "gd") / (sim.norm("p") * F.sqrt(F.greatest(ones("g").cast("double"), F.lit(1e-12)))), 6).alias("cos_prob"), F.round(inter / union, 6).alias("tanimoto_bits"))


@query(
    f"WITH {DENSE}, s AS (SELECT qid, vec_id, list_dot_product(qe, e) AS d FROM q, v), r AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9) DESC, vec_id) - 1 AS rank FROM s), "
    "l AS (SELECT r.qid, min(rank) AS first_hit FROM r JOIN embeddings a ON a.vec_id = r.qid JOIN embeddings b ON b.vec_id = r.vec_id WHERE a.label = b.label AND r.vec_id <> r.qid AND rank < 11 GROUP BY 1) "
    "SELECT a.label, count(*) AS n, round(avg(CASE WHEN coalesce(first_hit, 11) <= 1 THEN 100.0 ELSE 0 END), 4) AS ann1, round(avg(CASE WHEN coalesce(first_hit, 11) <= 5 THEN 100.0 ELSE 0 END), 4) AS ann5, round(avg(CASE WHEN coalesce(first_hit, 11) <= 10 THEN 100.0 ELSE 0 END), 4) AS ann10 "
    "FROM q JOIN embeddings a ON a.vec_id = q.qid LEFT JOIN l USING (qid) GROUP BY 1"
)
def annotation_rank_summary(spark, sf):
    """Share of queries with a row of their own label among the first 1, 5, 10 others, by label."""
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 50 = 0")
    top = sim.top_k(sim.scores(v.select("vec_id", "embedding"), q.select("vec_id", "embedding"), "dot", 11, "vec_id", "embedding"), 11, "qid", "vec_id")
    labels = v.select("vec_id", F.col("label").alias("lb"))
    hit = top.join(labels, "vec_id").join(q.select(F.col("vec_id").alias("qid"), "label"), "qid").where("lb = label AND vec_id <> qid").groupBy("qid").agg(F.min(F.col("rank") - 1).alias("first_hit"))
    rate = lambda k: F.round(F.avg(F.when(F.coalesce("first_hit", F.lit(11)) <= k, 100.0).otherwise(0.0)), 4).alias(f"ann{k}")
    return q.select(F.col("vec_id").alias("qid"), "label").join(hit, "qid", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n"), rate(1), rate(5), rate(10))


PARTS = "b AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_retailprice END AS mass, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS c, 2 * p_size AS h FROM part)"


def part_bank(spark, sf):
    """Parts as a bank with a nullable mass and a nullable map of element counts."""
    p = table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice")
    elems = F.when(F.col("p_size") % 7 != 0, F.create_map(F.lit("C"), F.col("p_size"), F.lit("H"), 2 * F.col("p_size")))
    return p.select("p_partkey", F.when(F.col("p_size") % 10 != 0, F.col("p_retailprice")).alias("mass"), elems.alias("elems"))


def in_range(mass: str, lo: float, hi: float):
    """Both ends count; an unknown mass is kept."""
    return F.col(mass).isNull() | F.col(mass).between(lo, hi)


def in_counts(elems: str, bounds: dict[str, tuple[int, int]]):
    """Every element's count (absent: 0) within its bounds; an unknown map is kept."""
    ok = F.lit(True)
    for e, (lo, hi) in bounds.items():
        ok = ok & F.coalesce(F.try_element_at(elems, F.lit(e)), F.lit(0)).between(lo, hi)
    return F.col(elems).isNull() | ok


@query(f"WITH {PARTS} SELECT p_partkey, mass FROM b WHERE mass IS NULL OR mass BETWEEN 1000 AND 1500")
def filter_range_null_kept(spark, sf):
    return part_bank(spark, sf).where(in_range("mass", 1000.0, 1500.0)).select("p_partkey", "mass")


@query(f"WITH {PARTS} SELECT p_partkey FROM b WHERE c IS NULL OR (c BETWEEN 10 AND 30 AND h BETWEEN 0 AND 50)")
def filter_map_null_kept(spark, sf):
    return part_bank(spark, sf).where(in_counts("elems", {"C": (10, 30), "H": (0, 50), "N": (0, 0)})).select("p_partkey")


@query(f"WITH {PARTS} SELECT p_partkey, mass FROM b WHERE (mass IS NULL OR mass BETWEEN 1000 AND 1500) AND (c IS NULL OR c BETWEEN 10 AND 30) ORDER BY mass DESC NULLS LAST, p_partkey LIMIT 25")
def topk_filtered_both(spark, sf):
    """Top 25 by mass of what both filters keep (fewer, if fewer are left)."""
    kept = part_bank(spark, sf).where(in_range("mass", 1000.0, 1500.0) & in_counts("elems", {"C": (10, 30)}))
    return kept.orderBy(F.col("mass").desc_nulls_last(), "p_partkey").limit(25).select("p_partkey", "mass")


@query(
    f"WITH {OVER}, gone AS (SELECT col FROM voc WHERE token IN ('the', 'and', 'tion')), q2 AS (SELECT qid, col FROM q WHERE col NOT IN (SELECT col FROM gone)), nq2 AS (SELECT nq.qid, count(q2.col) AS nq FROM nq LEFT JOIN q2 USING (qid) GROUP BY 1), "
    "m2 AS (SELECT qid, b.doc_id, count(*) AS inter FROM q2 JOIN bank b USING (col) GROUP BY ALL), "
    "s AS (SELECT qid, doc_id, CASE WHEN nq * nnz > 0 THEN coalesce(inter, 0) / sqrt(nq * nnz) ELSE 0 END AS score FROM nq2 CROSS JOIN nnz LEFT JOIN m2 USING (qid, doc_id)) "
    "SELECT qid, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"
)
def fragment_delete_requery(spark, sf):
    """Queries without three parts' features, asked again."""
    bank = bank_of(spark, sf)
    gone = mask_of(bank, F.col("token").isin("the", "and", "tion"))
    q = _queries(bank).withColumn("bits", F.zip_with("bits", gone, lambda x, m: x.bitwiseAND(F.bitwise_not(m))))
    return _nearest(bank.rows, q, "cosine")


def mask_of(bank, chosen):
    """The chosen features of the vocabulary (of bounded size) as a packed literal."""
    words = [0] * (fop.WIDTH // 64)
    for r in bank.vocab.where(chosen).select("col").collect():
        words[r.col >> 6] |= 1 << (r.col & 63)
    return F.array(*[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in words])


@query(
    f"WITH {OVER}, need AS (SELECT col FROM voc WHERE token IN ('with', 'from') AND k = 1), has AS (SELECT doc_id FROM bank JOIN need USING (col) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM need)), "
    f"s AS (SELECT qid, doc_id, {COSINE} AS score FROM ov SEMI JOIN has USING (doc_id)) "
    "SELECT qid, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"
)
def require_region_topk(spark, sf):
    """Top ten among the rows that hold all of the required features."""
    bank = bank_of(spark, sf)
    need = mask_of(bank, F.col("token").isin("with", "from") & (F.col("k") == 1))
    holds = F.forall(F.zip_with("bits", need, lambda x, m: x.bitwiseAND(m) == m), lambda ok: ok)
    return _nearest(bank.rows.where(holds), _queries(bank), "cosine")


@query(
    f"WITH {OVER}, x AS (SELECT qid, doc_id FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round({COSINE}, 9) DESC, doc_id) AS r FROM ov WHERE qid <> doc_id) WHERE r = 1), "
    "a AS (SELECT x.qid, x.doc_id, q.col FROM x JOIN q USING (qid)), c AS (SELECT x.qid, x.doc_id, bank.col FROM x JOIN bank USING (doc_id)), "
    "f AS (SELECT qid, doc_id, col, a.col IS NOT NULL AS ina, c.col IS NOT NULL AS inc FROM a FULL JOIN c USING (qid, doc_id, col)) "
    "SELECT qid, doc_id, CASE WHEN ina AND inc THEN 'shared' WHEN ina THEN 'missing' ELSE 'extra' END AS kind, count(*) AS n, round(avg(h), 6) AS mean_h FROM f JOIN voc USING (col) GROUP BY ALL"
)
def explain_disagreement(spark, sf):
    """Why the nearest other row differs: shared, missing and extra features with their mean entropy."""
    x = neighbours(spark, sf)
    vocab = bank_of(spark, sf).vocab
    either = F.zip_with("bits", "other", lambda a, b: a.bitwiseOR(b))
    f = x.select("qid", "doc_id", "bits", "other", F.explode(fop.columns_of(either)).alias("col")).join(F.broadcast(vocab.select("col", "h")), "col")
    has = lambda c: F.getbit(F.col(c)[F.shiftright("col", 6)], F.col("col").bitwiseAND(63)) == 1
    kind = F.when(has("bits") & has("other"), "shared").when(has("bits"), "missing").otherwise("extra")
    return f.groupBy("qid", "doc_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("h"), 6).alias("mean_h"))


def neighbours(spark, sf):
    """(qid, doc_id, bits, other): each query with its nearest other row and both rows' bits."""
    bank = bank_of(spark, sf)
    top = sim.top_k(sim.scores(bank.rows, _queries(bank), "cosine", 2, "doc_id", "bits").where("qid <> doc_id"), 1).select("qid", "doc_id")
    q = _queries(bank).select(F.col("doc_id").alias("qid"), "bits")
    return top.join(q, "qid").join(bank.rows.select("doc_id", F.col("bits").alias("other")), "doc_id")
