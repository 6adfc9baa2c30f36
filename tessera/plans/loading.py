"""Sources and sinks on files of their own kinds, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import bank as bk
from tessera.operators import pipeline as op
from tessera.operators import sinks
from tessera.operators.bank import bank_of
from tessera.operators.numbering import quantiles
from tessera.operators.shared import new_folder
from tessera.plans.features import BANK
from tessera.registry import query
from tessera.sources import readers
from tessera.sources.tables import table


def _one_file(spark, name: str, rows: list[str]) -> str:
    """A small text file, its lines in order."""
    path = new_folder(spark, name)
    spark.createDataFrame([("\n".join(rows),)], "value string").coalesce(1).write.text(path)
    return path


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount = 0.1)")
def jsonl_id_filter(spark, sf):
    """JSON lines read for the ids that another table asks for."""
    path = new_folder(spark, "jsonl")
    table(spark, sf, "orders", "o_orderkey", "o_totalprice").write.json(path)
    ids = table(spark, sf, "lineitem").where("l_discount = 0.1").select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.records(spark, path, "o_orderkey long, o_totalprice double", ids, "o_orderkey")


@query("SELECT o_custkey AS key, max(o_orderkey) AS last_order, min(o_orderkey) AS first_order FROM orders WHERE o_custkey % 9 <> 0 GROUP BY 1")
def jsonl_by_place(spark, sf):
    """First and last record of each key by (file, line) in gzipped JSON lines; records without a key go."""
    path = new_folder(spark, "places")
    o = table(spark, sf, "orders").select(F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("key"), "o_orderkey")
    o.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.json(path, compression="gzip")
    last = readers.json_last(spark, path, "key long, o_orderkey long", "key").toDF("key", "last_order")
    return last.join(readers.json_last(spark, path, "key long, o_orderkey long", "key", first=True).toDF("key", "first_order"), "key")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def json_arrays_or_none(spark, sf):
    """Files of one array each, united with those of a folder that isn't there."""
    path = new_folder(spark, "arrays")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    s.groupBy((F.col("id") % 3).alias("g")).agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("value")).select("value").repartition(3).write.text(path)
    here, gone = (readers.json_arrays(spark, p, "id long, name string") for p in (path, path + "-missing"))
    return here.unionByName(gone).select("id", "name")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS key, kind FROM nation, (VALUES ('list'), ('records'), ('strings')) t(kind) WHERE kind <> 'records' OR n_nationkey % 5 <> 0")
def key_maps(spark, sf):
    """One key map in three shapes: a list, an object of records, an object of strings."""
    n = table(spark, sf, "nation").orderBy("n_nationkey").collect()  # 25 rows
    q = lambda s: '"' + s + '"'
    record = lambda r: "{}" if r.n_nationkey % 5 == 0 else f'{{"smiles": {q(r.n_name)}}}' if r.n_nationkey % 2 else f'{{"smiles": null, "canonical_2d_smiles": {q(r.n_name)}}}'
    texts = {
        "list": "[" + ", ".join(q(r.n_name) for r in n) + "]",
        "records": "{" + ", ".join(f'"{r.n_nationkey}": {record(r)}' for r in n) + ', "note": {"smiles": "x"}}',
        "strings": "{" + ", ".join(f'"{r.n_nationkey}": {q(r.n_name)}' for r in n) + "}",
    }
    out = None
    for kind, text in texts.items():
        k = readers.key_map(spark, _one_file(spark, "keys", [text])).withColumn("kind", F.lit(kind))
        out = k if out is None else out.unionByName(k)
    return out


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey * 1.5 AS DOUBLE) AS fresh, CAST(n_nationkey AS DOUBLE) AS rebuilt, CAST(NULL AS DOUBLE) AS off FROM nation")
def sidecar_lists(spark, sf):
    """A list aligned by position; a stale one is rebuilt or switched off."""
    ids = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    n = ids.count()
    whole = _one_file(spark, "sidecar", ["[" + ", ".join(str(i * 1.5) for i in range(n)) + "]"])
    stale = _one_file(spark, "sidecar", ["[1.0, 2.0]"])
    a = readers.aligned(ids, spark, whole, "fresh")
    b = readers.aligned(ids, spark, stale, "rebuilt", lambda x: x.withColumn("rebuilt", F.col("id").cast("double")))
    return a.join(b, "id").join(readers.aligned(ids, spark, stale, "off"), "id")


@query("SELECT kind, block, CAST(f2 AS DOUBLE) AS f2, CAST(f1 AS DOUBLE) AS f1, CAST(intensity AS DOUBLE) AS intensity FROM (VALUES ('h_nmr', 0, 7.26, NULL, NULL), ('h_nmr', 0, 1.5, NULL, NULL), ('h_nmr', 1, 3.3, NULL, NULL), ('c_nmr', 0, 128.4, NULL, NULL), ('hsqc', 0, 7.1, 128.0, 1.0), ('hsqc', 1, 3.5, 55.0, -1.0), ('hsqc', 1, 2.5, 30.0, 2.0)) t(kind, block, f2, f1, intensity)")
def pasted_tables(spark, sf):
    """Peak tables from a clipboard: blocks side by side, kind told by header and range."""
    files = (["Report", "\tppm\tH\t\tppm\tH", "1\t7.26\t1\t\t3.3\t2", "2\t1.5\t3\t\t\t"], ["ppm", "128.4", "n/a"], ["f2 (ppm)\tf1 (ppm)\tIntensity\t\tf2 (ppm)\tf1 (ppm)\tIntensity", "7.1\t128.0\t1.0\t\t3.5\t55.0\t-1.0", "7.2\t\t1.0\t\t2.5\t30.0\t2.0"])
    out = None
    for rows in files:
        p = readers.pasted(spark, _one_file(spark, "paste", rows)).select("kind", "block", "f2", "f1", "intensity")
        out = p if out is None else out.unionByName(p)
    return out


@query("SELECT 'N' || n_nationkey AS accession, n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN '10.1000/ab.' || n_nationkey WHEN 1 THEN '10.1000/x|10.1000/y' ELSE '' END AS dois, CASE n_nationkey % 3 WHEN 1 THEN '1234567' ELSE '' END AS pmids FROM nation")
def nested_dump(spark, sf):
    """A nested dump flattened: one reference, a list of them, or none."""
    records = []
    for r in table(spark, sf, "nation").collect():  # 25 rows
        ref = ('"general_references": {"reference": {"reference_text": "See 10.1000/ab.%d."}}, ' % r.n_nationkey, '"general_references": {"reference": [{"reference_text": "(10.1000/y) PMID: 1234567"}, {"reference_text": "10.1000/x, 10.1000/y"}, {"reference_text": null}]}, ', "")[r.n_nationkey % 3]
        records.append('{%s"accession": "N%d", "name": "%s"}' % (ref, r.n_nationkey, r.n_name))
    path = _one_file(spark, "dump", ['{"db": {"product": [' + ", ".join(records) + "]}}"])
    out = readers.references(spark, path, "$.db.product")
    return out.select("accession", "name", F.array_join("dois", "|").alias("dois"), F.array_join("pmids", "|").alias("pmids"))


@query("SELECT * FROM (VALUES (0, 'a', 'A', FALSE), (2, 'b', 'b', TRUE), (4, 'c.1', 'C', FALSE)) t(pos, id, label, is_default)")
def model_manifest(spark, sf):
    """Models listed once each, bad ids dropped, one default."""
    text = '[{"id": "a", "label": "A"}, {"id": "no good"}, {"id": "b", "default": true}, {"id": "a", "label": "again", "default": true}, {"id": "c.1", "label": "C", "default": true}, {"label": "nameless"}]'
    return readers.manifest(spark, _one_file(spark, "manifest", [text]))


@query("SELECT 'm' || n_nationkey AS model, CASE WHEN n_nationkey % 2 = 0 THEN 'c_nmr+hsqc' ELSE 'hsqc' END AS combo, 'sim' AS eval_set, 'test' AS split, CAST(10 + n_nationkey AS BIGINT) AS n, round(n_nationkey / 50, 6) AS mean_cos FROM nation WHERE n_nationkey < 4")
def model_measurements(spark, sf):
    """Measurements from a metrics file in each model's folder."""
    root = new_folder(spark, "metrics")
    for r in table(spark, sf, "nation").where("n_nationkey < 4").collect():
        k = r.n_nationkey
        mods = '["hsqc", "c_nmr"]' if k % 2 == 0 else '["hsqc"]'
        text = '{"measurements": [{"modalities": %s, "eval_set": "sim", "split": "test", "n": %d, "metrics": {"mean_cos": %s}}]}' % (mods, 10 + k, k / 50)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/m{k}")
    return readers.measurements(spark, f"{root}/*").withColumn("mean_cos", F.round("mean_cos", 6))


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_tax) - 1 AS INTEGER) AS i, CAST(l_quantity AS DOUBLE) AS first_value FROM lineitem")
def ragged_predictions(spark, sf):
    """Predictions kept as one flat array with starts, cut back into rows."""
    cell = F.struct("l_linenumber", F.array("l_quantity", "l_tax").alias("v"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    flat = g.select("l_orderkey", F.flatten(F.transform("c", lambda x: x["v"])).alias("values"), F.transform(F.sequence(F.lit(0), F.size("c")), lambda i: i * 2).alias("starts"))
    return readers.ragged(flat, "l_orderkey", "values", "starts").select("l_orderkey", "i", F.col("part")[0].alias("first_value"))


@query("SELECT DISTINCT substring(c_name, 1, 14) AS prefix FROM customer UNION SELECT DISTINCT substring(s_name, 1, 14) FROM supplier")
def blacklist_prefixes(spark, sf):
    """Key prefixes of several lists."""
    root = new_folder(spark, "blacklist")
    table(spark, sf, "customer").select(F.col("c_name").alias("inchikey")).write.csv(f"{root}/a", sep="\t", header=True)
    table(spark, sf, "supplier").select(F.col("s_name").alias("inchikey")).write.csv(f"{root}/b", sep="\t", header=True)
    return readers.prefixes(spark, f"{root}/*", "inchikey")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, r_name || '|' || 'x' || n_nationkey % 2 AS labels FROM nation JOIN region ON r_regionkey = n_regionkey")
def interned_annotations(spark, sf):
    """An annotation file whose ids are checked against its label table."""
    regions = [r.r_name for r in table(spark, sf, "region").orderBy("r_regionkey").collect()]
    rows = [f"[{r.n_regionkey}, {5 + r.n_nationkey % 2}]" for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]
    labels = ", ".join(f'"{x}"' for x in [*regions, "x0", "x1"])
    path = _one_file(spark, "annotations", ['{"labels": [' + labels + '], "rows": [' + ", ".join(rows) + "]}"])
    return readers.annotations(spark, path).select("id", F.array_join("labels", "|").alias("labels"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS shift, CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END AS phase FROM part")
def peak_csv_phase(spark, sf):
    """Peak CSV under other headers; a missing phase is +1."""
    path = new_folder(spark, "peaks")
    table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("1H_Shift"), F.when(F.col("p_size") % 2 == 0, "-1").alias("PHASE")).write.csv(path, header=True)
    s = readers.synonyms(spark, path, {"key": ["p_partkey"], "shift": ["h_ppm", "1h_shift"], "phase": ["Phase", "sign"]})
    return s.select(F.col("key").cast("long").alias("p_partkey"), F.col("shift").try_cast("double").alias("shift"), F.coalesce(F.col("phase").try_cast("int"), F.lit(1)).alias("phase"))


SPLIT = "CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END"


def splits(spark, sf):
    d = table(spark, sf, "documents", "doc_id")
    return d.select("doc_id", F.expr(SPLIT).alias("split"))


@query(f"WITH {BANK} SELECT {SPLIT} AS split, count(*) AS rows_, CAST(sum(nnz) AS BIGINT) AS postings, CAST(sum(n) AS BIGINT) AS columns_ FROM nnz LEFT JOIN (SELECT doc_id, sum(col) AS n FROM bank GROUP BY 1) USING (doc_id) GROUP BY 1")
def postings_store(spark, sf):
    """Postings written per split and looked up again for all rows; a missing key would be an error."""
    bank = bank_of(spark, sf)
    stored = bk.write_postings(bank, splits(spark, sf), f"{new_folder(spark, 'postings')}/{bank.folder.rsplit('/', 1)[-1]}")
    found = bk.lookup(stored, bank.rows).join(splits(spark, sf), "doc_id")
    return found.groupBy("split").agg(F.count(F.lit(1)).alias("rows_"), F.sum(F.size("cols")).alias("postings"), F.sum(F.aggregate("cols", F.lit(0).cast("long"), lambda s, x: s + x)).alias("columns_"))


@query("SELECT doc_id, n_chars + 1 AS n_chars FROM documents WHERE n_chars > 100")
def versioned_rewrite(spark, sf):
    """A table rewritten twice as new versions, each read through the pointer while the next is made."""
    root = new_folder(spark, "versions")
    sinks.commit(table(spark, sf, "documents", "doc_id", "n_chars"), root)
    sinks.commit(sinks.current(spark, root).where("n_chars > 100").withColumn("n_chars", F.col("n_chars") + 1), root)
    return sinks.current(spark, root)


@query(f"SELECT {SPLIT} AS split, CASE WHEN doc_id % 3 = 0 THEN 'hsqc' ELSE 'c_nmr' END AS modality, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY ALL")
def shards_by_modality(spark, sf):
    """Shards in a folder for each split and modality."""
    d = table(spark, sf, "documents", "doc_id", "n_chars")
    s = d.select(F.col("doc_id").alias("idx"), F.array("n_chars").alias("data"), F.array(F.lit(1)).alias("shape"), F.expr(SPLIT).alias("split"), F.when(F.col("doc_id") % 3 == 0, "hsqc").otherwise("c_nmr").alias("modality"))
    out = sinks.write_shards(s, new_folder(spark, "shards"))
    return out.groupBy("split", "modality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("data")[0]).alias("total"))


@query(f"SELECT {SPLIT} AS split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY 1")
def jsonl_split_routing(spark, sf):
    """JSON lines routed by split."""
    path = new_folder(spark, "routed")
    sinks.write_jsonl(splits(spark, sf), path)
    back = spark.read.schema("doc_id long, split string").json(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT doc_id AS idx, CASE WHEN quality IS NULL THEN 'absent' WHEN quality = 1 THEN 'chnmr' ELSE 'mnova' END AS hsqc, CASE WHEN quality = 1 THEN CAST(doc_id + 1000 AS VARCHAR) ELSE 'none' END AS chnmr_id, CAST(NULL AS VARCHAR) AS chnmr_solvent, quality IS NULL AS is_new FROM documents LEFT JOIN labels USING (doc_id)")
def provenance_file(spark, sf):
    """Provenance with typed nulls, sorted by id, written and read back."""
    d = table(spark, sf, "documents", "doc_id").join(table(spark, sf, "labels", "doc_id", "quality"), "doc_id", "left")
    q = F.col("quality")
    p = d.select(F.col("doc_id").alias("idx"), F.when(q.isNull(), "absent").when(q == 1, "chnmr").otherwise("mnova").alias("hsqc"), F.when(q == 1, F.col("doc_id") + 1000).alias("chnmr_id"), F.lit(None).cast("string").alias("chnmr_solvent"), q.isNull().alias("is_new"))
    path = new_folder(spark, "provenance")
    p.orderBy("idx").write.parquet(path)
    back = spark.read.parquet(path)
    return back.withColumn("chnmr_id", F.coalesce(F.col("chnmr_id").cast("string"), F.lit("none")))


@query("SELECT count(*) AS rows_, round(avg(CAST(lang = 'en' AS INTEGER)), 6) AS english, round(quantile_cont(n_chars, 0.05), 4) AS p5, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.95), 4) AS p95 FROM documents")
def run_report_file(spark, sf):
    """Counts, a share and percentiles as a JSON file, read back."""
    d = table(spark, sf, "documents", "lang", "n_chars")
    q = quantiles(d.withColumn("g", F.lit(0)), ["g"], "n_chars", [0.05, 0.5, 0.95], ["p5", "p50", "p95"])
    n = d.agg(F.count(F.lit(1)).alias("rows_"), F.round(F.avg((F.col("lang") == "en").cast("int")), 6).alias("english"))
    path = f"{new_folder(spark, 'report')}/report.json"
    sinks.report(n.crossJoin(q.select(*[F.round(c, 4).alias(c) for c in ("p5", "p50", "p95")])), path)
    return spark.read.schema("rows_ long, english double, p5 double, p50 double, p95 double").json(path, multiLine=True)


@query("SELECT l_orderkey AS idx, '[' || string_agg(CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber || '.0' ELSE '[' || l_linenumber || '.0,' || CAST(l_quantity AS INTEGER) || '.0]' END, ',' ORDER BY l_linenumber, l_quantity) || ']' AS json FROM lineitem GROUP BY 1")
def shards_to_jsonl(spark, sf):
    """Flat shards as JSON: lists of numbers where a row is one wide, else lists of rows."""
    two = F.col("l_orderkey") % 2 == 1
    cell = F.struct("l_linenumber", F.when(two, F.array(F.col("l_linenumber").cast("double"), F.floor("l_quantity").cast("double"))).otherwise(F.array(F.col("l_linenumber").cast("double"))).alias("v"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    s = g.select(F.col("l_orderkey").alias("idx"), F.flatten(F.transform("c", lambda x: x["v"])).alias("data"), F.array(F.size("c"), F.when(two, 2).otherwise(1)).alias("shape"))
    return sinks.squeezed(s)


@query("SELECT vec_id AS idx, CAST(coalesce(sum(len(embedding)) OVER (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, len(embedding) AS n FROM embeddings")
def packed_store(spark, sf):
    """Shards packed end to end with their starts; a second packing keeps the first, and the store prefers the pack."""
    folder = new_folder(spark, "store")
    op.shards(table(spark, sf, "embeddings"), "vec_id", "embedding").write.parquet(f"{folder}/shards")
    sinks.pack(spark.read.parquet(f"{folder}/shards"), f"{folder}/packed")
    packed = sinks.pack(sinks.open_store(spark, folder).where("idx < 0"), f"{folder}/packed")
    return packed.select("idx", "start", F.size("data").cast("long").alias("n"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, p_size FROM part WHERE p_size > 40")
def listing_outputs(spark, sf):
    """A queue written as CSV, text and Markdown; the text is read back."""
    folder = new_folder(spark, "listing")
    p = table(spark, sf, "part").where("p_size > 40").select("p_partkey", "p_name", "p_size")
    sinks.write_listing(p, folder, [F.desc("p_size"), F.col("p_partkey")])
    return spark.read.csv(f"{folder}/txt", sep="\t", schema="p_partkey long, p_name string, p_size int")


@query("SELECT r_regionkey, r_name FROM region")
def best_effort_cache(spark, sf):
    """A cache in a folder that is taken already: a warning, and the rows all the same."""
    r, path = table(spark, sf, "region"), new_folder(spark, "cache")
    sinks.cached(r, path)
    return sinks.cached(r, path)
