"""Readers with fixed schemas: CSV, whitespace text, JSON lines and arrays, TSV, header synonyms."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str, rename: dict[str, str] | None = None, **options) -> DataFrame:
    """CSV with a header and fields of up to a million characters."""
    df = spark.read.csv(path, schema=schema, header=True, maxCharsPerColumn=1_000_000, **options)
    return df.select(*[F.col(a).alias(b) for a, b in rename.items()]) if rename else df


def fields(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Whitespace-separated text; lines with fewer fields are dropped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= len(names))
    return parts.select(*[F.col("f")[i].alias(n) for i, n in enumerate(names)])


def json_lines(spark: SparkSession, path: str, schema: str, multi: bool = False) -> DataFrame:
    """JSON lines (gzip read through), or files of one array each; adds file name and a sequence inside the file."""
    df = spark.read.schema(schema).json(path, multiLine=multi)
    return df.withColumn("_file", F.input_file_name()).withColumn("_seq", F.monotonically_increasing_id())


def structures(spark: SparkSession, path: str, names: tuple[str, str] = ("id", "key")) -> DataFrame:
    """Two-column TSV whose header, if any, is known by a first field that isn't all digits."""
    df = spark.read.csv(path, sep="\t", schema=", ".join(f"{n} string" for n in names))
    return df.where(F.col(names[0]).rlike(r"^\d+$"))


def prefixes(spark: SparkSession, path: str, column: str, width: int = 14) -> DataFrame:
    """Distinct key prefixes of a blacklist of TSV files."""
    return spark.read.csv(path, sep="\t", header=True).select(F.substring(column, 1, width).alias("prefix")).distinct()


def synonyms(spark: SparkSession, path: str, wanted: dict[str, list[str]]) -> DataFrame:
    """CSV whose headers go by several names: the first synonym that is there, whatever its case; else null."""
    df = spark.read.csv(path, header=True)
    have = {c.lower(): c for c in df.columns}
    pick = {n: next((have[s.lower()] for s in names if s.lower() in have), None) for n, names in wanted.items()}
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(n) for n, c in pick.items()])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or a glob) names anything."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON array each; a path that isn't there gives no rows, and a warning."""
    if not exists(spark, path):
        warnings.warn(f"{path} is missing: no rows", stacklevel=2)
        return spark.createDataFrame([], f"{schema}, _file string, _seq long")
    return json_lines(spark, path, schema, multi=True)


def records(spark: SparkSession, path: str, schema: str, ids: DataFrame, key: str) -> DataFrame:
    """JSON lines whose key is among ``ids``."""
    return spark.read.schema(schema).json(path).join(ids.select(key).distinct(), key, "left_semi")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _line, value): lines of text with their places, file by file."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_file"), F.split("value", "\n").alias("l"))
    return lines.select("_file", F.posexplode("l").alias("_line", "value")).where("value <> ''")


def json_last(spark: SparkSession, path: str, schema: str, key: str, first: bool = False) -> DataFrame:
    """JSON lines (gzip read through) of a folder: the last record of each key by (file, line), or the first; null keys go."""
    rows = numbered_lines(spark, path).select("_file", "_line", F.from_json("value", schema).alias("r")).where(F.col(f"r.{key}").isNotNull())
    pick = (F.min_by if first else F.max_by)("r", F.struct("_file", "_line"))
    return rows.groupBy(F.col(f"r.{key}").alias("_k")).agg(pick.alias("r")).select("r.*")


def key_map(spark: SparkSession, path: str) -> DataFrame:
    """(id long, key string) of a JSON file that is a list or an object of strings or of records with ``smiles`` or ``canonical_2d_smiles``.

    A list counts places; an object's keys that aren't whole numbers go; a file without any entry is an error.
    """
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    flat = text.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    value = F.coalesce(F.try_variant_get("value", "$.smiles", "string"), F.try_variant_get("value", "$.canonical_2d_smiles", "string"), F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string")))
    out = flat.select(F.coalesce(F.col("key").try_cast("long"), F.when(F.col("key").isNull(), F.col("pos").cast("long"))).alias("id"), value.alias("key")).where("id IS NOT NULL AND key IS NOT NULL")
    if out.limit(1).count() == 0:
        raise ValueError(f"{path} has no entries")
    return out


def aligned(ids: DataFrame, spark: SparkSession, path: str, name: str, rebuild=None) -> DataFrame:
    """``ids`` (id) with column ``name`` from a JSON list aligned by position; a list of another length is stale.

    Stale or missing: ``rebuild(ids)`` gives the rows anew, or without it the column is null for all.
    """
    n = ids.count()
    values = None
    if exists(spark, path):
        text = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<double>").alias("v"))
        values = text if (text.select(F.size("v")).first() or [None])[0] == n else None
    if values is None:
        return rebuild(ids) if rebuild else ids.withColumn(name, F.lit(None).cast("double"))
    placed = values.select(F.posexplode("v").alias("p", name)).select(F.col("p").cast("long").alias("id"), name)
    return ids.join(placed, "id", "left")


def pasted(spark: SparkSession, path: str) -> DataFrame:
    """(kind, pos, f2, f1, intensity) of a peak table copied as TSV, its columns in blocks side by side.

    A header with ``f2 (ppm)`` starts blocks of three, one with ``ppm`` blocks of one; rows with a hole go.  A
    one-dimensional table is of protons if every shift lies in [-2, 16].  No such header is an error.
    """
    rows = numbered_lines(spark, path).withColumn("c", F.transform(F.split("value", "\t"), lambda x: F.trim(x))).select("_line", "c")
    heads = rows.where(F.exists("c", lambda x: F.lower(x).isin("f2 (ppm)", "ppm"))).orderBy("_line").limit(1).collect()
    if not heads:
        raise ValueError("no peak table: a header with ppm or f2 (ppm) is missing")
    names = [x.lower() for x in heads[0].c]
    two = "f2 (ppm)" in names
    at = [i for i, x in enumerate(names) if x == ("f2 (ppm)" if two else "ppm")]
    cell = lambda i: F.try_element_at("c", F.lit(i + 1)).try_cast("double")
    width = 3 if two else 1
    blocks = F.array(*[F.struct(F.lit(b).alias("b"), *[(cell(i + k) if k < width else F.lit(None).cast("double")).alias(n) for k, n in enumerate(("f2", "f1", "intensity"))]) for b, i in enumerate(at)])
    peaks = rows.where(F.col("_line") > heads[0]._line).select("_line", F.inline(blocks)).where(" AND ".join(f"{n} IS NOT NULL" for n in ("f2", "f1", "intensity")[:width]))
    proton = peaks.agg(F.bool_and(F.col("f2").between(-2, 16))).first()[0]
    kind = "hsqc" if two else "h_nmr" if proton else "c_nmr"
    return peaks.select(F.lit(kind).alias("kind"), F.col("b").alias("block"), F.col("_line").alias("line"), "f2", "f1", "intensity")


def references(spark: SparkSession, path: str, at: str) -> DataFrame:
    """(accession, name, refs, dois, pmids) of a nested JSON dump; ``at`` is the path of its list of records.

    A record's references may be one object, a list of them, or missing; the two kinds of id are sorted sets.
    """
    text = spark.read.text(path, wholetext=True).select(F.variant_get(F.parse_json("value"), at, "variant").alias("v"))
    rows = text.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("value").alias("r"))
    get = lambda p, kind="string": F.try_variant_get("r", p, kind)
    one = F.transform(F.array(get("$.general_references.reference.reference_text")), lambda x: x)
    many = F.transform(get("$.general_references.reference", "array<variant>"), lambda x: F.try_variant_get(x, "$.reference_text", "string"))
    refs = F.filter(F.coalesce(many, one), lambda x: F.coalesce(x, F.lit("")) != "")
    out = rows.select(get("$.accession").alias("accession"), get("$.name").alias("name"), refs.alias("refs")).withColumn("t", F.array_join("refs", " "))
    dois = F.transform(F.regexp_extract_all("t", F.lit(r"\b(10\.\d{4,9}/[^\s\"<>,;)\]]+)"), F.lit(1)), lambda d: F.regexp_replace(d, r"\.+$", ""))
    pmids = F.regexp_extract_all("t", F.lit(r"(?i)\bPMID:?\s*(\d{6,9})\b"), F.lit(1))
    return out.select("accession", "name", "refs", F.array_sort(F.array_distinct(dois)).alias("dois"), F.array_sort(F.array_distinct(pmids)).alias("pmids"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, is_default) of a JSON list of models: bad ids go, of repeated ones the first stays, one is the default (the first marked, else the first)."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<id:string,label:string,default:boolean>>")).alias("pos", "m"))
    good = text.select("pos", "m.*").where(F.col("id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"))
    once = good.groupBy("id").agg(F.min(F.struct("pos", "label", "default")).alias("m")).select("id", "m.pos", "m.label", F.coalesce("m.default", F.lit(False)).alias("d"))
    chosen = once.agg(F.min(F.struct(~F.col("d"), F.col("pos"), F.col("id")))["id"].alias("chosen"))
    return once.crossJoin(F.broadcast(chosen)).select("pos", "id", F.coalesce("label", "id").alias("label"), (F.col("id") == F.col("chosen")).alias("is_default"))


def measurements(spark: SparkSession, path: str) -> DataFrame:
    """(model, combo, eval_set, split, n, mean_cos) of a folder of metrics files, one folder a model; combos in sorted order."""
    kind = "measurements array<struct<modalities:array<string>,eval_set:string,split:string,n:bigint,metrics:struct<mean_cos:double>>>"
    rows = spark.read.schema(kind).json(path, multiLine=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("model"), F.explode("measurements").alias("m"))
    return rows.select("model", F.array_join(F.array_sort("m.modalities"), "+").alias("combo"), "m.eval_set", "m.split", "m.n", "m.metrics.mean_cos")


def ragged(flat: DataFrame, key: str, values: str, starts: str) -> DataFrame:
    """(key, i, part): rows of one flat array cut at its starts (one more start than rows)."""
    cut = lambda i: F.slice(F.col(values), F.col(starts)[i] + 1, F.col(starts)[i + 1] - F.col(starts)[i])
    parts = F.transform(F.sequence(F.lit(0), F.size(starts) - 2), lambda i: F.struct(i.alias("i"), cut(i).alias("part")))
    return flat.where(F.size(starts) > 1).select(key, F.inline(parts))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(id, labels) of a JSON file {labels: [...], rows: [[...], ...]}; an id outside the label table is an error."""
    from tessera.functions.arrays import labels_of

    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "labels array<string>, rows array<array<int>>").alias("a")).select("a.*")
    rows = text.select("labels", F.posexplode("rows").alias("id", "ids"))
    return rows.select(F.col("id").cast("long").alias("id"), labels_of(F.col("ids"), F.col("labels")).alias("labels"))


#: Kind of source -> its reader; a kind that nobody reads is an error.
LOADERS = {"csv": csv, "fields": fields, "jsonl": json_lines, "json": json_arrays, "tsv": structures, "key_map": key_map, "paste": pasted, "references": references, "manifest": manifest, "metrics": measurements, "annotations": annotations, "prefixes": prefixes, "synonyms": synonyms}


def load(spark: SparkSession, kind: str, path: str, *args, **options) -> DataFrame:
    """Read ``path`` with the reader of its kind."""
    if kind not in LOADERS:
        raise NotImplementedError(f"no reader for {kind!r}; there are {', '.join(sorted(LOADERS))}")
    return LOADERS[kind](spark, path, *args, **options)
