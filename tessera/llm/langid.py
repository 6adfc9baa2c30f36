"""Operator 1 — language identification by Bayesian fusion of evidence.

log P(l | row) = log P(text | l) + log P(declared | l) + log P(address suffix | l) + log P(l | host)

* text: naive Bayes over hashed byte trigrams, one table of ``BUCKETS`` log probabilities for each
  language, counted over *all* labelled rows by a grouped aggregation (the table's size is fixed;
  overlapping trigrams are tempered by a third);
* declared markup language and address suffix (country suffix or a language segment of the path):
  each names a language with a stated reliability; absent or unknown names are neutral;
* host: priors smoothed down a hierarchy, everything -> suffix -> parent domain -> host, each level
  shrunk to the one above with ``KAPPA`` pseudo-rows.  The counts are sums of text posteriors, by
  grouped aggregation with map-side partial sums, so a host with a third of the rows costs no more.  A row's own
  posterior is taken out of all four levels before they judge it, so its text counts once.

Text evidence is worked out once and written where the text need not go along; hosts with many rows meet their counts by a broadcast, so that what is
shuffled where there are many hosts has no hot key.

A fifth hypothesis, ``und``, spreads its trigrams evenly over the buckets: a row is rejected where
that explains it best, where no language reaches ``FLOOR``, or where the text has no letter.

Defined results: null and empty texts are rejected as ``und``; a null declared language, address or
host is neutral (null hosts share the overall prior); ties go to the language first in the alphabet;
repeated rows are scored alike; with no labelled rows at all every row is ``und``; further columns
pass through; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, texts_of, tidy

BUCKETS = 1 << 16
KAPPA = 8.0
FLOOR = 0.5
RELIABLE = {"declared": 0.9, "suffix": 0.7}
#: log prior of noise against a language
NOISE = -5.0
TEMPER = 1 / 3
#: fixed values: country suffixes of addresses and the language that they stand for
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "nl": "nl", "pl": "pl"}


def _buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram of the lower-cased texts, and for each text how many it has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts).lower(), np.uint8).astype(np.uint32)
    if len(flat) < 3:
        return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
    code = (flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:]
    code *= np.uint32(2654435761)
    code >>= np.uint32(16)
    ends = np.cumsum(sizes)
    inside = np.ones(len(flat), bool)  # trigrams that start in a text's last two bytes cross into the next
    for back in (1, 2):
        at = ends - back
        inside[at[(at >= 0)]] = False
    return code[inside[:-2]], np.maximum(sizes - 2, 0)


def _pieces(texts: list[bytes], most: int = 1 << 22):
    """Runs of texts of a bounded size, so that very long texts don't pile up."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _counts(batches):
    total: dict[str, np.ndarray] = {}
    for b in batches:
        labels, texts = b.column(0).to_pylist(), texts_of(b.column(1))
        for label in set(labels):
            own = [t for l, t in zip(labels, texts) if l == label]
            for run in _pieces(own):
                code, _ = _buckets(run)
                total[label] = total.get(label, 0) + np.bincount(code, minlength=BUCKETS)
    for label, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["label", "bucket", "n"])


class Model:
    """Languages and the table of log probabilities; 4 bytes x languages x ``BUCKETS``, whatever the corpus."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table


def fit(labelled: DataFrame, label_col: str = "lang", text_col: str = "text") -> Model:
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label"), F.col(text_col).cast("string").alias("t"))
    counts = rows.mapInArrow(tidy(_counts), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most languages x BUCKETS rows
    names = found.column("label").to_pylist()
    langs = sorted(set(names))
    table = np.full((len(langs), BUCKETS), 0.5)
    place = {x: i for i, x in enumerate(langs)}
    table[np.array([place[x] for x in names], int), found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    return Model(langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32))


def text_evidence(model: Model) -> "callable":
    """text column -> array<float>: log P(text | l) for each language, then for noise; tempered."""
    cast = None

    def score(column: pa.Array) -> pa.Array:
        nonlocal cast
        table = shared.value
        out = []
        for run in _pieces(texts_of(column)):
            code, n = _buckets(run)
            starts = np.cumsum(n) - n
            own = np.zeros((len(run), len(table) + 1), np.float32)
            has = n > 0
            for k, row in enumerate(table):
                if len(code):
                    own[has, k] = np.add.reduceat(row[code], starts[has])
            own[:, -1] = -np.log(BUCKETS) * n
            out.append(own * TEMPER)
        flat = np.concatenate(out) if out else np.empty((0, len(table) + 1), np.float32)
        width = flat.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, width), pa.int32()), pa.array(flat.ravel()))

    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(model.table)
    score.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "array<float>")


def _evidence(names: list[str], value: Column, reliable: float) -> Column:
    """array of log P(value | l); neutral where value is no known language."""
    known = value.isin(names) if names else F.lit(False)
    other = (1 - reliable) / max(1, len(names) - 1)
    return F.array(*[F.when(F.coalesce(known, F.lit(False)), F.when(value == x, F.lit(float(np.log(reliable)))).otherwise(F.lit(float(np.log(other))))).otherwise(F.lit(0.0)) for x in names])


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once a row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _posterior(logs: Column) -> Column:
    def of(l: Column) -> Column:
        odds = _bound(F.array_max(l), lambda top: F.transform(l, lambda x: F.exp(x - top)))
        return _bound(odds, lambda o: _bound(_total(o), lambda t: F.transform(o, lambda x: x / t)))

    return _bound(logs, of)


def host_of(address: str) -> Column:
    found = F.lower(F.regexp_extract(F.col(address), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def suffix_language(address: str) -> Column:
    last = F.regexp_extract(host_of(address), r"([a-z]+)$", 1)
    by_suffix = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[last]
    segment = F.regexp_extract(F.lower(F.col(address)), r"^[^:]*://[^/]+/([a-z]{2})(?:/|$)", 1)
    return F.coalesce(F.when(segment != "", segment), by_suffix)


def host_counts(rows: DataFrame, k: int, host_col: str, post_col: str, scratch: Scratch) -> tuple[DataFrame, list[float]]:
    """((host, rows, own, parent, suffix), total): sums of posteriors for each host and the levels above it, and over all."""
    sums = [F.sum(F.col(post_col)[i]).alias(f"n{i}") for i in range(k)]
    again = [F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]
    as_array = F.array(*[F.coalesce(f"n{i}", F.lit(0.0)) for i in range(k)])
    h = scratch.save(rows.groupBy(F.col(host_col).alias("host")).agg(*sums, F.count(F.lit(1)).alias("rows")), "hosts")
    h = h.withColumn("parent", F.when(F.size(F.split("host", r"\.")) > 2, F.regexp_replace("host", r"^[^.]*\.", "")).otherwise(F.col("host"))).withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))
    total = h.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0.0)) for i in range(k)]).first()
    by_suffix = h.groupBy("suffix").agg(*again).select("suffix", as_array.alias("of_suffix"))
    by_parent = h.groupBy("parent").agg(*again).select("parent", as_array.alias("of_parent"))
    out = h.select("host", "rows", "parent", "suffix", as_array.alias("own")).join(by_suffix, "suffix", "left").join(by_parent, "parent", "left")
    return scratch.save(out.select("host", "rows", "own", "of_parent", "of_suffix"), "counts"), list(total)


def host_prior(total: list[float], post: Column) -> Column:
    """array of log P(l | host) of a row with counts ``own``, ``of_parent``, ``of_suffix``, its own posterior left out."""
    k = len(total)

    def shrunk(counts: Column, above: Column) -> Column:
        left = F.zip_with(counts, post, lambda n, p: F.greatest(n - p, F.lit(0.0)))
        return _bound(left, lambda n: _bound(_total(n) + KAPPA, lambda t: F.zip_with(n, above, lambda x, a: (x + KAPPA * a) / t)))

    def below(level: str):
        return lambda p: F.when(F.col(level).isNull(), p).otherwise(shrunk(F.col(level), p))

    p = shrunk(F.array(*[F.lit(float(x)) for x in total]), F.array(*[F.lit(1 / k)] * k))
    for level in ("of_suffix", "of_parent", "own"):  # a null host has no levels: the overall prior
        p = _bound(p, below(level))
    return F.transform(p, lambda x: F.log(x))


#: Hosts with at least this share of the rows (so at most as many hosts) are broadcast; and all of them up to so many.
HOT_SHARE, BROADCAST_HOSTS = 1e-4, 200_000


def _with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with the counts of their _host; null hosts get those of no host."""
    told = counts.where("host IS NOT NULL").withColumnRenamed("host", "_h")
    n, hosts = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("host")).first()
    levels = ["own", "of_parent", "of_suffix"]
    on = F.col("_host") == F.col("_h")
    if hosts <= BROADCAST_HOSTS:
        return rows.join(F.broadcast(told), on, "left").drop("_h", "rows")
    hot = told.where(F.col("rows") >= max(1, n * HOT_SHARE))
    first = rows.join(F.broadcast(hot), on, "left")
    done = first.where(F.col("_h").isNotNull() | F.col("_host").isNull()).drop("_h", "rows")
    rest = first.where(F.col("_h").isNull() & F.col("_host").isNotNull()).drop("_h", "rows", *levels)
    return done.unionByName(rest.join(told, on, "left").drop("_h", "rows"))


def identify(df: DataFrame, model: Model, text_col: str = "text", declared_col: str | None = None, address_col: str | None = None, host_col: str | None = None, carry: list[str] | None = None, names: tuple[str, str, str] = ("_lang", "_lang_score", "_lang_ok")) -> DataFrame:
    """Columns ``carry`` (all by default), then the language string, its score double and whether the row is accepted boolean, called ``names``.

    Without the text among ``carry`` the rows are written once with their text evidence; with it the evidence is worked
    out twice, for the hosts and for the rows.
    """
    carry = df.columns if carry is None else carry
    kept = [F.col(f"`{c}`") for c in carry]
    if not model.langs:
        return df.select(*kept, F.lit("und").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(False).alias(names[2]))
    scratch, langs, k = Scratch(df.sparkSession, "langid"), model.langs, len(model.langs)
    text = F.col(text_col).cast("string")
    host = F.col(host_col) if host_col else host_of(address_col) if address_col else F.lit(None).cast("string")
    parts = []
    if declared_col:
        parts.append(_evidence(langs, F.lower(F.col(declared_col)), RELIABLE["declared"]))
    if address_col:
        parts.append(_evidence(langs, suffix_language(address_col), RELIABLE["suffix"]))
    other = F.array(*[sum((p[i] for p in parts), F.lit(0.0)) for i in range(k)])
    inner = [f"_c{i}" for i in range(len(carry))]  # whatever the columns are called
    marked = df.select(*[c.alias(n) for c, n in zip(kept, inner)], text_evidence(model)(text).alias("_text"), host.alias("_host"), other.alias("_other"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    if text_col not in carry:  # else the texts themselves would be written once more, which costs more than their evidence
        marked = scratch.save(marked, "marked")
    marked = marked.withColumn("_own", F.slice("_text", 1, k).cast("array<double>"))
    marked = marked.withColumn("_post", _posterior(F.col("_own")))
    counts, total = host_counts(marked.select("_host", "_post"), k, "_host", "_post", scratch)
    joined = _with_counts(marked, counts).withColumn("_prior", host_prior(total, F.col("_post")))
    logs = F.array(*[F.col("_own")[i] + F.col("_other")[i] + F.col("_prior")[i] for i in range(k)], F.col("_text")[k].cast("double") + F.lit(NOISE))
    joined_all = joined.withColumn("_all", _posterior(logs)).withColumn("_best", F.array_max(F.slice("_all", 1, k)))
    # never false: a projection that isn't deterministic keeps a caller's filter above it, which would work all of this out again
    best = F.when(F.rand() >= 0, F.col("_best"))
    ok = F.col("_letters") & (F.col("_best") >= FLOOR) & (F.col("_best") >= F.col("_all")[k])
    name = F.array(*[F.lit(x) for x in langs])[F.array_position(F.slice("_all", 1, k), F.col("_best")).cast("int") - 1]
    return joined_all.select(*[F.col(n).alias(c) for c, n in zip(carry, inner)], F.when(ok, name).otherwise("und").alias(names[0]), best.alias(names[1]), ok.alias(names[2]))


def visible_text(html: str) -> Column:
    bare = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")


def query(spark, sf_dir: str) -> DataFrame:
    """Pages with all four kinds of evidence and documents with text and source; ids of the other table are null."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    model = fit(docs)
    none = F.lit(None)
    a = docs.select("doc_id", none.cast("long").alias("page_id"), "text", none.cast("string").alias("declared"), none.cast("string").alias("url"), F.col("source").alias("host"))
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    b = pages.select(none.cast("long").alias("doc_id"), "page_id", visible_text("html").alias("text"), declared.alias("declared"), "url", host_of("url").alias("host"))
    out = identify(a.union(b), model, declared_col="declared", address_col="url", host_col="host", carry=["doc_id", "page_id"])
    return out.select("doc_id", "page_id", F.col("_lang").alias("lang"), F.col("_lang_score").alias("score"), F.col("_lang_ok").alias("kept"))
