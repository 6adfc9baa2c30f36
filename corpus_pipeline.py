"""Corpus pipeline: each stage reads what its predecessor kept, as Parquet.

Rows stay documents (doc_id, text, lang, source, n_chars) up to the last stage, which returns their
piece ids.  Repeated, null and empty rows are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, pieces, repeats, simhash
from tessera.llm.common import Scratch

#: Words of the shortest passage that is cut where an earlier copy stands, however few bytes they have.
PASSAGE = repeats.PASSAGE


def free(columns: list[str], name: str) -> str:
    """``name``, made longer until no column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is some known language; ``lang`` is the one found."""
    found, score, ok = names = tuple(free(docs.columns, x) for x in ("found", "score", "ok"))
    told = langid.identify(docs, langid.fit(docs), host_col="source", names=names).where(F.col(f"`{ok}`"))
    return told.select(*[F.col(f"`{found}`").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one with the smallest id."""
    return simhash.one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages of 400 bytes or of ``PASSAGE`` words or more; ``n_chars`` counts what is left."""
    out = repeats.deduplicated(docs, keep="first", words=PASSAGE)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, drawn by its id; decoding them gives the text back."""
    keep = [c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns]
    return pieces.segmented(docs, keep=keep)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontamination", decontamination),
    ("segmentation", segmentation),
]

#: Suffix order, sampled segmentations and the language model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
