"""The bank: vocabulary and packed rows as two Parquet tables, built once and read by every query.

``build`` writes both under a folder of their own; ``Bank.read`` opens them.  Postings per split are
written beside them by ``write_postings``; the folder's name holds the vocabulary's strategy and size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import features as op
from tessera.operators.shared import new_folder, saved, signature

#: Files (by their state) -> folder of the bank built from them in this application.
_BUILT: dict[tuple[str, str], str] = {}


@dataclass
class Bank:
    """vocab (token, k, df, h, col) and rows (doc_id, bits, nnz), both from files."""

    vocab: DataFrame
    rows: DataFrame
    folder: str

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> "Bank":
        return cls(spark.read.parquet(f"{folder}/vocabulary"), spark.read.parquet(f"{folder}/rows"), folder)

    def postings(self) -> DataFrame:
        return op.postings_of(self.rows)


def build(docs: DataFrame, size: int = op.WIDTH, cap: int = 5) -> Bank:
    """Vocabulary and rows of ``docs`` (doc_id, text; one row per id) in the shared folder."""
    folder = new_folder(docs.sparkSession, f"bank-thermometer{cap}-{size}")
    feats = op.thermometer(op.multiset(docs), cap)
    vocab = saved(op.vocabulary(feats, docs.count(), size), f"{folder}/vocabulary")
    rows = op.packed(docs, op.bank(feats, vocab), size)
    return Bank(vocab, saved(rows.sortWithinPartitions("doc_id"), f"{folder}/rows"), folder)


def bank_of(spark: SparkSession, sf: str) -> Bank:
    """The bank of ``documents``, built at the first call in an application and again if the files change."""
    path = f"{sf}/documents.parquet"
    key = (spark.sparkContext.applicationId, signature(spark, path))
    if key not in _BUILT:
        _BUILT[key] = build(spark.read.parquet(path).select("doc_id", "text")).folder
    return Bank.read(spark, _BUILT[key])


def under(bank: Bank, docs: DataFrame, cap: int = 5) -> DataFrame:
    """Rows of all ``docs`` under the bank's *existing* vocabulary, whatever keys the bank has; a row without features stays all zero."""
    return op.packed(docs, op.bank(op.thermometer(op.multiset(docs), cap), bank.vocab), len_of(bank))


def extended(bank: Bank, docs: DataFrame, cap: int = 5, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key the bank lacks, under its *existing* vocabulary; a row without features stays all zero."""
    return under(bank, docs.join(bank.rows.select("doc_id"), "doc_id", "left_anti").dropDuplicates([key]), cap)


def len_of(bank: Bank) -> int:
    """Width of the bank's rows, a multiple of 64."""
    first = bank.rows.select(F.size("bits")).first()
    return 64 * (first[0] if first else op.WIDTH // 64)


def subset(bank: Bank, kept: DataFrame) -> DataFrame:
    """(pos, doc_id, bits, nnz) for ``kept`` (pos, doc_id): its order and repeats are preserved by ``pos``."""
    return kept.join(bank.rows, "doc_id").select("pos", "doc_id", "bits", "nnz")


def write_postings(bank: Bank, splits: DataFrame, folder: str) -> DataFrame:
    """(doc_id, cols) per split: one folder for each, columns sorted, rows sorted by id inside their files.

    ``splits`` is (doc_id, split).
    """
    rows = bank.rows.join(splits, "doc_id").select("doc_id", op.columns_of("bits").alias("cols"), "split")
    return saved(rows.repartition("split", F.pmod("doc_id", F.lit(8))).sortWithinPartitions("split", "doc_id"), folder, ("split",))


def lookup(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, cols) of every id asked for; an id that the store lacks is an error, raised by the row itself."""
    found = ids.select("doc_id").join(postings.select("doc_id", "cols"), "doc_id", "left")
    missing = F.raise_error(F.concat(F.lit("no such key: "), F.col("doc_id").cast("string"))).cast("array<int>")
    return found.select("doc_id", F.when(F.col("cols").isNull(), missing).otherwise(F.col("cols")).alias("cols"))
