"""The corpus pipeline: documents in, token ids of clean, distinct documents out. Each stage is written and read again before the next.

Rejected documents go (quality), one of each group of near copies (sets of NEAR_WORDS-word shingles with a similarity of NEAR_PERCENT % or more) stays (near_duplicates), documents that hold a benchmark item go (decontamination), secrets are replaced in the texts (secrets), and what is left is encoded (encoding). Every stage keeps all columns but the last, and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, common, decontaminate, ngram_join, quality, secrets

#: Words of a shingle, and the least Jaccard similarity of near copies; op6's contract has its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row by its own text; null and empty texts by their (zero) statistics; repeated rows alike."""
    return quality.kept(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of copies and near copies the row of the smallest doc_id stays, those without one come last; of repeated rows one each; texts that share a doc_id are judged each for itself; null and empty texts and those without words stay."""
    return ngram_join.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row by its own text, whatever its doc_id; null and empty texts stay, and all do if the benchmark is empty."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; null and empty texts as they are; n_chars, where there is such a column, follows the text."""
    return secrets.redact(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row; null and empty texts have no tokens. lang and source come along where they are."""
    return bpe.encode(docs, keep=tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns), form="packed")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("encoding", encoding_stage),
]

#: The classifier, the statistical tests and the encoder can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
