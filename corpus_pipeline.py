"""Document pipeline over the operators for training data: documents in, token digests out.

Every stage takes whole texts of any length; a null text is an empty one, rows without
doc_id are left out, empty tables give none, and columns beside those of documents are
left out. Rows that repeat are judged alike: what keeps one keeps all of them. Of equal or near
documents the smallest doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ploidyflow.llm import bpe_chunks, language, near_copies, substring, tiling
from ploidyflow.llm.common import discard, marked, release, written
from ploidyflow.llm.queries import BYTE_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; rows without doc_id are none."""
    return docs.select(*COLUMNS).where("doc_id is not null")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a known language: those without a letter (null and empty ones, too) or unlike any language go."""
    docs = _documents(docs)
    return language.keep_known(docs, language.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies (five words, similarity 0.8); its rows, if it repeats, all stay."""
    docs = _documents(docs)
    found = near_copies.near_copies(docs, words=5, least_similarity=0.8)
    return docs.join(found.where("class_id != doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words that a document of a smaller doc_id has; a document of which nothing is left goes, one that had no words stays."""
    cut = substring.remove_repeats(_documents(docs), window=50, with_text=True, carry=("lang", "source"))
    left = cut.where("n_removed < n_words or n_removed = 0")
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item, whole or in reordered parts that cover 0.8 of its words."""
    docs = _documents(docs)
    found = tiling.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row that was kept."""
    return bpe_chunks.bpe_digest(docs, BYTE_BPE)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("bpe", bpe)]
#: SQL can't express language ID, fingerprints or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written to the shared folder and read again, and what it read and made on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        first, before = marked(spark), docs
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
            release(spark, first, marked(spark) - 1)
            if k:
                discard(before)
    return docs
