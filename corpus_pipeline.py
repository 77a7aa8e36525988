"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

language_id      documents whose language is not recognised go
line_dedup       lines that match an earlier line go, and documents of which nothing is left
ngram_jaccard    of documents that link through shared shingles the one of smallest id stays
decontamination  documents that hold question and answer of a benchmark item go
bpe              the ids of each text, and the bytes that they decode to

Documents without a text, or whose text has no letter, go in the first stage, so later stages see none. Rows without
doc_id are kept by the three stages that compare documents, since nothing can be said of them as documents; the last
stage encodes them under a null id. Rows that repeat a doc_id are one document to those stages and stay or go
together. Texts of any length are worked on whole. A null source passes through; a null lang only keeps the row from
being learned from. Columns besides ``COLUMNS`` are dropped, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, langid, line_dedup, ngram_jaccard
from tessera.llm.session import discard, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language below this posterior is not recognised.
LEAST_SCORE = 0.5


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return langid.accept(docs.select(*COLUMNS), public.path("byte_bpe_multi_50k.tiktoken"), LEAST_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS), least=1)
    return _documents(cut.where((F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    path = public.path("byte_bpe_50k.tiktoken")
    both = bpe.encode(docs, path, public.PATTERN, lambda it: bpe.decoded(it, path), f"{bpe.ENCODED}, decoded binary")
    return both.select("doc_id", "n_tokens", "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", encode),
]

#: Language identification is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
