"""The corpus pipeline: five stages, each of which reads the documents that its predecessor kept.

All stages but the last return the columns of documents and ignore further ones. An empty table passes through all of them.
Tables that a stage writes for itself are gone when its result is complete, but for those that the result is read from;
`run` deletes these, and the documents of a stage, once the next stage is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm.common import discard, scratch, shared_folder, staged
from verdictlake.llm.exact_dedup import drop_exact_duplicates
from verdictlake.llm.language_id import fit_languages, held_out, identify_languages
from verdictlake.llm.ngram_join import similarity_components
from verdictlake.llm.packing import pack_documents
from verdictlake.llm.queries import PACKING
from verdictlake.llm.suffix_dedup import without_repeats


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of 16 MB at most instead of 64: rows are blocks of texts here, and each task holds a batch on either side of its Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "16m")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs whose doc_id is not in gone(gone_id)."""
    return docs.join(staged(gone.distinct()), F.col("doc_id").cast("long") == F.col("gone_id"), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by more than a narrow margin; null texts, and those without a letter, go. Rows that
    repeat an id go together, if the text of one of them goes."""
    model = fit_languages(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = identify_languages(docs.select("doc_id", "text"), model)
    with _small_batches(spark):
        return _without(docs, found.where("rejected").select(F.col("doc_id").alias("gone_id")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest id; rows without an id stay, each text of theirs once."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component of near duplicates. Rows without an id or without words stay."""
    with _small_batches(spark):
        found = similarity_components(docs.select("doc_id", "text"))
    return _without(docs, found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents with smaller ids have; those of which nothing is left go. Rows without an
    id come after all others."""
    with _small_batches(spark):
        return without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; null and empty texts are one end id."""
    return pack_documents(docs.select("doc_id", "text"), PACKING)


STAGES: list = [("language", language), ("exact", exact), ("near", near), ("passages", passages), ("packed", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to the documents of sf_dir."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        before, path = path, f"{shared_folder(spark)}/verdictlake-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
    return docs
