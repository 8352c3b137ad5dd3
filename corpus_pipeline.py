"""Corpus preparation in stages; each stage's result is written and reread as the next one's input.

Every stage takes all rows that the one before kept.  Texts that a stage shortens go on in
their short form, with ``n_chars`` (where the table has it) counted anew.  Null, empty and
repeated rows are treated as the operators define; a text without words fails the base
rules and goes in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signaldeck.llm.common import tables
from signaldeck.llm.decontamination import decontaminate
from signaldeck.llm.jaccard_join import similar_classes
from signaldeck.llm.line_dedup import dedup_lines
from signaldeck.llm.packing import pack, piece_digests
from signaldeck.llm.quality_rules import quality_rules

#: Near-duplicates share this much of their shingles of so many words.
NEAR_SHINGLE = 5
NEAR_PERCENT = 80


def with_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of struct ``doc`` with another text."""
    changed: dict[str, Column] = {"text": F.col(text), "n_chars": F.char_length(text).cast("bigint")}
    return df.select(*(changed.get(c, F.col("doc")[c]).alias(c) for c in columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the boilerplate lines of their source."""
    return with_text(quality_rules(docs).where("kept"), docs.columns, "kept_text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a later one repeats."""
    return with_text(dedup_lines(docs), docs.columns, "kept_text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates; rows without an id stay."""
    classes = similar_classes(docs, NEAR_SHINGLE, NEAR_PERCENT)
    gone = classes.where("doc <> component").select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go."""
    clean = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return with_text(clean.select(F.struct("*").alias("doc"), "text"), docs.columns, "text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed documents."""
    return piece_digests(pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Token ids cannot be had from SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = tables(spark)
    for _, stage in STAGES:
        docs = written.save(stage(spark, docs, sf_dir))
    return docs
