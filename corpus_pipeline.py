"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Toxic documents go; later occurrences of repeated three-line windows go; of each class of near
copies the smallest id stays; secrets are replaced by a mark; what is left is packed into
sequences. All stages but the last return the columns of documents, whatever their names; n_chars
follows the text. An empty table passes through all stages; null texts are kept up to the last, which
packs them as empty; rows that repeat id and text are one document after the join.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.shipping import ship
from vertexloom.llm import jaccard_join, line_dedup, packing, secrets, toxicity
from vertexloom.llm.common import crc32_mod, discard_table, durable, table, unused
from vertexloom.llm.queries import vocabulary


def _stage(fn):
    """The stage, with the package on the workers' path."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, n_chars brought up to date where it is one of them."""
    return docs.select(*(F.char_length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else c for c in columns))


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc32_mod(F.col("doc_id"), 5) != 0)
    return toxicity.reject(docs, model)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.dedup_lines(docs, counts=False), docs.columns)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


@_stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = unused(docs, "spans")
    found = secrets.scan(docs, secrets.fdr_thresholds(docs), name)
    return _counted(found.withColumn("text", secrets.redact(F.col("text"), F.col(name))), docs.columns)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express the trees, the packing or the tokenizer; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = durable(stage(spark, docs, sf_dir), "stage")
        if k:
            discard_table(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
