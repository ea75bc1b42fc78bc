"""A corpus pipeline of five stages over ``documents``; each stage calls one of the operators in manygrain.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manygrain.llm import mixing, packing, private, quality, similar
from manygrain.llm.common import stored, table, whole_row
from manygrain.llm.tokens import default_vocabulary


def _slim(docs: DataFrame, *columns: str) -> DataFrame:
    """What an operator needs, with the whole row beside it: columns of any name pass untouched."""
    return docs.select(whole_row(docs).alias("row"), *[docs[c] for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judged(_slim(docs, "text")).where("_kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return similar.keep_one(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind; n_chars follows."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    done = private.redact(_slim(docs, "doc_id", "text"))
    return done.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = mixing.mix(_slim(docs, "doc_id", "text", "source")).where("_copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 tokens."""
    return packing.pack_documents(docs, default_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_private),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: XXH64, min-wise hashes and byte-pair encoding have no SQL here: tests/llm holds each operator against brute force and the stages in a row on examples.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
