"""Documents to shuffled training shards, one written table per stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm import dartminhash, decontaminate, language, mixing, sharding
from ledgerlens.llm.common import DOCUMENT_COLUMNS, table
from ledgerlens.session import materialise

MIN_LANGUAGE_SCORE = 0.4
SHARDS = 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts of a recognised language; null texts, texts without a letter and unsure ones go."""
    model = language.train_language_model(docs)
    marked = language.predict_language(docs, model)
    return marked.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)) \
        .select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near copies."""
    return dartminhash.keep_one(docs).select(*DOCUMENT_COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no benchmark item was found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*DOCUMENT_COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    return mixing.emit_copies(mixing.mix_sources(docs.select(*DOCUMENT_COLUMNS)), DOCUMENT_COLUMNS)


def shuffle_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    return sharding.shuffle_into_shards(docs.select(*DOCUMENT_COLUMNS), SHARDS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_to_weights),
    ("sharding", shuffle_shards),
]

#: Trained networks and hash signatures have no SQL twin; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
