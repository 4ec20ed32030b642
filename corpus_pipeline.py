"""A corpus pipeline: each stage filters or rewrites what the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's ``docs``. All but the last return the columns
of ``docs``.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtrail import tune
from rowtrail.llm import bpe, decontam, langid, lines, near_dups
from rowtrail.llm.common import table, written


def _tuned(stage):
    """``stage`` under the session settings that the operators are planned for, with batches bounded in bytes."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(tune(spark), docs, sf_dir)

    return run


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of these ids; rows with a null id stay."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


@_tuned
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the label column is what they declare, the source their host.

    An id that repeats goes only if all of its rows are rejected.
    """
    found = langid.identify(langid.row_evidence(docs, "lang", "source"), langid.train(docs, "lang"))
    rejected = found.groupBy("id").agg(F.min("rejected").alias("all")).filter("all").select(F.col("id").alias("doc_id"))
    return _without(docs, rejected)


@_tuned
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one holds; ``n_chars`` follows the text."""
    cut = lines.dedup_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_tuned
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates."""
    return _without(docs, near_dups.near_duplicates(docs).filter("NOT kept"))


@_tuned
def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return _without(docs, written(decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")), "leaks"))


@_tuned
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the bytes they decode to."""
    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.decode(bpe.encode(docs, file, public_tokenizers.PATTERN), file)
    return found.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark_copies),
    ("byte_bpe", encode),
]

# Trained language models, near-duplicate groups, alignment and BPE have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
