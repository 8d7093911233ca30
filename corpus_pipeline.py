"""A corpus cleaned and packed: quality, lines, near copies, repeated passages, sequences.

Each stage takes and returns rows with the columns of ``documents``, with ``n_chars`` kept true to the text,
but for the last, which returns the packed pieces. Rows without an id, or with one that others have too, are decided
like all others.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import lines, minhash, packing, quality, substrings
from kinfold.llm.queries import labels_of, packing_encoder
from kinfold.llm.text import importable
from kinfold.session import delete, noted, written


#: Ids below this leave room above them for as many numbers again.
FAR = 1 << 62
#: Ids of several rows that are broadcast; more of them are joined by a shuffle.
FEW = 100_000
#: Tables that stages wrote for themselves. They go when a later stage begins, whose documents have been stored by then.
_left: list[str] = []


def _tidy(stage: Callable) -> Callable:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        spent = [path for path in _left if not any(f"{path}/" in file for file in read)]
        for path in spent:
            delete(spark, path)
            _left.remove(path)
        with noted(_left):
            return stage(spark, docs, sf_dir)
    return run


def _as_documents(made: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from rows with new texts."""
    return made.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) \
        if "n_chars" in docs.columns else made.select(docs.columns)


@_tidy
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.scored(docs, labels_of(importable(spark), sf_dir)).filter("not rejected").select(docs.columns)


@_tidy
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three or more documents stay in the last of them only."""
    return _as_documents(lines.deduplicated(docs), docs)


@_tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the least id, none coming last; of several the one whose text has the least hash.

    Rows are told apart by a number of their own, so texts that share an id but are not alike all stay: their id where no other
    row has it, so that originals, which come before their copies, stay in front; else one that no row has as its id.
    """
    number = "__row" + "_" * sum(c.startswith("__row") for c in docs.columns)
    low, top = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    repeated = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.col("doc_id").alias("__again")), "repeated")
    if repeated.count() <= FEW:
        repeated = F.broadcast(repeated)  # so many numbers at most
    place = F.monotonically_increasing_id()
    other = F.lit((top or 0) + 1) + place if (top or 0) < FAR else F.lit(low - 1) - place if low > -FAR else F.xxhash64("doc_id", place)
    rows = written(docs.join(repeated, F.col("doc_id") == F.col("__again"), "left").withColumn(number, F.when(
        F.col("doc_id").isNotNull() & F.col("__again").isNull(), F.col("doc_id")).otherwise(other)).drop("__again"), "rows")
    found = minhash.classes(rows.select(F.col(number).alias("doc_id"), "text")).withColumnRenamed("doc_id", number)
    place = rows.select(number, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.sha2(
        F.coalesce("text", F.lit("")), 256).alias("hash"), number).alias("place"))
    first = found.join(place, number).groupBy("class_id").agg(F.min("place").alias("place")).select(f"place.{number}")
    return rows.join(first, number, "left_semi").select(docs.columns)


@_tidy
def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the first document that holds them."""
    return _as_documents(substrings.deduplicated(docs), docs)


@_tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces of sequences of 1024 tokens."""
    return packing.packed(docs, packing_encoder)


STAGES = [("quality classifier", keep_good), ("line dedup", drop_lines), ("near-dedup", drop_near_copies),
          ("substring dedup", drop_passages), ("packing", pack)]
#: Neither the classifier nor the tokenizer can be said in SQL; a test holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, "stage")
    return docs
