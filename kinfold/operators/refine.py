"""Maintenance of stored profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.config import Config
from kinfold.operators.components import components
from kinfold.operators.fold import complete
from kinfold.operators.skew import lookup, shuffled
from kinfold.session import written


def stored_kinds() -> Column:
    """Kinds whose block has at least one field."""
    return F.filter(F.array(*[F.when(F.size(F.col("data")[k]) > 0, k) for k in V.KINDS]), lambda k: k.isNotNull())


def types_or_empty() -> Column:
    return F.coalesce("types_received", F.array().cast("array<string>"))


def refine(profiles: DataFrame) -> DataFrame:
    """Add kinds whose block is stored, recompute completeness, flag rows that changed."""
    types = F.array_sort(F.array_union(types_or_empty(), stored_kinds()))
    return (profiles
            .withColumn("old_types", F.col("types_received")).withColumn("old_complete", F.col("is_complete"))
            .withColumn("types_received", types)
            .withColumn("is_complete", complete(F.col("types_received")))
            .withColumn("changed", ~(F.array_sort("old_types").eqNullSafe(F.col("types_received"))
                                     & F.col("old_complete").eqNullSafe(F.col("is_complete"))))
            .drop("old_types", "old_complete"))


def final_targets(mapping: DataFrame, config: Config = Config()) -> DataFrame:
    """``(source_key, target_key)`` with every chain followed to its end.

    A source named several times goes to its least target. Each source then has one way on, so a chain ends
    in the one key of its component that is no source; of a circle the least key is the end.
    """
    hops = written(mapping.groupBy("source_key").agg(F.min("target_key").alias("target_key")), "hops")
    labels = written(components(hops.select(F.col("source_key").alias("u"), F.col("target_key").alias("v")), config), "chains")
    ends = (labels.join(shuffled(hops.select(F.col("source_key").alias("token"))), "token", "left_anti")
            .select("label", F.col("token").alias("end")))
    found = lookup(labels, ends, "label", config.hot_key_share)
    return (found.select(F.col("token").alias("source_key"), F.coalesce("end", "label").alias("target_key"))
            .filter("source_key <> target_key"))


def merge_groups(profiles: DataFrame, mapping: DataFrame, config: Config = Config()) -> DataFrame:
    """Merge groups ``source_key -> target_key``: the target wins, sources fill what it lacks.

    Chains are followed to their end, and a source named several times goes to its least target. Several
    sources of one target fill it in key order. Groups whose target does not exist stay as they are.
    Both inputs are read more than once and should be stored tables.
    """
    targets = profiles.select(F.col("grouping_key").alias("target_key"), F.lit(True).alias("exists"))
    valid = final_targets(lookup(mapping.filter("source_key <> target_key"), targets, "target_key", config.hot_key_share)
                          .filter("exists").drop("exists"), config)
    moved = (profiles.join(shuffled(valid.withColumnRenamed("source_key", "grouping_key")), "grouping_key", "left")
             .withColumn("is_source", F.col("target_key").isNotNull())
             .withColumn("into", F.coalesce("target_key", "grouping_key")))
    rank = F.struct("is_source", "grouping_key")

    def first(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), rank))

    def block(kind: str) -> Column:
        stored = F.col("data")[kind]
        return F.when(~F.col("is_source") | (F.size(stored) > 0), stored)

    merged = moved.groupBy("into").agg(
        *[first(F.nullif(F.col("identifiers")[i], F.lit(""))).alias(f"i_{i}") for i in V.IDENTIFIERS],
        *[first(block(k)).alias(f"k_{k}") for k in V.KINDS],
        *[F.max(F.array_contains(types_or_empty(), k)).alias(f"t_{k}") for k in V.KINDS],
        F.min_by("created_at", rank).alias("created_at"), F.max("updated_at").alias("updated_at"))
    types = F.array_sort(F.filter(F.array(*[F.when(F.col(f"t_{k}"), k) for k in V.KINDS]), lambda k: k.isNotNull()))
    return merged.select(
        F.col("into").alias("grouping_key"),
        F.struct(*[F.col(f"i_{i}").alias(i) for i in V.IDENTIFIERS]).alias("identifiers"),
        F.struct(*[F.col(f"k_{k}").alias(k) for k in V.KINDS]).alias("data"),
        types.alias("types_received"), complete(types).alias("is_complete"), "created_at", "updated_at")
