"""Exact-key rules and typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import vocabulary as V


def exact_kind(fields: Column) -> Column:
    """Kind by the exact, case-sensitive keys present; null when no rule fits."""
    keys = F.map_keys(fields)
    choice = None
    for kind, needed, barred in V.EXACT_KEY_RULES:
        fits = F.size(F.array_except(F.array(*[F.lit(k) for k in needed]), keys)) == 0
        if barred:
            fits = fits & ~F.array_contains(keys, barred)
        choice = F.when(fits, kind) if choice is None else choice.when(fits, kind)
    return choice


def _as_text(value: Column) -> Column:
    """Strings as they are, null as missing, other values as JSON."""
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string")).otherwise(
        F.nullif(F.to_json(value), F.lit("null")))


def record(fields: Column, kind: str) -> Column:
    """Typed record of ``kind``; a missing key gives ``''``."""
    return F.struct(*[
        F.coalesce(_as_text(F.try_element_at(fields, F.lit(key))), F.lit("")).alias(name)
        for name, key in V.RECORD_FIELDS[kind].items()])


def typed(messages: DataFrame, kind: str) -> DataFrame:
    """Records of all messages the exact rules call ``kind``."""
    return (messages.filter(exact_kind(F.col("fields")) == kind)
            .select("raw_id", record(F.col("fields"), kind).alias("record")).select("raw_id", "record.*"))


def kind_counts(messages: DataFrame) -> DataFrame:
    """Messages per exact kind, ``unknown`` for the rest."""
    return (messages.groupBy(F.coalesce(exact_kind(F.col("fields")), F.lit("unknown")).alias("kind"))
            .agg(F.count("*").alias("n")))
