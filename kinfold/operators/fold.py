"""Profile fold: one mergeable state per key, newest value per slot.

A state holds, for each kind and each identifier, the newest value with its order. Merging keeps
the newer of two, so states combine in any grouping: per task before the shuffle, per token set,
per component, and across stream batches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.config import PREFER_OBSERVED, Config
from kinfold.operators.identifiers import id_columns, presence

SLOTS = [f"k_{k}" for k in V.KINDS] + [f"i_{i}" for i in V.IDENTIFIERS]


def order() -> Column:
    """Total order of messages: time, then broker coordinates."""
    return F.struct("ts", "topic", "partition", "offset")


def _slot(value: Column, rank: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(
        F.struct(rank.alias("rank"), order().alias("at")).alias("ord"), value.alias("value")))


def message_states(contributed: DataFrame, *by: str, config: Config = Config()) -> DataFrame:
    """States of messages merged by the columns ``by``.

    Messages that add nothing leave no state; they are kept only where they link identifiers. A message goes
    through the first sort with its order once, not once a slot: the slots are made as it is merged.
    """
    adds = reduce(lambda a, b: a | b, [F.col(f"c_{k}").isNotNull() for k in V.KINDS])

    def rank(kind: str) -> Column:
        if config.fold_policy != PREFER_OBSERVED:
            return F.lit(0)
        return F.array_contains("observed", kind).cast("int")

    slots = {f"k_{k}": _slot(F.col(f"c_{k}"), rank(k)) for k in V.KINDS}
    slots |= {f"i_{i}": F.when(F.col("adds"), _slot(F.col(f"id_{i}"), F.lit(0))) for i in V.IDENTIFIERS}
    best = F.when(F.col("adds"), F.struct((31 - presence(id_columns())).alias("rank"), order().alias("at"),
                                          F.col("proposed_key").alias("key")))
    at = F.when(F.col("adds"), F.col("ts"))
    rows = contributed.withColumn("adds", adds).filter(F.col("adds") | (F.size("tokens") > 1))
    return _merged(rows, by, slots, best, at, at)


def merge(states: DataFrame, *by: str) -> DataFrame:
    """Merge states that share ``by``. Spark pre-aggregates per task, so a hot key sends one row per task."""
    return _merged(states, by, {s: F.col(s) for s in SLOTS}, F.col("best"), F.col("first_ts"), F.col("last_ts"))


def _merged(rows: DataFrame, by: tuple[str, ...], slots: dict[str, Column], best: Column, first: Column, last: Column) -> DataFrame:
    """A hash leads the grouping, as rows are sorted for it: keys that begin alike, or lists, would be compared whole each time."""
    made = rows.groupBy(F.xxhash64(*by).alias("by_hash"), *by).agg(
        *[F.max_by(c, c["ord"]).alias(s) for s, c in slots.items()],
        F.min(best).alias("best"), F.min(first).alias("first_ts"), F.max(last).alias("last_ts"))
    return made.drop("by_hash")


def kinds_of() -> Column:
    """Kinds with a stored block, in fixed order."""
    return F.filter(F.array(*[F.when(F.col(f"k_{k}").isNotNull(), k) for k in V.KINDS]), lambda k: k.isNotNull())


def complete(types: Column, required: list[str] = V.KINDS) -> Column:
    """All required kinds received; a missing list counts as empty."""
    wanted = F.array(*[F.lit(k) for k in required])
    return F.size(F.array_except(wanted, F.coalesce(types, F.array().cast("array<string>")))) == 0


def profiles(states: DataFrame, key: Column, *kept: str) -> DataFrame:
    """Published profile shape from merged states; those that only link have nothing to publish."""
    return states.filter(F.col("best").isNotNull()).select(
        key.alias("grouping_key"),
        F.struct(*[F.col(f"i_{i}")["value"].alias(i) for i in V.IDENTIFIERS]).alias("identifiers"),
        F.struct(*[F.col(f"k_{k}")["value"].alias(k) for k in V.KINDS]).alias("data"),
        F.array_sort(kinds_of()).alias("types_received"),
        complete(kinds_of()).alias("is_complete"),
        F.col("first_ts").alias("created_at"), F.col("last_ts").alias("updated_at"), *kept)


def exact_profiles(contributed: DataFrame, config: Config = Config()) -> DataFrame:
    """Profiles by proposed key alone, without identifier resolution."""
    return profiles(message_states(contributed, "proposed_key", config=config), F.col("proposed_key"))
