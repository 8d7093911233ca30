"""Resolution of messages to persons by shared identifiers.

Messages of one token set are folded first, in the only pass over the messages. Links between
tokens, components and the final fold then work on that much smaller table. Links come from
equality of single tokens, never from an OR-join of records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.config import Config
from kinfold.operators.components import components
from kinfold.operators.fold import merge, message_states, profiles
from kinfold.operators.skew import lookup
from kinfold.session import written


def token_set_states(contributed: DataFrame, config: Config = Config()) -> DataFrame:
    """States merged per distinct token set: a heavy person is a handful of rows from here on."""
    return message_states(contributed, "tokens", config=config)


def link_edges(states: DataFrame) -> DataFrame:
    """Star edges from the first token of a set to its others."""
    pairs = states.filter(F.size("tokens") > 1).select(
        F.get("tokens", F.lit(0)).alias("u"), F.explode(F.slice("tokens", F.lit(2), F.size("tokens"))).alias("v"))
    return pairs.distinct()


def labelled(states: DataFrame, labels: DataFrame, config: Config = Config()) -> DataFrame:
    """States with the label of their component; unlinked tokens label themselves."""
    rows = states.withColumn("token", F.get("tokens", F.lit(0)))
    joined = lookup(rows, labels, "token", config.hot_key_share)
    return joined.withColumn("label", F.coalesce("label", "token")).drop("token")


def resolved_states(contributed: DataFrame, config: Config = Config()) -> DataFrame:
    """One merged state per person.

    The person's key is the key proposed by its message with the best presence vector, then the
    earliest in order, so it does not depend on arrival.
    """
    states = written(token_set_states(contributed, config), "token-sets")
    labels = components(link_edges(states), config)
    return merge(labelled(states, labels, config), "label")


def resolved_profiles(contributed: DataFrame, config: Config = Config()) -> DataFrame:
    return profiles(resolved_states(contributed, config), F.col("best")["key"])


def key_mapping(contributed: DataFrame, config: Config = Config()) -> DataFrame:
    """``(proposed_key, grouping_key)``: where each group proposed by some message ended up."""
    states = written(message_states(contributed, "tokens", "proposed_key", config=config), "proposed")
    labels = components(link_edges(states), config)
    rows = written(labelled(states, labels, config).filter(F.col("best").isNotNull())
                   .select("proposed_key", "label", "best"), "labelled")
    heads = rows.groupBy("label").agg(F.min("best").alias("head"))
    return (lookup(rows.select("proposed_key", "label").distinct(), heads, "label", config.hot_key_share)
            .select("proposed_key", F.col("head")["key"].alias("grouping_key")).distinct())


def merges(mapping: DataFrame) -> DataFrame:
    """Groups that were merged into another."""
    return mapping.filter("proposed_key <> grouping_key")
