"""Connected components by alternating star steps on an edge table.

The large-star/small-star scheme (Kiveris et al., "Connected Components in MapReduce and Beyond",
2014): each step points vertices at the smallest neighbour until every component is one star.
Rounds grow with the logarithm of the graph, and no step brings a neighbourhood into one task:
minima are pre-aggregated before the shuffle and joined back with hot vertices apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.config import Config
from kinfold.operators.skew import lookup
from kinfold.session import written


def _with_minimum(edges: DataFrame, share: int) -> DataFrame:
    """Edges ``(u, v)`` with ``m``, the smallest of ``u`` and all its neighbours."""
    lowest = written(edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")), "lowest")
    found = lookup(edges, lowest.select("u", "low"), "u", share, lowest.select("u", "n"))
    return found.withColumn("m", F.least("u", "low")).drop("low")


def _large_star(edges: DataFrame, share: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    stars = _with_minimum(both, share)
    return (stars.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct())


def _small_star(edges: DataFrame, share: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _with_minimum(down, share)
    to_min = stars.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_min.unionByName(stars.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, config: Config = Config()) -> DataFrame:
    """``(token, label)`` for every vertex of ``edges(u, v)``; the label is its component's least vertex."""
    share = config.hot_key_share
    current = written(edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _fingerprint(current)
    while mark[0]:
        large = written(_large_star(current, share), "large-star")
        current = written(_small_star(large, share), "small-star")
        new_mark = _fingerprint(current)
        if new_mark == mark:
            break
        mark = new_mark
    return (current.select(F.col("u").alias("token"), F.col("v").alias("label"))
            .unionByName(current.select(F.col("v").alias("token"), F.col("v").alias("label")).distinct()))
