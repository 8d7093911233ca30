"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shuffled(table: DataFrame) -> DataFrame:
    """``table`` as a side of a join that never goes through the driver, as Spark's own choice to broadcast it may.

    That choice is by the size of the files, compressed, times the share that the columns read have of a row by their types. A key
    beside blocks, which count two kilobytes each, is taken for less than a hundredth of what it is.
    """
    return table.hint("merge")


def lookup(rows: DataFrame, table: DataFrame, key: str, share: int, counts: DataFrame | None = None) -> DataFrame:
    """Left join of ``rows`` to ``table``, which holds at most one row per ``key``.

    A key with more than 1/``share`` of all rows is hot; fewer than ``share`` keys can be. Their
    table rows are broadcast, a bound proven by that count, and the hot rows never meet in one
    task. All other rows join by shuffle, where no key exceeds 1/``share`` of the rows, however small ``table`` seems. ``counts``,
    the number ``n`` of rows of each key, saves counting where the caller has it.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    total = counts.select(F.sum("n")).scalar()
    hot_keys = counts.filter((F.col("n") * share > total) & F.col(key).isNotNull()).select(key)
    hot_table = table.join(F.broadcast(hot_keys), key, "left_semi").withColumn("is_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot_keys.withColumn("is_hot", F.lit(True))), key, "left")
    hot = (marked.filter(F.col("is_hot").isNotNull()).drop("is_hot")
           .join(F.broadcast(hot_table.drop("is_hot")), key, "left"))
    cold = marked.filter(F.col("is_hot").isNull()).drop("is_hot").join(shuffled(table), key, "left")
    return hot.unionByName(cold)
