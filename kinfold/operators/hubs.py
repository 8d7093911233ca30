"""Identifiers that join unusually many messages, such as a switchboard's number: reported, never left out.

A sketch of fixed size finds candidates in one pass without a shuffle of tokens, and sketches of batches merge.
Candidates are then counted exactly, so the report holds no guess: the sketch only has to miss none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items a sketch tracks. Its error is below 3 in 10,000 of all tokens, so none with twice that share is missed.
TRACKED = 10_000
#: The largest number of hubs asked for: a hub has at least 1 / share of all tokens.
MOST = 1_000


def linking_tokens(messages: DataFrame) -> DataFrame:
    """``token`` of every identifier of every message; a message that stands alone has none."""
    return messages.select(F.explode("tokens").alias("token")).filter(~F.col("token").startswith("key=rawid::"))


def sketched(tokens: DataFrame) -> DataFrame:
    """One row: the sketch of all tokens and their number. Tasks send a sketch each, never tokens."""
    return tokens.agg(F.expr(f"approx_top_k_accumulate(token, {TRACKED})").alias("sketch"), F.count("*").alias("n"))


def combined(sketches: DataFrame) -> DataFrame:
    """The sketch of several batches."""
    return sketches.filter("n > 0").agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"), F.sum("n").alias("n"))


def hubs(tokens: DataFrame, sketch: DataFrame, share: int = 256) -> DataFrame:
    """``(token, n, of)``: tokens with more than 1 / ``share`` of all, counted exactly, and the number of all.

    ``share`` is at most ``MOST``. Candidates, which are broadcast, are hardly more than the ``share`` hubs that there can be.
    """
    if not 1 <= share <= MOST:
        raise ValueError(f"share must lie between 1 and {MOST}")
    found = sketch.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {TRACKED})")).alias("found"), "n")
    # an estimate is never below the true count
    candidates = found.filter(F.col("found.count") * share > F.col("n")).select(F.col("found.item").alias("token"), F.col("n").alias("of"))
    counted = tokens.join(F.broadcast(candidates), "token").groupBy("token", "of").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") * share > F.col("of")).select("token", "n", "of")
