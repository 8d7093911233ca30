"""Coverage, completeness, lag and progress reports over landed rows and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.functions.text import percent
from kinfold.operators.fold import complete
from kinfold.operators.refine import types_or_empty


def pipeline_stats(landed: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row: landed rows by state, profiles by state, both rates."""
    done = F.coalesce(F.col("processed"), F.lit(False))
    raw = landed.agg(F.count("*").alias("raw_total"), F.count_if(done).alias("raw_processed"),
                     F.count_if(~done).alias("raw_pending"))
    people = profiles.agg(F.count("*").alias("profiles_total"), F.count_if("is_complete").alias("profiles_complete"))
    both = raw.select("*", people.select(F.struct("*")).scalar().alias("people")).select("*", "people.*").drop("people")
    return both.select(
        "*", (F.col("profiles_total") - F.col("profiles_complete")).alias("profiles_pending"),
        percent(F.col("raw_processed"), F.col("raw_total")).alias("processed_pct"),
        percent(F.col("profiles_complete"), F.col("profiles_total")).alias("complete_pct"))


def kind_distribution(profiles: DataFrame) -> DataFrame:
    """Profiles per number of kinds."""
    return profiles.groupBy(F.size(types_or_empty()).cast("long").alias("kinds")).agg(F.count("*").alias("n"))


def kind_frequency(profiles: DataFrame) -> DataFrame:
    """Profiles per kind and their share of all profiles.

    Both counts come from one pass: a profile adds one row for itself and one per kind. The window
    runs over those six counts.
    """
    marks = profiles.select(F.explode(F.concat(F.array(F.lit("")), types_or_empty())).alias("kind"))
    counts = marks.groupBy("kind").agg(F.count("*").alias("n"))
    total = F.max(F.when(F.col("kind") == "", F.col("n"))).over(Window.partitionBy())
    return (counts.withColumn("total", total).filter("kind <> ''")
            .select("kind", "n", percent(F.col("n"), F.col("total")).alias("share_pct")))


def all_kinds_count(profiles: DataFrame) -> DataFrame:
    return profiles.agg(F.count_if(complete(F.col("types_received"))).alias("n"))


def global_completeness(profiles: DataFrame) -> DataFrame:
    """Kinds received over kinds possible."""
    sums = profiles.agg(F.coalesce(F.sum(F.size(types_or_empty())), F.lit(0)).cast("long").alias("received"),
                        (F.count("*") * len(V.KINDS)).alias("needed"))
    return sums.withColumn("completeness_pct", percent(F.col("received"), F.col("needed")))


def kind_sets(profiles: DataFrame) -> DataFrame:
    """``(kinds, n)``: profiles of each set of kinds. There are at most 32, and the reports below need no more."""
    return profiles.groupBy(F.array_sort(types_or_empty()).alias("kinds")).agg(F.count("*").alias("n"))


def kind_set_reports(sets: DataFrame, required: list[str] = V.KINDS) -> DataFrame:
    """``(report, item, n)``: profiles by number of kinds, by kind, complete, all; and kinds received and possible."""
    def row(report: str, item: Column, n: Column) -> Column:
        return F.struct(F.lit(report).alias("report"), item.alias("item"), n.cast("long").alias("n"))
    size, n = F.size("kinds"), F.col("n")
    rows = F.concat(
        F.array(row("kinds", size.cast("string"), n), row("profiles", F.lit("all"), n),
                row("profiles", F.lit("complete"), F.when(complete(F.col("kinds"), required), n).otherwise(0)),
                row("completeness", F.lit("received"), size * n), row("completeness", F.lit("needed"), n * len(V.KINDS))),
        F.transform("kinds", lambda k: row("kind", k, n)))
    return sets.select(F.inline(rows)).groupBy("report", "item").agg(F.sum("n").alias("n"))


def field_frequency(messages: DataFrame, first: int | None = None) -> DataFrame:
    """Messages per top-level field; over all messages unless ``first`` asks for the oldest few."""
    rows = messages if first is None else messages.orderBy("ts", "topic", "partition", "offset").limit(first)
    return (rows.select(F.explode(F.array_distinct(F.map_keys("fields"))).alias("field"))
            .groupBy("field").agg(F.count("*").alias("n")))


def first_fields(messages: DataFrame, first: int = 100, samples: int = 5) -> DataFrame:
    """``(part, item, n)``: messages per field over the oldest ``first``, and the ids of the oldest ``samples`` by place.

    Both come from one top-k; what follows works on ``first`` rows.
    """
    rows = messages.orderBy("ts", "topic", "partition", "offset").limit(first)
    place = F.row_number().over(Window.orderBy("ts", "topic", "partition", "offset")).cast("long")

    def part(name: str, item: Column, n: Column) -> Column:
        return F.struct(F.lit(name).alias("part"), item.alias("item"), n.cast("long").alias("n"))
    fields = F.transform(F.array_distinct(F.map_keys("fields")), lambda k: part("field", k, F.lit(1)))
    sample = F.filter(F.array(part("sample", F.col("raw_id"), F.col("place"))), lambda s: s["n"] <= samples)
    parts = rows.withColumn("place", place).select(F.inline(F.concat(fields, sample)))
    return parts.groupBy("part", "item").agg(F.sum("n").alias("n"))


def count_by_field(messages: DataFrame, field: str) -> DataFrame:
    """Messages per value of a top-level field (as JSON text; null when absent)."""
    value = F.to_json(F.try_element_at("fields", F.lit(field)))
    return messages.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def count_by(rows: DataFrame, key: Column, name: str) -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def nonempty_blocks(profiles: DataFrame, kind: str) -> DataFrame:
    """Profiles that list the kind and hold a non-empty block of it."""
    return profiles.filter(F.array_contains(types_or_empty(), kind) & (F.size(F.col("data")[kind]) > 0))


def find_by_identifier(profiles: DataFrame, name: str, value: str) -> DataFrame:
    return profiles.filter(F.col("identifiers")[name] == value)


def end_offsets(landed: DataFrame) -> DataFrame:
    """Next offset per topic partition."""
    return landed.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))


def topic_totals(offsets: DataFrame) -> DataFrame:
    return offsets.groupBy("topic").agg(F.sum("end_offset").alias("messages"))


def consumer_lag(offsets: DataFrame, committed: DataFrame) -> DataFrame:
    """Lag per partition; a partition never committed lags by all it holds."""
    return (offsets.join(committed, ["topic", "partition"], "left")
            .select("topic", "partition", "end_offset", F.coalesce("committed", F.lit(0)).alias("committed"))
            .withColumn("lag", F.col("end_offset") - F.col("committed")))


def total_lag(lag: DataFrame) -> DataFrame:
    """Lag per topic, summed over its partitions."""
    return lag.groupBy("topic").agg(F.sum("lag").alias("lag"))


def stage_reconciliation(published: DataFrame, landed: DataFrame) -> DataFrame:
    """Rows per topic partition in both stages, and whether they agree."""
    sides = (published.select("topic", "partition", F.lit(1).alias("p"), F.lit(0).alias("l"))
             .unionByName(landed.select("topic", "partition", F.lit(0).alias("p"), F.lit(1).alias("l"))))
    return (sides.groupBy("topic", "partition").agg(F.sum("p").alias("published"), F.sum("l").alias("landed"))
            .withColumn("matches", F.col("published") == F.col("landed")))


def progress(snapshots: DataFrame, key: str = "pipeline") -> DataFrame:
    """Change, speed and time to finish between successive snapshots ``(key, ts, processed, pending)``."""
    w = Window.partitionBy(key).orderBy("ts")
    delta = F.col("processed") - F.lag("processed").over(w)
    seconds = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / F.lit(1e6)
    return (snapshots.withColumn("delta", delta).withColumn("speed", F.try_divide(delta, seconds))
            .withColumn("eta_seconds", F.when(F.col("speed") > 0, F.col("pending") / F.col("speed"))))
