"""Blocks of any depth as one typed column for each field.

Blocks are taken apart level by level. The rows of a level are written once: values that are no objects are
leaves, objects are what the next level is made of. However deep one message is, the plan of a level stays the same,
and only that message's objects come along. All levels are read back as one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinfold.functions.fields import is_object, json_of
from kinfold.functions.text import column_name
from kinfold.operators.upsert import EXACT
from kinfold.session import fresh_path, written

#: Columns that every wide table has; a field of such a name is stored with ``c_`` before it.
OWN = ["person_id", "grouping_key", "created_at", "updated_at"]


def item_text(item: Column) -> Column:
    kind = F.schema_of_variant(item)
    return (F.when(F.is_variant_null(item), "None").when(kind == "STRING", item.cast("string"))
            .when(kind == "BOOLEAN", F.initcap(item.cast("string"))).otherwise(json_of(item)))


def _level(rows: DataFrame, entries: Column) -> DataFrame:
    """One row for each entry: its cleaned name below its parent's, its place in document order, its value."""
    entry = rows.select("row", "name", "place", F.posexplode(entries).alias("at", "entry"))
    raw = F.concat_ws("__", "name", F.col("entry")["key"])
    value = F.col("entry")["value"]
    return (entry.filter(value.isNotNull() & ~F.is_variant_null(value)).select(
        "row", column_name(raw).alias("name"), F.concat("place", F.array("at")).alias("place"), value.alias("value"),
        is_object(value).alias("inner")))


def leaves(blocks: DataFrame) -> DataFrame:
    """``(row, name, place, kind, text)`` of every leaf of ``blocks(row, block)``.

    ``kind`` is ``bigint``, ``double``, ``boolean`` or ``string``; lists are text. Nulls are no leaves. ``place``
    orders leaves as the document does, so the last of a name is the greatest.
    """
    spark = blocks.sparkSession
    root, depth = fresh_path(spark, "levels"), 0
    rows = blocks.select("row", F.lit(None).cast("string").alias("name"), F.array().cast("array<int>").alias("place"), "block")
    level = _level(rows, F.map_entries("block"))
    while True:
        seen = Observation()
        path = f"{root}/level={depth}"
        level.observe(seen, F.count_if("inner").alias("inner")).write.parquet(path)
        stored = spark.read.schema(level.schema).parquet(path)
        if not seen.get.get("inner"):
            break
        level = _level(stored.filter("inner"), F.map_entries(F.col("value").cast("map<string,variant>")))
        depth += 1
    value = F.col("value")
    found = F.schema_of_variant(value)
    kind = (F.when(found == "BIGINT", "bigint").when(found == "BOOLEAN", "boolean")
            .when(found.startswith("DECIMAL") | found.isin("DOUBLE", "FLOAT"), "double").otherwise("string"))
    listed = F.array_join(F.transform(F.try_variant_get(value, "$", "array<variant>"), item_text), ",")
    text = F.when(found.startswith("ARRAY"), listed).otherwise(value.cast("string"))
    every = spark.read.schema(level.schema).parquet(root)
    return every.filter("not inner").select("row", "name", "place", kind.alias("kind"), text.alias("text"))


def column_types(found: DataFrame) -> dict[str, str]:
    """The type of each name that holds all its leaves; whole numbers too large for a double meet fractions as text."""
    def some(kind: str) -> Column:
        return F.bool_or(F.col("kind") == kind)
    large = F.bool_or((F.col("kind") == "bigint") & ~F.try_to_number("text", F.lit("S" + "9" * 19)).between(-EXACT, EXACT))
    kinds = found.groupBy("name").agg(some("bigint").alias("whole"), some("double").alias("fraction"), some("boolean").alias("truth"),
                                      some("string").alias("other"), large.alias("large"))
    numeric = F.when(~F.col("fraction"), "bigint").when(F.col("large"), "string").otherwise("double")
    kind = (F.when(F.col("other"), "string").when(F.col("truth"), F.when(F.col("whole") | F.col("fraction"), "string").otherwise("boolean"))
            .otherwise(numeric))
    return {r["name"]: r["type"] for r in kinds.select("name", kind.alias("type")).orderBy("name").collect()}


def wide_rows(blocks: DataFrame) -> DataFrame:
    """``blocks(grouping_key, created_at, updated_at, block)`` with one typed column for each field instead of the block.

    Only the list of column names and types comes to the driver; it is the table's schema. Of fields that are cleaned to
    the same name the last counts. A row whose block has no leaf has its keys and times alone.
    """
    rows = written(blocks.withColumn("row", F.monotonically_increasing_id()), "blocks")
    found = written(leaves(rows.select("row", "block")), "leaves")
    types = column_types(found)
    values = found.groupBy("row").agg(*[
        F.max_by(F.when(F.col("name") == n, F.col("text")), F.when(F.col("name") == n, F.col("place"))).cast(t).alias(
            f"c_{n}" if n in OWN else n) for n, t in types.items()] or [F.count("*").alias("none")])
    values = values.withColumnRenamed("row", "_row").drop(*([] if types else ["none"]))
    return rows.join(values, F.col("row") == F.col("_row"), "left").select(
        F.col("grouping_key").alias("person_id"), *OWN[1:], *[c for c in values.columns if c != "_row"])
