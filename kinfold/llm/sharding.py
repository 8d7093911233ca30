"""Sharding by longest processing time: groups of equal texts, the largest first, to the least-loaded shard.

Groups too large to average out are scheduled one by one: those of at least 1 / (shards * FINE) of all
bytes, of which there can be no more than shards * FINE. All other groups are first gathered by a hash of
their text into ``CELLS`` cells of unequal width, wide ones first, whose narrowest closes the last gaps.
Large groups and cells, a number bounded by the parameters, are what the heap on the driver sees. The
rest is aggregation and joins over one row a document, without the text.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.skew import lookup
from kinfold.session import written

FINE = 256
CELLS = 8192
#: Parts of a shard whose slots are counted independently.
PARTS = 64
ROW_BYTES = 16


def longest_first(items: list[tuple[int, object]], shards: int) -> dict:
    """The shard of each ``(size, name)``: by falling size, ties by name, to the least load, ties to the least shard."""
    heap = [(0, shard) for shard in range(shards)]
    out = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def _cell(group: Column) -> Column:
    """Cells by the square of a uniform number, so that cell i is about 1 / sqrt(i) wide."""
    uniform = F.pmod(F.xxhash64(group, F.lit("cell")), F.lit(1 << 40)) / F.lit(1 << 40)
    return F.floor(uniform * uniform * CELLS).cast("int")


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row.

    Size is the text's UTF-8 bytes plus ``ROW_BYTES``. Null and empty texts are one group of their own.
    Equal texts, repeated rows among them, share a shard. Slots of a shard run from 0 without gaps, by part,
    then document id; null ids come first.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("group")), "rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).scalar()
    large = F.col("bytes") * (shards * FINE) >= total
    placed = written(groups.select("group", "bytes", F.when(large, F.col("group")).otherwise(
        _cell(F.col("group")).cast("string")).alias("item")), "groups")
    items = [(r["bytes"], r["item"]) for r in placed.groupBy("item").agg(F.sum("bytes").alias("bytes")).collect()]
    shard_of = docs.sparkSession.createDataFrame(
        list(longest_first(items, shards).items()), "item string, shard int")
    by_group = placed.join(F.broadcast(shard_of), "item").select("group", "shard")
    return slotted(lookup(rows, by_group, "group", 256).drop("group"))


def slotted(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """Add ``slot`` within ``shard``: each part's first slot from the counts, then a number within the part."""
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")), "placed")
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("at", F.row_number().over(within)).join(F.broadcast(first), ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at") - 1).alias("slot")))
