"""Arrow and numpy helpers shared by the operators: rows to bytes, words, word and window hashes.

All of them work on bounded pieces of one Arrow batch inside a task. A word is a longest run of bytes
other than space and the control characters 9 to 13, so splitting needs no decoding of UTF-8.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one numpy step takes at a time; a single longer text is taken whole.
PIECE_BYTES = 1 << 20
#: Bytes of an Arrow batch, so that workers' memory follows neither the number nor the length of texts.
BATCH_BYTES = "8m"

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.default_rng(20240607)
_BYTE = [_RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2)]
_BASE = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_WINDOW_BASE = 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, however the driver found it, and bound what they are sent at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)
        # workers give memory back after each batch instead of keeping it for themselves
        spark.sparkContext.environment["ARROW_DEFAULT_MEMORY_POOL"] = "system"
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only the two columns an operator reads, so that no other column's name can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def map_batches(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]],
                schema: str | StructType) -> DataFrame:
    """``mapInArrow`` of a function that yields columns by name; the schema gives order and types."""
    importable(df.sparkSession)
    spark_schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(spark_schema)
        for columns in make(batches):
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)
    return df.mapInArrow(run, spark_schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes, null as empty."""
    return batch.column(name).cast(pa.binary()).fill_null(b"").to_pylist()


def pieces(batch: pa.RecordBatch, name: str = "text", size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows as ``(first, last + 1, bytes, offsets)``; null texts are empty."""
    column = batch.column(name).cast(pa.large_binary()).fill_null(b"")
    _, place, data = column.buffers()
    offsets = np.frombuffer(place, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, first)``: byte spans of all words; row ``r`` owns words ``first[r]:first[r + 1]``."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(SEPARATOR[data], out=inside[:-1])
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, PIECE_BYTES + 4096)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        known = both[0], both[1]
        if size <= 4 * PIECE_BYTES:
            _powers[base] = known
    return known


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmixed(x: np.ndarray) -> np.ndarray:
    """What ``mixed`` makes ``x`` of."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    up, down = _power(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes; ``which`` picks one of two independent ones."""
    return _spans_hash(_BYTE[which][data], starts, ends, _BASE[which])


def window_hashes(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` words from each start."""
    return _spans_hash(words, starts, starts + length, _WINDOW_BASE)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the longs that Spark stores."""
    return x.view(np.int64)


def rewritten(docs: DataFrame, found: DataFrame, rewrite: Callable, added: str) -> DataFrame:
    """``docs`` with each text rewritten by what ``found(doc_id, found)`` has for its ``doc_id``.

    ``rewrite(batch, found)`` gives the new texts and the added columns, which replace those of the same name.
    ``found`` has at most one row for each id and is null where it has none.
    """
    new = StructType.fromDDL(added)
    names = {f.name.lower() for f in new}
    own = docs.select(*[docs[c].cast("long").alias(c) if c == "doc_id" else docs[c].cast("string").alias(c)
                        if c == "text" else docs[c] for c in docs.columns if c.lower() not in names])
    joined = own.join(found.select(F.col("doc_id").alias("__doc"), F.col("found").alias("__found")),
                      F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    schema = StructType([*own.schema, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts, extra = rewrite(batch, batch.column("__found").to_pylist())
            yield {f.name: batch.column(f.name) for f in own_fields} | {"text": texts} | extra
    own_fields = list(own.schema)
    return map_batches(joined, run, schema)
