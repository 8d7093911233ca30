"""Line dedup by levelled sorted runs of line hashes.

A run is a table of ``(key, n_docs, last_doc)``, one row a key, dealt by a hash of the key and sorted in each
file. A batch of documents makes a run of its own on level 0. ``fan_in`` runs of a level are merged into
one run of the next level, so every row is rewritten once a level and there are few runs to read.
Counts and maxima merge in any order; a document must not come in two batches.

Lines are dropped after the last batch: the runs, merged, give the keys found in enough documents, and in one
join with all lines each document loses those with such a key unless it is the last document that holds it. Every row
is a document of its own, also where rows share an id.

A key is 128 bits of BLAKE2 of the stripped, lower-cased line. A line's rows are reduced within each Arrow batch
of documents and again within each task, so a line that a third of all documents hold is a few rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.text import LOWER, id_text, map_batches, rewritten, texts_of
from kinfold.session import scratch_dir, written

MIN_CHARS = 20
MIN_DOCS = 3
#: Runs of a level that are merged into one of the next level.
FAN_IN = 4
#: Batches that a whole corpus is ingested in: the runs of the first four are compacted into one.
BATCHES = 5
_WHITE = b" \t\n\x0b\x0c\r"
_LOWER = LOWER.tobytes()
_RUN = "key binary, n_docs long, last_doc long"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, None where it is too short to count."""
    key = line.strip(_WHITE)
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return hashlib.blake2b(key.translate(_LOWER), digest_size=16).digest()


def keyed(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(key, n_docs, last_doc)``: one row for each key of an Arrow batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            count: dict[bytes, int] = defaultdict(int)
            last: dict[bytes, int] = {}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                if doc_id is not None:
                    for key in {line_key(line, min_chars) for line in text.split(b"\n")} - {None}:
                        count[key] += 1
                        last[key] = max(doc_id, last.get(key, doc_id))
            yield {"key": list(count), "n_docs": list(count.values()), "last_doc": [last[key] for key in count]}
    return map_batches(id_text(docs), run, _RUN)


def merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


class LineRuns:
    """The levels of one index of lines, as tables in the shared folder."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, min_chars: int = MIN_CHARS):
        self.spark, self.fan_in, self.min_chars = spark, fan_in, min_chars
        self.root = f"{scratch_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.root}/{level}-{uuid.uuid4().hex}"
        merged(rows).sortWithinPartitions("key").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(*paths)

    def add(self, docs: DataFrame) -> None:
        """Add a batch's own run, then compact every level that is full."""
        self._write(keyed(docs, self.min_chars), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self._write(self._read(full), level + 1)
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """``(key, last_doc)`` of the keys found in at least ``min_docs`` documents of all runs."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], "key binary, last_doc long")
        return merged(self._read(paths)).filter(F.col("n_docs") >= min_docs).select("key", "last_doc")

    def dropped(self, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
        """``(doc_id, found)``: for each document the keys whose lines it loses."""
        min_chars = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                rows = {(doc_id, key) for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch))
                        if doc_id is not None for line in text.split(b"\n")
                        if (key := line_key(line, min_chars)) is not None}
                yield {"doc_id": [d for d, _ in rows], "key": [k for _, k in rows]}
        held = map_batches(id_text(docs), run, "doc_id long, key binary")
        # written, so that both sides of the join are shuffled for it alone and a hot key's rows can be split
        lost = held.join(written(self.frequent(min_docs), "frequent-lines"), "key").filter(F.col("doc_id") < F.col("last_doc"))
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("found"))


def without_lines(docs: DataFrame, lost: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines of the lost keys taken from ``text``, and ``n_lines``, ``n_dropped``."""
    def rewrite(batch: pa.RecordBatch, found: list) -> tuple[list, dict]:
        kept, n_lines, n_dropped = [], [], []
        for text, keys in zip(texts_of(batch), found):
            lines = text.split(b"\n")
            gone = set(keys or ())
            stay = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
            kept.append(b"\n".join(stay).decode())
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        return kept, {"n_lines": n_lines, "n_dropped": n_dropped}
    return rewritten(docs, lost, rewrite, "n_lines long, n_dropped long")


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES,
                 fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` without its frequent lines, and ``n_lines``, ``n_dropped``, ingested in ``batches`` hashed batches.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents loses its lines in
    all documents but the one with the largest id. Null and empty texts are one empty line and become empty
    texts. Each row counts as a document, also where ids repeat; rows without an id do not count and keep all their
    lines. Columns of ``docs`` named as the new ones are replaced.
    """
    runs = LineRuns(docs.sparkSession, fan_in, min_chars)
    for i in range(batches):
        runs.add(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
    return without_lines(docs, runs.dropped(docs, min_docs), min_chars)
