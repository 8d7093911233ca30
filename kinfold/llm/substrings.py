"""Substring dedup with difference-cover anchors.

An anchor is a run of ``window - period + 1`` words that starts at a position whose residue modulo
``period`` is in a difference cover. Of two equal windows, whatever their positions, some word among the
first ``period`` is at a cover position in both documents, as the cover has every difference of residues.
So equal windows always share an aligned anchor, and only about a fifth of all positions are hashed.

1. Anchors of all documents; those that two documents hold are shared.
2. Every window around a shared anchor is hashed whole, to 128 bits: this extends anchors to matches. The
   smallest document of each such window keeps it, in the others its words go.
3. Words covered by a window to go are removed.

Before each shuffle the rows of some megabytes of text are reduced: equal hashes in one such part are known
to be shared without a shuffle, and one row stands for them elsewhere. A passage that a third of all documents
hold is thus a few rows a task, and no window or group is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.text import (id_text, map_batches, mixed, pieces, rewritten, rows_of, signed, texts_of,
                              window_hashes, word_hashes, word_spans)

WINDOW = 50
#: A perfect difference set; every residue but 0 is exactly one difference of two members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Pieces of text whose rows are reduced together.
REDUCED = 8


def _anchors(rank: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Words at a cover position with a whole anchor before the document's end."""
    at_cover = np.zeros(PERIOD, bool)
    at_cover[list(COVER)] = True
    return np.flatnonzero(at_cover[rank % PERIOD] & (left >= length))


def _places(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its row, its number in the row, and the words from it to the row's end."""
    row = rows_of(first)
    at = np.arange(len(row))
    return row, at - first[row], first[row + 1] - at


def _short(anchor: np.ndarray) -> np.ndarray:
    """Half of an anchor's hash, enough to find it again in its own document; a false one only adds windows to hash."""
    return anchor.astype(np.uint32).view(np.int32)


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """``(key, anchor, doc_id, shared)``. A row stands in its anchor's group if ``key`` is the anchor.

    Of an anchor that several documents of one part hold, one row does; the others are known to be shared
    and dealt by a key of their own.
    """
    length = window - PERIOD + 1

    def reduced(parts: list[tuple[np.ndarray, np.ndarray]]) -> dict:
        anchor = np.concatenate([a for a, _ in parts])
        doc = np.concatenate([d for _, d in parts])
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        anchor, doc = anchor[new], doc[new]
        first = np.ones(len(anchor), bool)
        first[1:] = anchor[1:] != anchor[:-1]
        size = np.diff(np.r_[np.flatnonzero(first), len(anchor)])
        shared = np.repeat(size > 1, size)
        own = mixed(anchor ^ mixed(doc.view(np.uint64)))
        return {"key": signed(np.where(first, anchor, own)), "anchor": _short(anchor), "doc_id": doc, "shared": shared}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts: list = []
        for batch in batches:
            ids = batch.column("doc_id")
            known, doc = ids.is_valid().to_numpy(False), ids.fill_null(0).to_numpy(False)
            for lo, hi, data, offsets in pieces(batch):
                starts, ends, first = word_spans(data, offsets)
                row, rank, left = _places(first)
                at = _anchors(rank, left, length)
                at = at[known[lo:hi][row[at]] & (np.diff(first)[row[at]] >= window)]
                parts.append((window_hashes(word_hashes(data, starts, ends), at, length), doc[lo:hi][row[at]]))
                if len(parts) == REDUCED:
                    yield reduced(parts)
                    parts = []
        if parts:
            yield reduced(parts)
    return map_batches(id_text(docs), run, "key long, anchor int, doc_id long, shared boolean")


def shared_anchors(docs: DataFrame, window: int) -> DataFrame:
    """``(doc_id, found)``: the anchors of each document that another one holds as well."""
    group = Window.partitionBy("key")
    rows = anchor_rows(docs, window).withColumn(
        "several", F.min("doc_id").over(group) != F.max("doc_id").over(group))
    return rows.filter("shared or several").groupBy("doc_id").agg(F.collect_list("anchor").alias("found"))


def window_rows(docs: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """``(key, other, doc_id, start, n, more, lost)``: windows around shared anchors.

    A lost row is a run of ``n`` windows that a smaller document of the same part holds too. Each other row is
    the one of its hash ``(key, other)`` in its part; ``more`` has the window's further starts in the document.
    """
    length = window - PERIOD + 1

    def reduced(parts: list[tuple]) -> dict:
        key, other, doc, start = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((start, doc, other, key))
        key, other, doc, start = key[order], other[order], doc[order], start[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
        least = doc[first][np.cumsum(first) - 1] if len(doc) else doc
        lost = doc > least
        lost_doc, lost_start = doc[lost], start[lost]
        order = np.lexsort((lost_start, lost_doc))
        lost_doc, lost_start = lost_doc[order], lost_start[order]
        begins = np.ones(len(lost_doc), bool)
        begins[1:] = (lost_doc[1:] != lost_doc[:-1]) | (lost_start[1:] != lost_start[:-1] + 1)
        place = np.flatnonzero(begins)
        own = mixed(mixed(lost_doc[place].view(np.uint64)) ^ lost_start[place].view(np.uint64))
        # all live rows of a key are of one document: its first start in one row, the others with it
        top = np.flatnonzero(first)
        size = np.add.reduceat((~lost).astype(np.int64), top) if len(top) else top
        cuts = np.r_[0, np.cumsum(size - 1)].astype(np.int32)
        more = pa.ListArray.from_arrays(pa.array(cuts), pa.array(start[~lost & ~first]), mask=pa.array(size == 1))
        none = np.zeros(len(place), np.int64)
        return {"key": signed(np.r_[key[top], own]), "other": signed(np.r_[other[top], none.view(np.uint64)]),
                "doc_id": np.r_[doc[top], lost_doc[place]], "start": np.r_[start[top], lost_start[place]],
                "n": np.r_[np.ones(len(top), np.int64), np.diff(np.r_[place, len(lost_doc)])],
                "more": pa.concat_arrays([more, pa.nulls(len(place), more.type)]),
                "lost": np.r_[np.zeros(len(top), bool), np.ones(len(place), bool)]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts: list = []
        for batch in batches:
            batch = batch.filter(batch.column("found").is_valid())
            doc = batch.column("doc_id").to_numpy(False)
            found = batch.column("found")
            for lo, hi, data, offsets in pieces(batch):
                starts, ends, first = word_spans(data, offsets)
                row, rank, left = _places(first)
                words = word_hashes(data, starts, ends)
                at = _anchors(rank, left, length)
                values = found.slice(lo, hi - lo).flatten().to_numpy(False).astype(np.uint64) << np.uint64(32)
                owners = np.repeat(np.arange(hi - lo), pa.compute.list_value_length(found.slice(lo, hi - lo)).to_numpy(False))
                own = _short(window_hashes(words, at, length)).astype(np.uint64) << np.uint64(32)
                hit = np.isin(own | row[at].astype(np.uint64), values | owners.astype(np.uint64))
                near = np.zeros(len(row) + PERIOD + 1, np.int64)
                near[at[hit] + 1] = 1
                near = np.cumsum(near)
                start = np.flatnonzero((left >= window) & (near[PERIOD:PERIOD + len(row)] > near[:len(row)]))
                parts.append((window_hashes(words, start, window),
                              window_hashes(word_hashes(data, starts, ends, 1), start, window),
                              doc[lo:hi][row[start]], rank[start]))
                if len(parts) == REDUCED:
                    yield reduced(parts)
                    parts = []
        if parts:
            yield reduced(parts)
    joined = docs.join(anchors, "doc_id", "left").select("doc_id", "text", "found")
    return map_batches(joined, run, "key long, other long, doc_id long, start long, n long, more array<long>, lost boolean")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, found)``: ``(start, n, more)``, runs of windows of ``window`` words that a smaller ``doc_id`` holds too."""
    texts = id_text(docs)
    rows = window_rows(texts, shared_anchors(texts, window), window)
    group = Window.partitionBy("key", "other")
    return (rows.withColumn("least", F.min("doc_id").over(group)).filter("lost or doc_id > least")
            .groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "more")).alias("found")))


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated words taken from ``text``, and ``n_words``, ``n_removed``.

    Every word goes that lies in ``window`` consecutive words which also stand in a document with a smaller
    ``doc_id``; the rest is joined by single spaces. Windows are judged on the input. Null and empty texts
    become empty texts of no words. Rows without an id keep all their words and take none from others; rows that
    repeat an id are one document as to each other. Columns of ``docs`` named as the new ones are replaced.
    """
    if window < PERIOD + 1:
        raise ValueError(f"the window must have more than {PERIOD} words")

    def rewrite(batch: pa.RecordBatch, found: list) -> tuple[list, dict]:
        kept, n_words, n_removed = [], [], []
        for text, spans in zip(texts_of(batch), found):
            words = text.split()
            n_words.append(len(words))
            if spans:
                change = np.zeros(len(words) + 1, np.int64)
                for span in spans:
                    change[span["start"]] += 1
                    change[span["start"] + span["n"] + window - 1] -= 1
                    for start in span["more"] or ():
                        change[start] += 1
                        change[start + window] -= 1
                words = [w for w, gone in zip(words, (np.cumsum(change) > 0).tolist()) if not gone]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return kept, {"n_words": n_words, "n_removed": n_removed}
    return rewritten(docs, repeated_spans(docs, window), rewrite, "n_words long, n_removed long")
