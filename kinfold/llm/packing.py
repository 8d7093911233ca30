"""Packing documents into sequences: first fit decreasing with a tournament tree, in random groups.

A document's ids end with one separator id. It is cut at every ``SEQUENCE`` ids, so all pieces but its
last one fill a sequence by themselves. All pieces are dealt by a hash of their number in the written table to groups of
about ``GROUP`` pieces, and each group is packed by itself: pieces by falling length, each to the first
bin with room. A tournament tree over the bins' free room finds that bin in log(bins) steps. Groups are
random samples of all pieces, so each wastes little more than one packing of everything would, and no
document, source or length can fill a group. Only the lengths are shuffled, never the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.text import id_text, map_batches, pieces
from kinfold.session import written

SEQUENCE = 1024
#: Pieces that a group is meant to hold.
GROUP = 8192
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def first_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each length, taken in the given order, each to the first bin with room.

    Node ``i`` of the tree holds the most room of any bin below its children ``2 i`` and ``2 i + 1``.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    free = [room] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, length in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < length:
                node += 1
        bins[k], offsets[k] = node - leaves, room - free[node]
        free[node] -= length
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins, offsets


_encoders: dict[str, Callable] = {}


def vocabulary_encoder(ranks: str, pattern: str, special: tuple[tuple[str, int], ...]) -> Callable[[list[str]], list]:
    """The worker's encoder of a public vocabulary: lists of texts to lists of uint32 arrays."""
    if ranks not in _encoders:
        import tiktoken

        from kinfold.llm.bpe import read_ranks
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens=dict(special))
        names = {name for name, _ in special}
        _encoders[ranks] = lambda texts: [own.encode_to_numpy(t, allowed_special=names) for t in texts]
    return _encoders[ranks]


def cut(docs: DataFrame, encoder: Callable[[], Callable], separator: int = 0, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens)`` of all documents.

    ``encoder()`` is called in the worker. A null or empty text is its separator alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder()
        for batch in batches:
            for first, last, _, _ in pieces(batch):
                part = batch.slice(first, last - first)
                out: list[tuple] = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(),
                                       encode(part.column("text").fill_null("").to_pylist())):
                    ids = np.append(ids, separator).astype("<u4")
                    out += [(doc_id, i, len(x := ids[i:i + sequence]), zlib.crc32(x.tobytes()), len(ids))
                            for i in range(0, len(ids), sequence)]
                yield dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), map(list, zip(*out))))
    return map_batches(id_text(docs), run, _PIECE)


def packed(docs: DataFrame, encoder: Callable[[], Callable], separator: int = 0, sequence: int = SEQUENCE,
           group: int = GROUP) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: every id of every document lies in exactly one.

    Null and empty texts are packed as their separator. Repeated rows are packed once for each row. A null
    ``doc_id`` stays null. Ties in length are taken by document, start and checksum. No documents: no pieces.
    """
    table = written(cut(docs, encoder, separator, sequence), "pieces")
    groups = -(-table.count() // group) or 1
    # a number of its own for each piece: rows that share an id, or have none, spread like all others
    dealt = table.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit("group")), F.lit(groups)))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(rows, [("length", "descending"), *[(c, "ascending") for c in ("doc_id", "start", "ids_crc32")]])
        rows = rows.take(order)
        bins, offsets = first_fit(rows.column("length").to_numpy(), sequence)
        ids = (key[0].as_py() << 32) + bins
        return rows.drop_columns(["group"]).append_column("sequence_id", pa.array(ids)).append_column(
            "offset", pa.array(offsets))
    return dealt.groupBy("group").applyInArrow(pack, _PIECE + ", sequence_id long, offset long")
