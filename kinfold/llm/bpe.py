"""Byte-level BPE as a monoid: texts are encoded in halves and joined, ids are decoded up the same tree.

Greedy merging by rank has a local test: a sequence of tokens is the encoding of its bytes exactly if
each two neighbours, encoded together, give the same two tokens. (The first merge across some border
would also be the first one when only the two tokens beside that border are encoded, as merges elsewhere
do not touch them.) So encodings of two halves can be joined by encoding a window around the border
again, and growing it until its outermost tokens are those that stood there before: every pair outside
was a good pair already, every pair inside now is one, and nothing farther can change.

A piece is what the splitting pattern matches. A piece that is a token by itself is that token; others
are halved down to leaves of ``LEAF`` bytes. Leaves are merged directly, those of many pieces in step:
each numpy round does every piece's next merge. Pairs, pieces and parts are remembered, in two bounded
generations each.

Texts are cut before every space that white space does not follow. The pattern always starts a match
there, so the parts between are split and encoded independently, and the same parts come again and again.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.text import id_text, map_batches, pieces

#: Bytes of a leaf, which is merged directly.
LEAF = 16
#: Bytes of a window that is merged by scanning; wider ones use a heap.
SCANNED = 96
#: More than any rank: the two parts are no token together.
NEVER = 1 << 40
#: Ids that are decoded in one step.
DECODE_LEAF = 4096
#: Remembered parts and pieces in each generation.
REMEMBERED = 400_000

#: What Unicode calls white space, as a character class.
WHITE = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of base64 tokens with their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Remembering(dict):
    """Results of a function by argument; at ``limit`` entries, those not asked for since the last time go."""

    def __init__(self, make: Callable, limit: int = REMEMBERED):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def __setitem__(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        super().__setitem__(key, value)


class Codec:
    """Encoder and decoder for one table of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\S", f"[^{WHITE}]").replace(
            r"\s", f"[{WHITE}]")).findall
        self.cut = regex.compile(f" (?=[^{WHITE}])").split
        self.irregular = regex.compile(f" (?=[{WHITE}]|$)").search
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.uint32)
        pairs = sorted((ranks[token[:i]] << 32 | ranks[token[i:]], rank) for token, rank in ranks.items()
                       for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks)
        self.pairs = np.array([pair for pair, _ in pairs], np.uint64)
        self.pair_ranks = np.array([rank for _, rank in pairs], np.int64)
        self.good = Remembering(self._good)
        self.piece = Remembering(self._piece)
        self.later = Remembering(lambda part: self._part(" " + part))

    # -- encoding ---------------------------------------------------------------------------------

    def _leaf(self, piece: bytes) -> list[int]:
        """Merge the neighbours of least rank, leftmost first, until none is a token."""
        ranks = self.ranks
        if len(piece) < 2:
            return [ranks[piece]] if piece else []
        parts = [piece[i:i + 1] for i in range(len(piece))]
        known = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while known and (best := min(known)) < NEVER:
            at = known.index(best)
            parts[at:at + 2] = merged, = [parts[at] + parts[at + 1]]
            del known[at]
            if at:
                known[at - 1] = ranks.get(parts[at - 1] + merged, NEVER)
            if at < len(known):
                known[at] = ranks.get(merged + parts[at + 1], NEVER)
        return [ranks[p] for p in parts]

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint64) << np.uint64(32) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NEVER)

    def _leaves(self, pieces: list[bytes]) -> list[np.ndarray]:
        """What ``_leaf`` gives for each of many pieces that are not empty."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        done: list = [None] * len(pieces)
        rank = np.full(len(ids), NEVER)
        same = owner[1:] == owner[:-1]
        rank[:-1][same] = self._pair_ranks(ids[:-1][same], ids[1:][same])
        while len(ids):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(ids)])
            over = least == NEVER
            for i, j, n in zip(owner[first[over]].tolist(), first[over].tolist(), sizes[over].tolist()):
                done[i] = ids[j:j + n]
            hits = np.flatnonzero((rank == np.repeat(least, sizes)) & np.repeat(~over, sizes))
            at = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]] if len(hits) else hits
            ids = ids.copy()
            ids[at] = rank[at]
            keep = np.repeat(~over, sizes)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            for left in (at - 1, at):
                ok = (left >= 0) & (left + 1 < len(ids))
                near = left[ok]
                near_same = owner[near] == owner[near + 1]
                rank[near[~near_same]] = NEVER
                near = near[near_same]
                rank[near] = self._pair_ranks(ids[near], ids[near + 1])
            if len(ids):
                rank[-1] = NEVER
        return done

    def learn(self, parts: set[str]) -> None:
        """Remember parts that follow a space, encoding their unknown pieces together."""
        parts = [p for p in parts if p not in self.later]
        split = {p: [" " + p] if p.isalpha() else self.split(" " + p) for p in parts}
        unknown = {x for found in split.values() for x in found if x not in self.piece}
        short = [(x, b) for x in unknown if 1 < len(b := x.encode()) <= LEAF and b not in self.ranks]
        for (x, _), ids in zip(short, self._leaves([b for _, b in short])):
            self.piece[x] = ids.astype("<u4").tobytes()
        for p in parts:
            self.later[p] = b"".join(map(self.piece.__getitem__, split[p]))

    def _good(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens stay as they are when encoded together."""
        return self._window(self.tokens[pair[0]] + self.tokens[pair[1]]) == [*pair]

    def _merged(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self._leaf(data)
        half = len(data) // 2
        return self.join(self._merged(data[:half]), self._merged(data[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of what two encodings stand for."""
        if not left or not right:
            return left + right
        if self.good[left[-1], right[0]]:
            return left + right
        width = 1
        while True:
            a, b = left[-width:], right[:width]
            window = self._window(b"".join(map(self.tokens.__getitem__, a + b)))
            settled_left = len(a) == len(left) or window[0] == a[0]
            settled_right = len(b) == len(right) or window[-1] == b[-1]
            if settled_left and settled_right:
                return left[:len(left) - len(a)] + window + right[len(b):]
            width *= 2

    def _window(self, data: bytes) -> list[int]:
        return self._leaf(data) if len(data) <= SCANNED else self._heap(data)

    def _heap(self, data: bytes) -> list[int]:
        """The same merges for a wide window, found through a heap instead of by scanning."""
        ranks, n = self.ranks, len(data)
        part = [data[i:i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) == n or ranks.get(part[i] + part[j]) != rank:
                continue  # one of the two has been merged since
            part[i], part[j] = part[i] + part[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (rank, i))
            if (h := before[i]) >= 0 and (rank := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (rank, h))
        return [ranks[p] for p in part if p is not None]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        rank = self.ranks.get(piece)
        return self._merged(piece) if rank is None else [rank]

    def _piece(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode()), "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.split(part)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text."""
        found = [self.cut(text) if self.irregular(text) else text.split(" ") for text in texts]
        self.learn({p for parts in found for p in parts[1:] if len(p) < 256})
        later = self.later.__getitem__
        return [(self._part(parts[0]) if parts[0] else b"") + b"".join(map(later, parts[1:])) for parts in found]

    # -- decoding ---------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids: leaves of the tree joined level by level."""
        level = [b"".join(map(self.tokens.__getitem__, ids[i:i + DECODE_LEAF].tolist()))
                 for i in range(0, len(ids), DECODE_LEAF)]
        while len(level) > 1:
            level = [b"".join(level[i:i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file; files of vocabularies lie on every machine, as libraries do."""
    key = path, pattern
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(path), pattern)
    return _codecs[key]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: each whole text's ids, and the bytes they stand for.

    ``ids`` holds little-endian unsigned 32-bit integers. A null text is empty and has no ids; repeated
    rows give repeated rows; a null ``doc_id`` stays null; other columns of ``docs`` are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = codec(path, pattern)
        for batch in batches:
            for first, last, _, _ in pieces(batch):
                part = batch.slice(first, last - first)
                ids = known.encode_all(part.column("text").fill_null("").to_pylist())
                yield {"doc_id": part.column("doc_id"), "ids": ids,
                       "decoded": [known.decode(np.frombuffer(x, "<u4")) for x in ids]}
    return map_batches(id_text(docs), run, "doc_id long, ids binary, decoded binary")


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids give the empty text, an unknown id an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = codec(path, pattern)
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "text": [
                known.decode(np.frombuffer(x or b"", "<u4")).decode() for x in batch.column("ids").to_pylist()]}
    return map_batches(rows.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number and hashes of the ids and decoded bytes of each text, made where the texts are encoded."""
    return encoded(docs, path, pattern).select(
        "doc_id", F.expr("length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
