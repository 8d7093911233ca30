"""A probabilistic suffix tree over words, and texts scored by it (after Ron, Singer and Tishby, 1996).

Learning takes one pass for words and one for each depth of contexts. A context of d words is a candidate if
the training texts hold it ``CONTEXT_COUNT`` times, a symbol of a context is kept apart if the two together occur
``SYMBOL_COUNT`` times. Both are counts, so the model grows with the corpus. Candidates, tests and
probabilities are tables, which each depth joins to those of the depth before. A candidate is retained if its
next-symbol distribution diverges from that of its longest retained suffix by at least ``DIVERGENCE`` bits more than
its kept symbols would by chance, 1 / (2 ln 2) bits each and occurrence. Retained contexts discount their counts
and give what is left to that suffix; the root is the smoothed distribution of all words, so every context's
probabilities add up to one.

A word's score is that of the longest retained suffix before it, as a sum over the n-grams that end there: if a
context holds a symbol, so does its suffix, and what the context adds to the suffix's logarithm is a number of the
n-gram. So a text's score is a sum over its n-grams. Those that make up ``HELD_SHARE`` of the training tokens are
broadcast and added in place. All others are asked for: each task sends an n-gram that several of its texts have
once, and the answers come back in the order of the questions. What is shuffled in great number, counts, model and
questions, goes as packed runs of sorted keys for ranges of the hash. Bit filters leave out most n-grams that the
other side does not have.
"""

from __future__ import annotations

import functools
import gc
import math
import pickle
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.text import LOWER, id_text, map_batches, mixed, pieces, rows_of, signed, unmixed, word_hashes, word_spans
from kinfold.session import delete, written

DEPTH = 3
CONTEXT_COUNT = 20
SYMBOL_COUNT = 2
DIVERGENCE = 0.02
DISCOUNT = 0.5
PSEUDO = 0.1
#: Share of the training tokens from which a word or n-gram is held by every task.
HELD_SHARE = 2e-6
FILTER_BITS = 26
MOST_BITS = 27
#: The hash that stands for the end of a text.
END = np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_INVERSE = np.uint64(pow(int(STEP), -1, 1 << 64))
#: Pieces of text whose counts are added before they are shuffled.
ADDED = 24
#: N-grams of texts that are looked up together.
ASKED = 1 << 21
#: Parts of the texts that are scored one after the other, so that what one has asked for is gone when the next asks.
ROUNDS = 4
#: What is dealt out by ranges of the hash: runs of the model, keys asked for, and the texts that ask.
MODEL, ASKS, TEXTS = range(3)


def erase(df: DataFrame) -> None:
    """Delete what ``written`` gave back as ``df`` before its job ends; nothing may read it any more."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        delete(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files of plans that are no longer referred to; else it waits for a full heap.

    What Python let go of is gone from the JVM a moment later, and the cleaner takes its time as well.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; one without an id is not."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


@dataclass
class Tree:
    """The part of a model that tasks hold, sorted by key: all of a small one, else its commonest words and n-grams.

    ``grams`` is what an n-gram adds to the score of its last word, ``rests`` what it adds as the context of the next.
    """

    total: int
    distinct: int
    keys: np.ndarray
    grams: np.ndarray
    rests: np.ndarray
    #: For the root and each retained context held here its suffix of one word less, 0 being the root.
    parent: np.ndarray

    def root(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words with these counts before any context."""
        return (counts + PSEUDO) / (self.total + PSEUDO * (self.distinct + 1))


def found_in(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each in the sorted keys, -1 where it is not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Places:
    """``found_in`` for many searches among the same hashes: their first bits say where to look."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - min(22, max(8, (8 * len(keys)).bit_length())))
        self.first = np.searchsorted(keys, np.arange(1 << 64 - int(self.shift), dtype=np.uint64) << self.shift).astype(np.int32)
        self.stop = np.r_[self.first[1:], np.int32(len(keys))]

    def found(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1)
        slot = (wanted >> self.shift).astype(np.int64)
        at, rest = self.first[slot], np.arange(len(wanted))
        while True:
            inside = np.flatnonzero(at < self.stop[slot])
            if not len(inside):
                return out
            at, slot, rest = at[inside], slot[inside], rest[inside]
            key, seen = wanted[rest], self.keys[at]
            hit = seen == key
            out[rest[hit]] = at[hit]
            on = np.flatnonzero(seen < key)
            at, slot, rest = at[on] + 1, slot[on], rest[on]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, row, number in the row)``: the words of each row, A-Z lower-cased, and its end."""
    lower = LOWER[data]
    starts, ends, first = word_spans(lower, offsets)
    n = len(first) - 1
    row = rows_of(first)
    place = np.arange(len(row)) + row
    hashes = np.full(len(row) + n, END)
    hashes[place] = word_hashes(lower, starts, ends) | np.uint64(2)
    bounds = first + np.arange(n + 1)
    row = rows_of(bounds)
    return hashes, row, np.arange(len(hashes)) - bounds[row]


def ngrams(hashes: np.ndarray, length: int) -> list[np.ndarray]:
    """For each length up to ``length`` the key of the n-gram that ends at each token, whatever row it begins in."""
    keys = [hashes]
    for _ in range(1, length):
        before = np.zeros_like(hashes)
        before[1:] = keys[-1][:-1]
        keys.append(mixed(before * STEP + hashes))
    return keys


def _training(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pa.array([not held_out(d) for d in batch.column("doc_id").to_pylist()], pa.bool_()))


def words(docs: DataFrame) -> DataFrame:
    """``(key, n)`` for every distinct training token, the end of a text among them."""
    def added(parts: list[np.ndarray]) -> dict:
        key, n = np.unique(np.concatenate(parts), return_counts=True)
        return {"key": signed(key), "n": n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts: list = []
        for batch in map(_training, batches):
            for _, _, data, offsets in pieces(batch):
                parts.append(tokens(data, offsets)[0])
                if len(parts) == ADDED:
                    yield added(parts)
                    parts = []
        if parts:
            yield added(parts)
    return map_batches(id_text(docs), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _packed(x: np.ndarray) -> bytes:
    """An array of 64-bit values by planes of bytes, of which those that hardly vary take no room."""
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, kind: type = np.uint64) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view(kind)


def _packed_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as what each is above the one before."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _parts(spark: SparkSession) -> np.ndarray:
    """For each shuffle partition a number that Spark's hash deals to it."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.col("id").cast("int")
    rows = spark.range(64 * n).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("at")).agg(F.min(number).alias("number")).collect()
    out = np.arange(n, dtype=np.int32)
    out[[r["at"] for r in rows]] = [r["number"] for r in rows]
    return out


def _cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of the hash begins in sorted keys, and their end."""
    starts = np.array([-(-(i << 64) // n) for i in range(1, n)], np.uint64)
    return np.r_[0, np.searchsorted(keys, starts), len(keys)]


def _pairs(docs: DataFrame, keys_of, derived: bool) -> DataFrame:
    """``(key, n, context, suffix)`` of the n-grams that the training texts hold ``SYMBOL_COUNT`` times.

    ``keys_of(hash, row, number)`` gives an array of each but ``n``. They are shuffled as one packed run of sorted keys for each
    range of the hash, some 14 bytes an n-gram instead of a row. If ``derived``, the suffix is the last word alone, from
    which the context follows, as ``mixed`` is a bijection; else it goes along.
    """
    parts_of = _parts(docs.sparkSession)

    def added(parts: list[tuple]) -> dict:
        key, suffix = (np.concatenate([p[i] for p in parts]) for i in (0, 2))
        context = suffix if derived else np.concatenate([p[1] for p in parts])
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
        n = np.diff(np.r_[first, len(key)])
        key, at = key[first], order[first]
        suffix, context = suffix[at], context[at]
        cuts = _cuts(key, len(parts_of))
        runs = [(p, slice(a, b)) for p, a, b in zip(parts_of.tolist(), cuts[:-1], cuts[1:]) if b > a]
        return {"part": [p for p, _ in runs], "key": [_packed_sorted(key[r]) for _, r in runs], "n": [_packed(n[r]) for _, r in runs],
                "suffix": [_packed(suffix[r]) for _, r in runs], "context": [None if derived else _packed(context[r]) for _, r in runs]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts: list = []
        for batch in map(_training, batches):
            for _, _, data, offsets in pieces(batch):
                key, context, suffix = keys_of(*tokens(data, offsets))
                parts.append((key, None if derived else context, suffix))
                if len(parts) == ADDED:
                    yield added(parts)
                    parts = []
        if parts:
            yield added(parts)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        runs = [r for batch in batches for r in batch.select(["key", "n", "suffix", "context"]).to_pylist()]
        if not runs:
            return
        key = np.concatenate([_unpacked_sorted(r["key"]) for r in runs])
        order = np.argsort(key, kind="stable")  # merges what is sorted already
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.add.reduceat(np.concatenate([_unpacked(r["n"], np.int64) for r in runs])[order], first)
        kept = n >= SYMBOL_COUNT
        key, n, at = key[first[kept]], n[kept], order[first[kept]]
        suffix = np.concatenate([_unpacked(r["suffix"]) for r in runs])[at]
        context = (unmixed(key) - suffix) * STEP_INVERSE if derived else np.concatenate([_unpacked(r["context"]) for r in runs])[at]
        for lo in range(0, len(key), 1 << 16):
            rows = slice(lo, lo + (1 << 16))
            yield {"key": signed(key[rows]), "n": n[rows], "context": signed(context[rows]), "suffix": signed(suffix[rows])}
    dealt = map_batches(id_text(docs), run, "part int, key binary, n binary, suffix binary, context binary").repartition(len(parts_of), "part")
    return map_batches(dealt, summed, "key long, n long, context long, suffix long")


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A bit for each value of a key's first bits: ``_maybe`` is never wrong about keys it has not.

    There are 32 bits for each key, 2 ** ``FILTER_BITS`` at least and 2 ** ``MOST_BITS`` at most, of which the driver sees rows of
    64. Keys that meet by chance are sorted out by later joins.
    """
    size = min(MOST_BITS, max(FILTER_BITS, (32 * keys.count()).bit_length()))
    slot = F.shiftrightunsigned("key", 64 - size)
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    rows = keys.select(slot.alias("slot")).groupBy(F.expr("slot >> 6").alias("at")).agg(F.bit_or(bit).alias("bits"))
    rows = rows.toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys >> np.uint64(64 - len(bits).bit_length() + 1 - 6)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def model(docs: DataFrame, table: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, int, int]:
    """``(key, n, base, gram, rest, parent)`` of words and n-grams that bear on scores, tokens, and distinct tokens.

    A word's ``base`` and ``gram`` are its logarithm at the root. An n-gram's ``gram`` is what its last word gains by
    the context before it over the context's suffix, less the context's ``rest``; ``rest`` is the logarithm of what
    the n-gram, as a retained context, hands down for words it does not hold. The rows of one key add up.
    """
    spark = docs.sparkSession
    total, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    root = (F.col("n") + PSEUDO) / (total + PSEUDO * (distinct + 1))
    none, no_base = F.lit(None).cast("long"), F.lit(None).cast("double")
    known = table.select("key", "n", F.lit(0).cast("long").alias("suffix"), root.alias("chance"))
    parts = [known.select("key", "n", F.log10("chance").alias("base"), F.log10("chance").alias("gram"),
                          F.lit(0.0).alias("rest"), none.alias("parent"))]
    for length in range(2, depth + 2):
        contexts = known.filter(F.col("n") >= CONTEXT_COUNT)
        # a pair is no more frequent than its context's suffix and the symbol
        given = spark.sparkContext.broadcast((_filter_of(contexts), _filter_of(known.filter(F.col("n") >= SYMBOL_COUNT))))

        def pairs(hashes: np.ndarray, row: np.ndarray, number: np.ndarray, given=given, length=length) -> tuple:
            *_, shorter, key = ngrams(hashes, length)
            at = np.flatnonzero(number >= length - 1)
            at = at[_maybe(given.value[0], shorter[at - 1])]
            at = at[_maybe(given.value[1], shorter[at])]
            return key[at], shorter[at - 1], shorter[at]
        counted = written(_pairs(docs, pairs, length == 2), "counted")
        given.unpersist()
        free_shuffles(spark)
        seen = written(counted.join(known.select(F.col("key").alias("suffix"), F.col("chance").alias("expected")), "suffix"),
                       "pairs")
        erase(counted)
        del counted
        free_shuffles(spark)
        sums = seen.groupBy("context").agg(
            F.sum(F.col("n") * F.log2(F.col("n") / F.col("expected"))).alias("bits"), F.sum("n").alias("held"),
            F.sum("expected").alias("expected"), F.count("*").alias("kept"))
        sums = sums.join(contexts.select(F.col("key").alias("context"), F.col("n").alias("occurs"),
                                         F.col("suffix").alias("parent")), "context")
        other = 1 - F.col("held") / F.col("occurs")
        above = F.greatest(F.lit(1e-12), 1 - F.col("expected"))
        bits = (F.col("bits") - F.col("held") * F.log2("occurs")) / F.col("occurs") + F.when(
            other > 1e-12, other * F.log2(other / above)).otherwise(0.0)
        by_chance = F.col("kept") / (2 * math.log(2) * F.col("occurs"))
        handed = 1 - (F.col("held") - DISCOUNT * F.col("kept")) / F.col("occurs")
        tested = written(sums.select("context", "occurs", "parent",
                                     F.when(bits - by_chance >= DIVERGENCE, handed).alias("handed")), "contexts")
        parts.append(tested.filter("handed is not null").select(
            F.col("context").alias("key"), F.col("occurs").alias("n"), no_base, F.lit(0.0), F.log10("handed"), "parent"))
        own = (F.col("n") - DISCOUNT) / F.col("occurs") + F.col("handed") * F.col("expected")
        known = written(seen.join(tested.drop("parent"), "context").select(
            "key", "n", F.when(F.col("n") >= CONTEXT_COUNT, F.col("suffix")).alias("suffix"),
            F.coalesce(own, F.col("expected")).alias("chance"),
            (F.log10(own / F.col("expected")) - F.log10("handed")).alias("gram")), "chances")
        erase(seen)
        del seen, sums, bits, own, other, above, handed
        free_shuffles(spark)
        parts.append(known.filter("gram is not null").select("key", "n", no_base, "gram", F.lit(0.0), none))
    return functools.reduce(DataFrame.union, parts), total, distinct


def _held(made: DataFrame, total: int, distinct: int) -> Tree:
    """What tasks hold: for each length of n-grams at most 1 / HELD_SHARE."""
    rows = made.filter(F.col("n") >= HELD_SHARE * total).groupBy("key").agg(
        F.sum("gram").alias("gram"), F.sum("rest").alias("rest"), F.max("parent").alias("parent")).toArrow()
    keys = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    parent = rows.column("parent").drop_null().to_numpy()
    return Tree(total, distinct, keys[order], rows.column("gram").to_numpy()[order], rows.column("rest").to_numpy()[order],
                np.r_[0, parent])


def learned(docs: DataFrame, table: DataFrame, depth: int = DEPTH) -> Tree:
    """The tree of the training texts, whose words ``table`` counts, as far as tasks hold it."""
    return _held(*model(docs, table, depth))


def in_place(tree: Tree, hashes: np.ndarray, number: np.ndarray, depth: int = DEPTH) -> tuple:
    """``(word, score, base)`` of each token; a word the tree does not hold, -1, has only what leads to the root."""
    score = np.zeros(len(hashes))
    base, word = score, None
    for length, keys in enumerate(ngrams(hashes, depth + 1), 1):
        at = found_in(tree.keys, keys)
        at[number < length - 1] = -1
        hit = np.flatnonzero(at >= 0)
        if word is None:
            word = at
            base = np.zeros(len(hashes))
            base[hit] = tree.grams[at[hit]]
        score[hit] += tree.grams[at[hit]]
        # an n-gram that ends a text has no rest, so what follows is in the same row
        hit = hit[hit < len(hashes) - 1]
        score[hit + 1] += tree.rests[at[hit]]
    return word, score, base


def _model_runs(made: DataFrame, parts_of: np.ndarray) -> DataFrame:
    """The model as packed runs of sorted keys, with what a key adds to the score at the root and to the score beside that."""
    def packed(parts: list[pa.RecordBatch]) -> dict:
        key, base, other = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("key", "base", "other"))
        key = key.view(np.uint64)
        order = np.argsort(key)
        key, base, other = key[order], base[order], other[order]
        cuts = _cuts(key, len(parts_of))
        runs = [(p, slice(a, b)) for p, a, b in zip(parts_of.tolist(), cuts[:-1], cuts[1:]) if b > a]
        return _dealt([(p, MODEL, 0, 0, _packed_sorted(key[r]), _packed(base[r]), _packed(other[r])) for p, r in runs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts, size = [], 0
        for batch in batches:
            parts.append(batch)
            size += batch.num_rows
            if size >= ASKED:
                yield packed(parts)
                parts, size = [], 0
        if size:
            yield packed(parts)
    rows = made.select("key", F.coalesce("base", F.lit(0.0)).alias("base"),
                       F.when(F.col("base").isNotNull(), F.col("rest")).otherwise(F.col("gram") + F.col("rest")).alias("other"))
    return map_batches(rows, run, DEALT)


DEALT = "part int, kind int, chunk long, at int, x binary, y binary, z binary"


def _dealt(rows: list[tuple]) -> dict:
    return dict(zip(("part", "kind", "chunk", "at", "x", "y", "z"), zip(*rows) if rows else [()] * 7))


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Of one range of the hash the model, then what is asked of it: for each key what it adds, 0 where the model has none."""
    runs, key = [], None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["kind"] == MODEL:
                runs.append((_unpacked_sorted(r["x"]), _unpacked(r["y"], np.float64), _unpacked(r["z"], np.float64)))
                continue
            if r["kind"] == TEXTS:
                out.append((0, TEXTS, r["chunk"], 0, r["x"], None, None))
                continue
            if key is None:
                key, base, other = _summed_model(runs)
                runs = []
            at = found_in(key, _unpacked_sorted(r["x"]))
            values = [_packed(np.where(at >= 0, v[at], 0.0) if len(v) else np.zeros(len(at))) for v in (base, other)]
            out.append((0, ASKS, r["chunk"], r["at"], *values, None))
        yield _dealt(out)


def _summed_model(runs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs as one, the rows of one key added up."""
    if not runs:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    key, base, other = (np.concatenate(x) for x in zip(*runs))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(base[order], first), np.add.reduceat(other[order], first)


def _packed_rising(at: np.ndarray, row: np.ndarray) -> bytes:
    """Places of each row, the lowest first, as what each is above the one before; in which order they are added does not count."""
    both = np.sort(row.astype(np.int64) << 32 | at)
    at, row = both & 0xFFFFFFFF, both >> 32
    step = np.diff(at, prepend=0)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    step[first] = at[first]
    return _packed(step)


def _rising(data: bytes, sizes: np.ndarray) -> np.ndarray:
    at = np.cumsum(_unpacked(data, np.int64))
    first = np.cumsum(sizes) - sizes
    return at - np.repeat(np.r_[0, at][first], sizes)


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Scores of the texts of each chunk, once the answers of all ranges of the hash are there, in their order."""
    base, other = [], []
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == ASKS:
                base.append(_unpacked(r["x"], np.float64))
                other.append(_unpacked(r["y"], np.float64))
                continue
            texts = pickle.loads(pa.decompress(r["x"][8:], int.from_bytes(r["x"][:8], "little"), "zstd"))
            rows = len(texts["known"])
            if base:
                row = np.repeat(np.arange(rows), texts["asked"])
                at = _rising(texts.pop("at"), texts.pop("asked"))
                at_root = np.concatenate(base)[at]
                more = np.bincount(row, at_root, rows)
                texts["known"] = texts["known"] + np.bincount(row[at_root != 0], minlength=rows)
                texts["base"] = texts["base"] + more
                texts["score"] = texts["score"] + more + np.bincount(row, np.concatenate(other)[at], rows)
            base, other = [], []
            yield texts


def scored(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Texts with ``crc32(doc_id) mod 10`` not 0 are learned from, as are those without an id; null and empty texts
    are their end alone. Repeated rows are learned from and scored once each. Without training texts every token is
    unknown and all scores are the smoothed zero count's.

    What tasks do not hold is asked for: texts are taken together, each n-gram they may need is sent once, sorted, to the range of
    the hash that has its part of the model, and the answers come back to the texts in the same order.
    """
    spark = docs.sparkSession
    made, total, distinct = model(docs, written(words(docs), "words"), depth)
    parts_of = _parts(spark)
    # an n-gram bears on scores if its context is retained or it is itself a retained context
    given = spark.sparkContext.broadcast((_held(made, total, distinct), _filter_of(made), _filter_of(made.filter("parent is not null"))))
    runs = written(_model_runs(made, parts_of), "model")
    erase(made)

    def asked(texts: list[dict], far: list[np.ndarray], chunk: int) -> dict:
        keys, at = np.unique(np.concatenate(far), return_inverse=True)
        cuts = _cuts(keys, len(parts_of))
        rows = [(p, ASKS, chunk, i, _packed_sorted(keys[a:b]), None, None)
                for i, (p, a, b) in enumerate(zip(parts_of.tolist(), cuts[:-1], cuts[1:])) if b > a]
        whole = {name: np.concatenate([t[name] for t in texts]) for name in texts[0] if name != "doc_id"}
        whole["doc_id"] = pa.concat_arrays([t["doc_id"] for t in texts])
        whole["at"] = _packed_rising(at, np.repeat(np.arange(len(whole["asked"])), whole["asked"]))
        data = pickle.dumps(whole)
        data = len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)
        place = (chunk >> 33) + (chunk & (1 << 33) - 1)
        return _dealt([*rows, (int(parts_of[place % len(parts_of)]), TEXTS, chunk, 0, data, None, None)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, bits, contexts = given.value
        places = Places(held.keys)
        chunk, texts, far, size = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                hashes, row, number = tokens(data, offsets)
                rows, ids = hi - lo, batch.column("doc_id").slice(lo, hi - lo)
                known, base, score = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
                owners, keys_of, shorter = [], [], None
                for length, keys in enumerate(ngrams(hashes, depth + 1), 1):
                    at = places.found(keys)
                    whole = number >= length - 1
                    hit = np.flatnonzero((at >= 0) & whole)
                    score += np.bincount(row[hit], held.grams[at[hit]] + held.rests[at[hit]], rows)
                    if length == 1:
                        known += np.bincount(row[hit], minlength=rows)
                        base += np.bincount(row[hit], held.grams[at[hit]], rows)
                    rest = np.flatnonzero((at < 0) & whole)
                    rest = rest[_maybe(bits, keys[rest])]
                    if length > 1:
                        rest = rest[_maybe(contexts, shorter[rest - 1]) | _maybe(contexts, keys[rest])]
                    owners.append(row[rest])
                    keys_of.append(keys[rest])
                    shorter = keys
                owner, key = np.concatenate(owners), np.concatenate(keys_of)
                far.append(key[np.argsort(owner, kind="stable")])
                size += len(key)
                texts.append({"doc_id": ids, "held_out": np.array([held_out(d) for d in ids.to_pylist()], bool),
                              "n_tokens": np.bincount(row, minlength=rows), "known": known, "base": base, "score": score,
                              "asked": np.bincount(owner, minlength=rows)})
                if size >= ASKED:
                    yield asked(texts, far, chunk)
                    chunk, texts, far, size = chunk + 1, [], [], 0
        if texts:
            yield asked(texts, far, chunk)

    def scores(texts: DataFrame) -> DataFrame:
        dealt = map_batches(texts, run, DEALT).unionByName(runs).repartition(len(parts_of), "part").sortWithinPartitions("kind")
        answers = map_batches(dealt, _answered, DEALT).repartition(len(parts_of), "chunk").sortWithinPartitions("chunk", "kind", "at")
        return written(map_batches(answers, _added_up, "doc_id long, held_out boolean, n_tokens long, known long, base double, "
                                                       "score double"), "scores")
    parts, rounds = [], min(ROUNDS, 1 + total // ASKED)
    for i in range(rounds):
        texts = id_text(docs)
        parts.append(scores(texts if rounds == 1 else texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == i)))
        free_shuffles(spark)
    given.unpersist()
    erase(runs)
    rows = functools.reduce(DataFrame.union, parts)
    unseen = (F.col("n_tokens") - F.col("known")) * math.log10(PSEUDO / (total + PSEUDO * (distinct + 1)))
    return rows.select(
        "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + unseen).alias("base_score"), (F.col("score") + unseen).alias("score"))
