"""Near-duplicate classes by DartMinHash signatures and banded joins (Christiani, "DartMinHash", 2020).

A document is a weighted set of shingles. Each shingle throws darts into the plane of weight and rank: a
Poisson process of one dart a unit area, drawn by hashes of the shingle and the cell, so that all documents see
the same darts. A dart counts for a document if it falls below the shingle's weight and below a rank at which
about k ln k + 2 k darts of the whole document lie. Each dart belongs to one of k coordinates, which keeps its
dart of least rank. That costs O(shingles + k log k), and two documents agree on a coordinate with the
probability of their weighted Jaccard similarity. Documents with an empty coordinate look twice as far.

Coordinates are cut into bands; documents with an equal band meet in a bucket. Equal texts are one document
first. Then each document is compared with the least hub, the first of a bucket, that it meets, links are verified on
the texts, and linked documents become classes, so that a bucket of thousands of near copies costs a row for each copy.
Of what is still in buckets with several classes, shingles that only one document has are counted: they bound
every similarity exactly, and documents too different from all others go. The rest meets hub by hub, those in the most
company first, which are what others are copies of, and many times as many each round, until no bucket holds two classes that have not been compared. No candidate is dropped. Members and
hubs carry their signatures, which are compared within the join: texts are read of pairs that may be links, no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinfold.llm.text import (id_text, map_batches, mixed, pieces, rows_of, signed, texts_of, window_hashes,
                              word_hashes, word_spans)
from kinfold.session import written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6
#: Hubs of a bucket in the first round after the grouping, and times as many in each further round.
HUBS, MORE_HUBS = 1, 8
#: Pairs whose signatures agree on fewer coordinates than this below the similarity are not read. It is 4.6 standard
#: deviations of the estimate: of links just at the similarity two in a million are missed, fewer than by the bands.
SLACK = 0.12
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1.0, 14.0)]))


def shingles(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, row, weight)`` of the distinct shingles of each row, sorted by row and hash; weight counts them.

    A row of fewer words than a shingle, but one at least, is one shingle of all its words.
    """
    starts, ends, first = word_spans(data, offsets)
    words, row = word_hashes(data, starts, ends), rows_of(first)
    at = np.arange(len(row))
    whole = first[row + 1] - at >= length
    hashes = np.zeros(len(row), np.uint64)
    hashes[whole] = window_hashes(words, at[whole], length)
    sizes = np.diff(first)
    for n in range(1, length):
        short = first[:-1][sizes == n]
        hashes[short] = window_hashes(words, short, n)
        whole[short] = True
    hashes, row = hashes[whole], row[whole]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], row[new], np.diff(np.r_[np.flatnonzero(new), len(row)])


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0 ** -53


def dart_minhash(element: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """``(rows, k)`` dart hashes; a row without elements has zeros."""
    out = np.zeros((rows, k), np.uint64)
    total = np.bincount(row, weight, rows)
    reach = np.zeros(rows)
    reach[total > 0] = k * (np.log(k) + 2) / total[total > 0]
    while len(element):
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low_weight = 0
        while (heavy := np.flatnonzero(weight > low_weight)).size:
            low_rank = 0
            while (live := heavy[reach[row[heavy]] > low_rank]).size:
                seed = mixed(element[live] + np.uint64((low_weight * 0x9E3779B97F4A7C15 + low_rank * 0xD1342543DE82EF95 + 1)
                                                       % (1 << 64)))
                area = (low_weight + 1) * (low_rank + 1)  # cells double in both directions
                strip = np.arange(area)
                own = mixed(seed[:, None] + (strip + 1).astype(np.uint64)).ravel()
                n = np.searchsorted(_POISSON, _uniform(own))
                which = np.repeat(np.arange(len(own)), n)
                number = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + 1).astype(np.uint64)
                dart = mixed(own[which] + number * np.uint64(0x9E3779B97F4A7C15))
                shingle = live[which // area]
                # a strip has its share of the cell's ranks and all of its weights, and an area of one
                rank = low_rank + (which % area + _uniform(mixed(dart + np.uint64(1)))) * (low_rank + 1) / area
                keep = rank <= reach[row[shingle]]
                if low_weight or weight.max() > 1:
                    keep &= low_weight + _uniform(mixed(dart + np.uint64(2))) * (low_weight + 1) < weight[shingle]
                found.append((rank[keep], dart[keep], row[shingle[keep]]))
                low_rank = 2 * low_rank + 1
            low_weight = 2 * low_weight + 1
        rank, dart, owner = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(rank)[::-1]
        place = owner * k + (mixed(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64)
        flat = np.zeros(rows * k, np.uint64)
        flat[place[order]] = dart[order] | np.uint64(1)  # the last of equal places stays: the least rank
        made = flat.reshape(rows, k)
        full = np.flatnonzero((made != 0).all(axis=1))
        out[full] = made[full]
        again = ~np.isin(row, full)
        element, row, weight = element[again], row[again], weight[again]
        reach *= 2
    return out


def sketches(docs: DataFrame, bands: int, rows: int, length: int, counts: bool) -> DataFrame:
    """``(doc_id, text_key, size, bands, marks)``: one byte of each coordinate is kept to compare signatures, seven to a number."""
    import hashlib
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                element, row, weight = shingles(data, offsets, length)
                weight = weight if counts else np.ones_like(weight)
                signature = dart_minhash(element, row, weight, hi - lo, k)
                key = np.zeros((hi - lo, bands), np.uint64)
                for i in range(rows):
                    key = mixed(key + signature[:, i::rows])
                key = mixed(key + np.arange(1, bands + 1, dtype=np.uint64))
                size = np.bincount(row, weight, hi - lo).astype(np.int64)
                kept = (mixed(signature) >> np.uint64(56)).astype(np.uint8)
                marks = np.zeros((hi - lo, -(-k // 7), 8), np.uint8)
                marks[:, :, :7] = np.pad(kept, ((0, 0), (0, -k % 7))).reshape(hi - lo, -1, 7)
                raw = data.tobytes()
                yield {"doc_id": batch.column("doc_id").slice(lo, hi - lo),
                       "text_key": [hashlib.blake2b(raw[a:b], digest_size=16).digest()
                                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())],
                       "size": size, "bands": [x if n else [] for x, n in zip(list(signed(key)), size.tolist())],
                       "marks": list(marks.reshape(hi - lo, -1).view("<i8"))}
    return map_batches(id_text(docs), run, "doc_id long, text_key binary, size long, bands array<long>, marks array<long>")


def agreement(a: str, b: str, coordinates: int) -> Column:
    """The share of coordinates on which two columns of marks agree: seven bytes a number, compared at once."""
    low, high = (F.lit(int.from_bytes(bytes([x] * 7))) for x in (0x7F, 0x80))

    def unlike(x: Column, y: Column) -> Column:
        both = x.bitwiseXOR(y)
        return F.bit_count((both.bitwiseAND(low) + low).bitwiseOR(both).bitwiseAND(high))
    apart = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda n, x: n + x)
    return 1 - apart / F.lit(coordinates)


def similar(pairs: DataFrame, length: int, counts: bool, similarity: float) -> DataFrame:
    """Those of ``(a, b, ..., a_text, b_text)`` whose shingles have at least the similarity, without the texts."""
    kept = [c for c in pairs.columns if c[2:] != "text"]

    def alike(a: bytes, b: bytes) -> bool:
        element, row, weight = shingles(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b)]), length)
        weight = weight if counts else np.ones_like(weight)
        cut = np.searchsorted(row, 1)
        _, i, j = np.intersect1d(element[:cut], element[cut:], True, True)
        both = np.minimum(weight[:cut][i], weight[cut:][j]).sum()
        return both >= similarity * (weight.sum() - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                keep = [alike(a, b) for a, b in zip(texts_of(part, "a_text"), texts_of(part, "b_text"))]
                chosen = part.select(kept).filter(pa.array(keep, pa.bool_()))
                yield {c: chosen.column(c) for c in kept}
    return map_batches(pairs, run, StructType([pairs.schema[c] for c in kept]))


def connected(edges: DataFrame) -> DataFrame:
    """``(v, label)``: for each vertex of ``edges(u, v)`` but the least of a component, that least one.

    Alternating star steps, both in one plan: minima are pre-aggregated, and no neighbourhood is collected.
    """
    def lowest(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("u").agg(F.min("v").alias("low")), "u")
    current = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while (new := current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()) != mark:
        mark = new
        both = current.union(current.select("v", "u"))
        large = lowest(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()
        small = lowest(large)
        current = written(small.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(
            small.select("u", "low")).filter("u <> v").distinct(), "edges")
    return current.select(F.col("u").alias("v"), F.col("v").alias("label"))


def own_shingles(texts: DataFrame, length: int, counts: bool) -> DataFrame:
    """``(doc_id, own)``: the weight of each document's shingles that no other document of ``texts`` has.

    A part of the rows reports a shingle that several of its documents have once, without any of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            doc = batch.column("doc_id").to_numpy(False)
            for lo, hi, data, offsets in pieces(batch):
                element, row, weight = shingles(data, offsets, length)
                key, first, n = np.unique(element, return_index=True, return_counts=True)
                held = pa.array(doc[lo:hi][row[first]], mask=n > 1)
                yield {"key": signed(key), "doc_id": held, "weight": weight[first] if counts else np.ones_like(n)}
    rows = map_batches(texts, run, "key long, doc_id long, weight long")
    single = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("doc_id"), F.max("weight").alias("weight"))
    return single.filter("n = 1 and doc_id is not null").groupBy("doc_id").agg(F.sum("weight").alias("own"))


def rooted(links: DataFrame) -> DataFrame:
    """``(v, label)`` from links ``(a, b)`` of each ``b`` to one smaller ``a``: labels of labels, until none has another."""
    labels = written(links.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("label")), "labels")
    while True:
        above = labels.select(F.col("v").alias("label"), F.col("label").alias("above"))
        labels = written(labels.join(above, "label", "left").select(
            "v", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved")), "labels")
        if labels.filter("moved").isEmpty():
            return labels.drop("moved")
        labels = labels.drop("moved")


def classes(docs: DataFrame, similarity: float = SIMILARITY, length: int = SHINGLE, bands: int = BANDS,
            rows: int = ROWS, counts: bool = False) -> DataFrame:
    """``(doc_id, class_id)`` of every row: the least id linked to it, directly or not, by near copies.

    Two texts are linked if their sets of ``length``-word shingles (with ``counts``, their bags) have at least
    the Jaccard similarity. Equal texts are always linked, null as empty. A text without words is linked
    to equal texts only. A row's class is that of its text, so texts that share an id are not linked by it. A null id has the
    class of its text's other rows, null if none has an id. Words are bytes between white space, unchanged.
    """
    made = written(sketches(docs, bands, rows, length, counts), "sketches")
    texts = written(made.filter("doc_id is not null").groupBy("text_key").agg(
        F.min_by(F.struct("doc_id", "size", "bands", "marks"), "doc_id").alias("x")).select("text_key", "x.*"), "texts")
    whole = id_text(docs)

    def with_texts(pairs: DataFrame, source: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(source.withColumnsRenamed(
                {"doc_id": side, "text": f"{side}_text", "marks": f"{side}_marks"}), side)
        return pairs

    def still_apart(rows: DataFrame) -> DataFrame:
        """The members of buckets that hold two classes."""
        several = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        return written(rows.join(several.select("key"), "key"), "apart")

    def near_in_size(a: str, b: str) -> Column:
        return F.least(a, b) >= similarity * F.greatest(a, b)

    # first each document meets the least hub of its buckets, to group what is plainly alike
    members = texts.select(F.explode("bands").alias("key"), F.col("doc_id").alias("v"), "size")
    bucket = members.groupBy("key").agg(F.min(F.struct("v", "size")).alias("hub"), F.max("v").alias("top")).filter("hub.v < top")
    members = written(members.join(bucket, "key").select("key", "v", "size", "hub"), "members")
    met = members.filter("v <> hub.v").filter(near_in_size("size", "hub.size"))
    pairs = met.groupBy(F.col("v").alias("b")).agg(F.min("hub.v").alias("a"))
    close = with_texts(pairs, texts.select("doc_id", "marks")).filter(
        agreement("a_marks", "b_marks", bands * rows) >= similarity - SLACK).select("a", "b")
    labels = rooted(similar(with_texts(close, whole), length, counts, similarity))
    apart = still_apart(members.join(labels, "v", "left").select("key", "v", "size", F.coalesce("label", "v").alias("label")))
    merged, hubs = None, HUBS
    if not apart.isEmpty():
        # an id that stands for several texts has no bound of its own
        ids = apart.select(F.col("v").alias("doc_id")).distinct()
        open_texts = written(whole.join(ids, "doc_id"), "open")
        single = open_texts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n = 1").select("doc_id")
        own = own_shingles(open_texts, length, counts).join(single, "doc_id").withColumnRenamed("doc_id", "v")
        apart = apart.join(own, "v", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        apart = still_apart(apart.filter(F.col("own") <= (1 - similarity) * F.col("size") + 1e-6))
        # the text that others are copies of lies in the buckets of nearly all of them, and so in more company than any copy
        company = apart.join(apart.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("v").agg(F.sum("n").alias("company"))
        apart = written(apart.join(company, "v").join(texts.select(F.col("doc_id").alias("v"), "marks"), "v"), "apart")
    while not apart.isEmpty():
        slot = F.pmod(F.xxhash64("v", F.lit(hubs)), F.lit(hubs)).alias("slot")
        hub = written(apart.groupBy("key", slot).agg(F.max_by(F.struct("v", "label", "size", "own", "marks"), F.struct(
            "company", "v")).alias("hub")).select("key", "hub"), "hubs")
        # the most two sets can share is what neither has alone, and the least they differ by is what each has alone
        shared = F.least(F.col("size") - F.col("own"), F.col("hub.size") - F.col("hub.own"))
        met = apart.join(hub, "key").filter("label <> hub.label").filter(near_in_size("size", "hub.size") & (
            shared * (1 - similarity) >= (F.col("own") + F.col("hub.own")) * similarity - 1e-6) & (
            agreement("marks", "hub.marks", bands * rows) >= similarity - SLACK))
        pairs = met.select(F.least("v", "hub.v").alias("a"), F.greatest("v", "hub.v").alias("b"), F.col("label").alias("u"),
                           F.col("hub.label").alias("v")).dropDuplicates(["a", "b"])
        found = written(similar(with_texts(pairs, open_texts), length, counts, similarity), "links")
        if not found.isEmpty():
            step = connected(found.select("u", "v")).select(F.col("v").alias("label"), F.col("label").alias("into"))
            apart = apart.join(step, "label", "left").withColumn("label", F.coalesce("into", "label")).drop("into")
            # what earlier rounds merged follows this one; labels that went never come back, so each is there once
            merged = step if merged is None else written(merged.join(
                step.select(F.col("label").alias("into"), F.col("into").alias("next")), "into", "left").select(
                "label", F.coalesce("next", "into").alias("into")).unionByName(step), "merged")
        # these hubs have met every document of their buckets and need not meet any again
        apart = written(still_apart(apart).join(hub.select("key", F.col("hub.v").alias("v")), ["key", "v"], "left_anti"), "apart")
        hubs *= MORE_HUBS
    of_text = texts.select("text_key", F.col("doc_id").alias("v")).join(labels, "v", "left").select(
        "text_key", F.coalesce("label", "v").alias("label"))
    if merged is not None:
        of_text = of_text.join(merged, "label", "left").select("text_key", F.coalesce("into", "label").alias("label"))
    return made.select("doc_id", "text_key").join(of_text, "text_key", "left").select(
        "doc_id", F.col("label").alias("class_id"))
