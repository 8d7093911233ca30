"""Deduplication, sharding, packing and the codec against plain versions, with the odd cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinfold.llm import bpe, lines, minhash, packing, sharding, substrings
from kinfold.llm import queries as Q

from llm import cases

P = pytest.importorskip("public_tokenizers")
EMPTY = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows():
    return cases.corpus()


@pytest.mark.parametrize("seed", [0, 1])
def test_near_classes(spark, seed):
    rows = cases.corpus(seed)
    want = cases.near_classes(rows)
    got = minhash.classes(cases.frame(spark, rows, extra=True)).collect()
    assert cases.sort((r.doc_id, r.class_id) for r in got) == cases.sort((d, want.get(t or "")) for d, t in rows)
    assert minhash.classes(spark.createDataFrame([], EMPTY)).collect() == []


def test_hubs_find_links_inside_a_bucket(spark):
    """A chain whose ends are far apart is one class, though its least member links to the next only."""
    base = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(base[6 * i:] + [f"new{j}" for j in range(6 * i)])) for i in range(8)]
    want = cases.near_classes(rows)
    got = {r.doc_id: r.class_id for r in minhash.classes(cases.frame(spark, rows)).collect()}
    assert got == {d: want[t] for d, t in rows} and set(got.values()) == {0}


def test_darts_estimate_weighted_similarity():
    r = np.random.default_rng(3)
    element = r.integers(0, 2**63, 80, dtype=np.uint64)
    a, b = r.integers(1, 9, 80), r.integers(1, 9, 80)
    signature = minhash.dart_minhash(np.r_[element, element], np.repeat([0, 1], 80), np.r_[a, b], 2, 4096)
    assert abs((signature[0] == signature[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


@pytest.mark.parametrize("seed", [0, 2])
def test_passages(spark, seed):
    rows = cases.corpus(seed)
    got = substrings.deduplicated(cases.frame(spark, rows, extra=True))
    assert got.columns == ["doc_id", "text", "key", "found", "score", "kept", "n_words", "n_removed"]
    got = got.select("doc_id", "text", "n_words", "n_removed").collect()
    assert cases.sort(map(tuple, got)) == cases.sort(cases.without_passages(rows))
    assert substrings.deduplicated(spark.createDataFrame([], EMPTY)).collect() == []


def test_repeated_windows_of_one_document(spark):
    rows = [(1, "x y " * 60), (2, "a " * 70 + "x y " * 40), (3, "a " * 70)]
    got = substrings.deduplicated(cases.frame(spark, rows)).select("doc_id", "text", "n_words", "n_removed").collect()
    assert cases.sort(map(tuple, got)) == cases.sort(cases.without_passages(rows))


def test_cover_has_every_difference():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


@pytest.mark.parametrize("batches", [1, 9])
def test_lines(spark, rows, batches):
    got = lines.deduplicated(cases.frame(spark, rows, extra=True), batches=batches, fan_in=2)
    got = got.select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert cases.sort(map(tuple, got)) == cases.sort(cases.without_lines(rows))
    assert any(r.n_dropped for r in got)
    assert lines.deduplicated(spark.createDataFrame([], EMPTY)).collect() == []


def test_runs_are_compacted(spark):
    index = lines.LineRuns(spark, fan_in=2)
    for i in range(6):
        index.add(cases.frame(spark, [(i, "a line that is long enough\nother")]))
    assert [len(level) for level in index.levels] == [0, 1, 1]
    assert [(r.last_doc) for r in index.frequent(6).collect()] == [5]
    assert index.frequent(7).collect() == []


def test_shards(spark, rows):
    got = sharding.sharded(cases.frame(spark, rows, extra=True), shards=4).collect()
    sizes = {t: len((t or "").encode()) + 16 for _, t in rows}
    assert cases.sort((r.doc_id, r["size"], r.text_crc32) for r in got) == cases.sort(
        (d, sizes[t], zlib.crc32((t or "").encode())) for d, t in rows)
    shard_of, load, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        shard_of[r.text_crc32].add(r.shard)
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(x) == 1 for x in shard_of.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load.values()) - min(load.values()) <= 0.1 * max(load.values())
    assert sharding.sharded(spark.createDataFrame([], EMPTY)).collect() == []


def test_longest_first_is_greedy():
    assert sharding.longest_first([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], 2) == {
        "a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_packing(spark, rows):
    docs = cases.frame(spark, rows + [(77, "word " * 5000)], extra=True)
    got = packing.packed(docs, Q.packing_encoder, group=16).collect()
    encode = __import__("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d, t in rows + [(77, "word " * 5000)]:
        ids = np.array(encode.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(d, i, len(ids[i:i + 1024]), zlib.crc32(ids[i:i + 1024].tobytes()), len(ids))
                 for i in range(0, len(ids), 1024)]
    assert cases.sort((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == cases.sort(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.packed(spark.createDataFrame([], EMPTY), Q.packing_encoder).collect() == []


def test_packing_ids_are_those_of_the_library():
    whole = __import__("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    r = random.Random(3)
    texts = ["".join(r.choice([*ALPHABET, "<|endoftext|>", " <|endoftext|> ", "\xa0"]) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    want = [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Q.packing_encoder()(texts)] == want


def test_packing_ids_of_the_given_texts():
    import pyarrow.parquet as pq
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    want = [x.ids for x in __import__("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Q.packing_encoder()(texts)] == want


def test_rows_without_an_id_are_packed_in_many_groups(spark):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('word ', id) as text")
    got = packing.packed(docs, Q.packing_encoder, group=500).collect()
    groups = Counter(r.sequence_id >> 32 for r in got)
    assert len(groups) == 8 and max(groups.values()) < 700 and len(got) == 4000


def test_first_fit_matches_a_scan():
    r = random.Random(4)
    lengths = np.array(sorted((r.randint(1, 1024) for _ in range(300)), reverse=True))
    bins, offsets = packing.first_fit(lengths, 1024)
    free = []
    for length, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        k = next((i for i, f in enumerate(free) if f >= length), len(free))
        if k == len(free):
            free.append(1024)
        assert (b, o) == (k, 1024 - free[k])
        free[k] -= length


ALPHABET = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "中", "文", "👍", "1", "23", "'s", "'ll", "!", "?!", "\x1c", "\x85"]


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_codec_matches_the_library(name):
    import tiktoken
    codec = bpe.Codec(bpe.read_ranks(P.path(name)), P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(5)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    texts += ["".join(r.choice(["a", "th", "er", "中", "é", "xyz"]) for _ in range(2000)) for _ in range(20)]
    texts += ["a" * 9000, "ab" * 3000, "!" * 2000 + "?" * 900, " " * 3000, "\n" * 500 + "x", "", " ", " a"]
    for text, ids in zip(texts, codec.encode_all(texts)):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == own.encode_ordinary(text), text[:60]
        assert codec.decode(ids) == text.encode()


def test_joining_halves_is_encoding_the_whole():
    codec = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    r = random.Random(6)
    for _ in range(300):
        data = bytes(r.choice(b"aethinrs") for _ in range(r.randint(2, 60)))
        cut = r.randrange(1, len(data))
        assert codec.join(codec._heap(data[:cut]), codec._heap(data[cut:])) == codec._leaf(data) == codec._heap(data)


def test_codec_rows(spark, rows):
    path = P.path("byte_bpe_50k.tiktoken")
    made = bpe.encoded(cases.frame(spark, rows, extra=True), path, P.PATTERN)
    back = bpe.decoded(made, path, P.PATTERN).collect()
    assert cases.sort(map(tuple, back)) == cases.sort((d, t or "") for d, t in rows)
    assert bpe.digests(spark.createDataFrame([], EMPTY), path, P.PATTERN).collect() == []
