"""Texts longer than the piece of text that the operators take at a time, among short ones."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from kinfold.llm import bpe, lines, minhash, packing, quality, sharding, spotsigs, substrings, suffix_tree, text
from kinfold.llm import queries as Q

from llm import cases
from llm.test_whole import _plain_scores

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    words = [f"word{i}" for i in range(5000)]
    long = "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(16_000))
    assert len(long) > text.PIECE_BYTES
    near = long[:-200] + " quite another end"
    shared = long[400_000:401_000]
    return [(1, long), (2, near), (3, "short text"), (4, shared), (5, "before " + shared + " behind"), (6, None), (7, long)]


def test_near_dedup(spark, rows):
    got = {r.doc_id: r.class_id for r in minhash.classes(cases.frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 7: 1, 3: 3, 4: 4, 5: 5 if got[5] == 5 else 4, 6: 6}
    want = cases.near_classes([r for r in rows if r[0] in (3, 4, 5)])
    assert got[5] == want[rows[4][1]]


def test_passages_and_lines(spark, rows):
    cut = substrings.deduplicated(cases.frame(spark, rows)).select("doc_id", "text", "n_words", "n_removed").collect()
    assert cases.sort(map(tuple, cut)) == cases.sort(cases.without_passages(rows))
    kept = lines.deduplicated(cases.frame(spark, rows)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert cases.sort(map(tuple, kept)) == cases.sort(cases.without_lines(rows))


def test_codec_and_packing(spark, rows):
    import tiktoken
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    got = {r.doc_id: r for r in bpe.digests(cases.frame(spark, rows), ranks, P.PATTERN).collect()}
    for d, t in rows:
        ids = np.array(whole.encode_ordinary(t or ""), "<u4").tobytes()
        assert got[d].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    library = __import__("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    packed = packing.packed(cases.frame(spark, rows), Q.packing_encoder).collect()
    for d, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted((r.start, r.length, r.ids_crc32) for r in packed if r.doc_id == d)
        assert own == [(i, len(ids[i:i + 1024]), zlib.crc32(ids[i:i + 1024].tobytes())) for i in range(0, len(ids), 1024)]


def test_shards_and_fingerprints(spark, rows):
    got = {r.doc_id: r for r in sharding.sharded(cases.frame(spark, rows), shards=3).collect()}
    assert all(got[d].size == len((t or "").encode()) + 16 and got[d].text_crc32 == zlib.crc32((t or "").encode()) for d, t in rows)
    assert got[1].shard == got[7].shard != got[2].shard
    marks = {r.doc_id: r for r in spotsigs.edited(cases.frame(spark, rows)).collect()}
    assert marks[1].fingerprint == marks[7].fingerprint and all(marks[d].n_chars == len(t or "") for d, t in rows)
    following = {d: rows[i - 1][1] or "" for i, (d, _) in enumerate(rows) if i}  # the next is that of the id below
    for d, t in rows[1:]:
        cut = len(t or "") // 3
        edited = (t or "")[:len(t or "") - cut] + following[d][:cut]
        assert marks[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_scores_and_quality(spark, rows):
    want, _ = _plain_scores(rows)
    got = suffix_tree.scored(cases.frame(spark, rows)).collect()
    plain = {(d, n): s for d, n, s in want}
    assert len(got) == len(rows) and all(r.score == pytest.approx(plain[r.doc_id, r.n_tokens], rel=1e-9, abs=1e-5) for r in got)
    judged = {r.doc_id: r.score for r in quality.scored(cases.frame(spark, rows)).collect()}
    assert judged[1] == judged[7] and set(judged) == {d for d, _ in rows}
