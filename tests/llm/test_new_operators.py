"""Token files, source divergence and hard negatives against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import divergence, negatives, queries, token_files
from tests.conftest import SMALL
from tests.llm.cases import corpus, frame

ODD = ["a\x85b c\x1cd", "é ́x", "Straße ẞ İstanbul", "<|endoftext|> x<|startoftext|>y", "don't we'll I'M 's", "   z",
       "x" * 5000, "漢字かな交じり文", "12 345 6.7", "😀😀 👩‍👩‍👧", " \t\r\n\x0b\x0c "]


def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    made = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda texts: [e.ids for e in made.encode_batch(texts, add_special_tokens=False)]


def plain_files(rows):
    start, out = 0, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (doc, _), ids in zip(order, library()([t or "" for _, t in order])):
        ids = [*ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def filed(spark, docs, **more):
    root = token_files.new_folder(spark)
    token_files.written_files(docs, queries.token_encoder, end=1, vocabulary=more.pop("vocabulary", 49408), root=root, **more)
    return root


def test_token_files_equal_the_library(spark):
    texts = [t for d, t in corpus(3, 40) if d is not None] + ODD + ["word " * 300_000 + "end", None]
    rows = [(i * 7 - 20, t) for i, t in enumerate(texts)] + [(None, "no id")]
    root = filed(spark, frame(spark, rows, extra=True), part_text=1 << 14)
    got = token_files.read_back(spark, root, with_ids=True).collect()
    assert sorted([tuple(r)[:4] for r in got], key=lambda r: r[1]) == plain_files(rows)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert spark.read.parquet(f"{root}/manifest").filter("n_docs > 0").count() > 1


def test_token_files_wide_ids_repeats_and_nothing(spark):
    rows = [(5, "b"), (5, "a a"), (5, "b"), (None, None), (None, ""), (1, "last")]
    narrow, wide = (token_files.read_back(spark, filed(spark, frame(spark, rows), vocabulary=v)).collect() for v in (1 << 16, 1 << 17))
    assert sorted(narrow, key=lambda r: r.start) == sorted(wide, key=lambda r: r.start) and len(narrow) == 6
    ends = sorted((r.start, r.start + r.n_tokens) for r in narrow)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert [r.doc_id for r in sorted(narrow, key=lambda r: r.start)] == [None, None, 1, 5, 5, 5]
    root = filed(spark, frame(spark, []))
    assert token_files.read_back(spark, root).collect() == []


def encoded(encode, texts):
    raw = [t.encode() for t in texts]
    ids, sizes = encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


QUOTES = ["don't", "'s", "it''s", "'", "''", "x'", "'re've'll", "'rex", "i'l", "'tis 'twas", "a'S!", "!'s", "9's'9", "o'clock' s", "'ll'", "d'", "'d",
          "rock'n'roll'm", "'v", "'r", "s", "t", "", "re", "'x's", "é's don't", "l\x01'été x\x01y", "ÀÞßÿ×÷ É's é×3 Ð'S \u00d7\u00f7' ª²\u00a0x Ÿ", "H\u0331 h\u0331 A\u030a"]


def test_piece_encoder_equals_the_library(monkeypatch):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [t or "" for _, t in corpus(1, 30)] + ODD + QUOTES + ["".join(random.Random(i).choice("ab'st  9!.éÉ×’\n<|lre") for _ in range(60)) for i in range(300)]
    for known, step in ((20, 3), (1 << 18, 1000)):
        monkeypatch.setattr(token_files, "KNOWN", known)
        encode, plain = token_files.piece_encoder.__wrapped__(path), token_files.library_encoder(path)
        for at in range(0, len(texts), step):
            some = texts[at:at + step]
            assert encoded(encode, some) == encoded(plain, some) == library()(some)


def test_op11_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_token_files(spark, SMALL).collect()
    assert sorted([tuple(r) for r in got], key=lambda r: r[1]) == plain_files(rows)


def plain_report(rows, min_docs=3, ranks=200):
    import re
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        groups[lang].add(source)
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(own):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 1) // (total + len(kept)) for t in kept}
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {"pair": [(sum((p[s][t] - p[o][t])**2 // p[o][t] for t in kept), o) for o in sources if o != s],
                     "term": [((p[s][t] - q[t])**2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < ranks]
    return sorted(out)


def test_divergence_equals_plain_version(spark):
    r = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Größe", "漢字", "O"]
    rows = [(r.choice(["en", "de", None, "x"]), r.choice(["a", "b", "c", None, "é"]),
             " ".join(r.choice(words[:r.randint(2, 63)]) for _ in range(r.randint(0, 30)))) for _ in range(150)]
    rows += [rows[0]] * 9 + [("en", s, rows[0][2]) for s in "abc"] + [("en", "silent", None), ("one", "only", "a b c"), ("none", "p", ""),
             ("none", "q", "!! 12")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns(
        {"term": F.lit(1), "n": F.lit("x"), "same": F.lit(0), "doc_id": F.lit(None).cast("long")})
    assert sorted(tuple(x) for x in divergence.report(docs, term_ranks=7).collect()) == plain_report(rows, ranks=7)
    assert divergence.report(docs.limit(0)).collect() == []


def test_divergence_reads_long_texts_in_pieces():
    text = ("Wort größe X1y " * 100_000 + "z" * (3 << 20)).encode()
    got = divergence.terms_of(text)
    assert got == Counter(divergence.TERM.findall(text.lower())) and got["größe".encode()] == 100_000


def test_divergence_flushes_what_it_gathers(spark, monkeypatch):
    rows = [("en", f"s{i % 4}", f"aa bb {'c' * (i % 5 + 1)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    want = plain_report(rows)
    monkeypatch.setattr(divergence, "GATHERED", 3)
    assert sorted(tuple(x) for x in divergence.report(docs).collect()) == want


def plain_negatives(rows, every=10):
    """Exact, in Python's integers."""
    import math
    kept = [(k, i, n, [math.floor(256 * x) for x in v]) for k, (i, n, v) in enumerate(rows)
            if n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    def id_order(i):
        return (i is None, i or 0)
    out = []
    for k, i, n, v in kept:
        if i is None or i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), id_order(j), j, m == n) for h, j, m, w in kept if h != k),
                        key=lambda x: x[:2])
        for s, _, p, _ in [x for x in scored if x[3]][:5]:
            hard = [x for x in scored if not x[3] and 80 * -s <= -100 * x[0] <= 100 * -s][:5]
            out += [(i, p, rank + 1, x[2], -s, -x[0]) for rank, x in enumerate(hard)]
    return sorted(out, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns(
        {"row": F.lit("x"), "score": F.lit(1), "tree": F.lit(2), "block": F.lit(3), "vector": F.lit("v")})


@pytest.mark.parametrize("tree,block", [(1024, 8192), (3, 16)])
def test_hard_negatives_equal_brute_force(spark, tree, block):
    r = random.Random(5)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(3)]
    rows = [(i, r.randrange(3), [c + r.gauss(0, 0.4) for c in centres[r.randrange(3)]]) for i in range(160)]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(30)] + [(2000 + i, 2, rows[0][2]) for i in range(12)]
    rows += [(10, 1, rows[10][2]), (20, None, rows[3][2]), (30, 1, None), (40, 1, [1.0, None, 2.0]), (50, 2, [float("nan")] * 8),
             (60, 0, [float("inf")] + [0.0] * 7), (70, 0, [0.0] * 8), (80, 1, [1.5, -2.5]), (90, 2, []), (None, 1, rows[0][2]),
             (3000, 77, rows[5][2])]
    got = negatives.mined(vectors(spark, rows), F.col("vec_id") % 10 == 0, tree=tree, block=block)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == plain_negatives(rows)


def test_hard_negatives_of_large_components(spark):
    r = random.Random(6)
    rows = [(i, i % 2, [r.gauss(0, 1) * 2.0**22, r.gauss(0, 1) * 2.0**20 + 2.0**21]) for i in range(60)]
    got = negatives.mined(vectors(spark, rows), F.col("vec_id") % 10 == 0, tree=4, block=8)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == plain_negatives(rows)
    huge = negatives.mined(vectors(spark, [(i, i % 2, [1e300 * (i + 1), 1.0]) for i in range(20)]), F.col("vec_id") % 10 == 0)
    assert all(x.negative_score == negatives.MOST for x in huge.collect())


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(1, 1, [1.0])], [(100, 1, [1.0])], [(100, 1, [1.0]), (101, 1, [2.0])]):
        assert negatives.mined(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect() == []


def test_bounds_leave_far_rows_unscored():
    """Anchors close to each other score again only the rows whose bounds reach their windows."""
    rng = np.random.default_rng(1)
    tree = np.floor(256 * (np.ones(16) / 4 + rng.normal(0, 0.002, (20, 16))))
    order, parent, edge = negatives.spanning_tree(tree)
    assert parent[order[0]] == -1 and sorted(order.tolist()) == list(range(20))
    whole = np.linalg.norm(tree[:, None] - tree[None], axis=2)
    assert all(edge[i] == pytest.approx(whole[i, parent[i]]) for i in range(1, 20))
    x = np.floor(256 * rng.normal(0, 0.25, (2000, 16)))
    norms = np.linalg.norm(x, axis=1)
    gap = np.abs(x @ tree[1] - x @ tree[parent[1]])
    assert (gap <= edge[1] * norms).all() and (np.abs(x @ tree[0] - 40000) <= edge[1] * norms).mean() < 0.1
