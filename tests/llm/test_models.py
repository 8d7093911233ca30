"""Fingerprints, scores, neighbours, the classifier and the pipeline against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import ann, quality, spotsigs, suffix_tree
from kinfold.llm import queries as Q

from llm import cases

EMPTY = "doc_id long, text string"


def _spots(text):
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        else:
            words += [word] if word else []
            word = ""
    places = [i for i, w in enumerate(words) if w not in spotsigs.ANCHORS]

    def chain(k):
        return tuple(words[p] for p in places[k:k + spotsigs.CHAIN])
    found = {(words[i], chain(k)) for k, p in enumerate(places) for i in range(places[k - 1] + 1 if k else 0, p)}
    return found or {("", chain(k)) for k in range(len(places))}


def _alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BLOCK", 7)
    r = random.Random(1)
    words = [f"word{i}" for i in range(60)] + spotsigs.ANCHORS[:20] * 2
    rows = [(i * 3 - 20, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(40)]
    rows += [(500, None), (501, "the of"), (502, "The Straße, the 文字!"), (503, ""), (None, "the last one")]
    got = spotsigs.edited(cases.frame(spark, rows, extra=True)).collect()
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    want = {}
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        other = t[:len(t) - cut] + n[:cut]
        want[d] = (len(t), hashlib.sha256(other.encode()).hexdigest(), _alike(_spots(t), _spots(other)),
                   _alike(_spots(t), _spots(n)))
    assert len(got) == len(rows)
    for x in got:
        assert (x.n_chars, x.edited_sha256) == want[x.doc_id][:2]
        assert x.near_edited == pytest.approx(want[x.doc_id][2]) and x.near_next == pytest.approx(want[x.doc_id][3])
    assert spotsigs.edited(spark.createDataFrame([], EMPTY)).collect() == []


def test_fingerprints_of_repeated_rows(spark):
    got = spotsigs.edited(cases.frame(spark, [(1, "the same old text of mine"), (1, "the same old text of mine")])).collect()
    assert {(x.near_edited, x.near_next) for x in got} == {(got[0].near_edited, 1.0)} and len({x.fingerprint for x in got}) == 1


def test_near_fingerprints(spark):
    rows = [x for x in cases.corpus(3) if x[0] is not None]
    members, pairs = spotsigs.near_pairs(cases.frame(spark, rows), 0.6)
    sets = {d: _spots(t or "") for d, t in rows if (d, t) != (3, None)}
    of = {x.doc_id: x.class_id for x in members.collect()}
    assert all(_alike(sets[d], sets[c]) == 1.0 for d, c in of.items())
    reps = sorted(set(of.values()))
    want = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1:] if sets[a] and sets[b] and _alike(sets[a], sets[b]) >= 0.6}
    assert {tuple(sorted((x.a, x.b))) for x in pairs.collect()} == want


def test_common_signatures_bring_no_pairs_together(spark, monkeypatch):
    """A hundred texts share half of their chains, two of them nearly all: only what is rare is in the heads that meet."""
    shared = " ".join(f"the common{i} thing{i}" for i in range(20))
    rows = [(i, shared + " " + " ".join(f"the own{i}x{j} word{i}y{j}" for j in range(20))) for i in range(100)]
    rows.append((500, rows[7][1] + " the one more"))
    heads, made = [], spotsigs.written
    monkeypatch.setattr(spotsigs, "written", lambda df, name: (heads.append(df) if name == "heads" else None, made(df, name))[1])
    _, pairs = spotsigs.near_pairs(cases.frame(spark, rows), 0.8)
    assert [(x.a, x.b) for x in pairs.collect()] in ([(7, 500)], [(500, 7)])
    assert heads[0].groupBy("spot").count().agg(F.max("count")).first()[0] <= 2


def _tokens(text):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return (text or "").encode().translate(lower).split() + [None]


def test_scores(spark):
    rows = cases.corpus(4, 200)
    got = suffix_tree.scored(cases.frame(spark, rows, extra=True)).collect()
    counts = Counter(x for d, t in rows if not suffix_tree.held_out(d) for x in _tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for d, t in rows:
        w = _tokens(t)
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        want[d, suffix_tree.held_out(d), len(w), sum(counts[x] > 0 for x in w), total, round(base, 6)] += 1
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    assert sum(x.score for x in got) > sum(x.base_score for x in got)
    assert suffix_tree.held_out(None) is False and suffix_tree.held_out(1) == (zlib.crc32(b"1") % 10 == 0)
    assert suffix_tree.scored(spark.createDataFrame([], EMPTY)).collect() == []


def test_contexts_are_distributions(spark):
    """The words after any context, unknown ones as one, have probabilities that add up to one."""
    r = random.Random(2)
    rows = [(i, " ".join(["a b c d" if r.random() < 0.5 else r.choice("abcdef") for _ in range(30)])) for i in range(80)]
    docs = cases.frame(spark, rows)
    tree = suffix_tree.learned(docs, suffix_tree.words(docs).cache())
    assert len(tree.parent) > 3
    words = [*"abcdef", None, "unknown"]
    for context in ("", "a", "a b", "a b c", "f", "zz a b", "b zz"):
        before = context.split()
        total = 0.0
        for w in words:
            texts = [(" ".join(before + ([w] if w else []))).encode()]
            data = np.frombuffer(texts[0], np.uint8)
            hashes, _, number = suffix_tree.tokens(data, np.array([0, len(data)]))
            word, score, _ = suffix_tree.in_place(tree, hashes, number)
            at = len(before)
            total += 10 ** (score[at] + (0 if word[at] >= 0 else math.log10(tree.root(np.zeros(1))[0])))
        assert total == pytest.approx(1.0, abs=1e-9), context


def test_neighbours(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 24)) * r.uniform(0.5, 1.5, (400, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[7].tolist()) for i in range(60)]
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] + [1.0] * 23),
             (2080, [1.0]), (None, x[3].tolist()), (40, x[40].tolist())]
    docs = spark.createDataFrame([(*v, 1) for v in rows], "vec_id long, embedding array<double>, axes int")
    got = ann.nearest(docs, F.col("vec_id") % 20 == 0).collect()
    live = {i: np.array(v) for i, v in rows if i is not None and i < 2000}
    ids = np.array(sorted(live))
    matrix = np.stack([live[i] for i in ids])
    hits = total = 0
    for q in ids[ids % 20 == 0].tolist():
        score = np.einsum("d,vd->v", live[q], matrix)
        found = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert found == [(i + 1, *f[1:]) for i, f in enumerate(sorted(found, key=lambda f: (-f[2], f[1])))]
        assert all(f[2] == pytest.approx(score[np.searchsorted(ids, f[1])], abs=1e-12) for f in found)
        order = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != q][:20]
        hits, total = hits + len({f[1] for f in found} & set(ids[order].tolist())), total + 20
    assert hits >= 0.9 * total
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(g) for g in ann.nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.5)]
    assert ann.nearest(few.limit(0), F.lit(True)).collect() == []


def _labelled(seed, n=600):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(20, 80))]
        kind = i % 8
        if kind == 0:
            t = [w + r.choice(["%%%", "***", "$$$"]) for w in t]
        elif kind == 1:
            t = [w.upper() for w in t]
        elif kind == 2:
            for _ in range(4):
                t[r.randrange(len(t))] = r.choice(["zzvile", "zzfoul", "idiot"])
        elif kind == 3:
            t = [w for w in t[:8] for _ in range(5)]
        rows.append((i, " ".join(t)))
        if r.random() < 0.5:
            labels.append((i, kind < 4))
    return rows, labels


def test_quality(spark):
    rows, labels = _labelled(1)
    extra = [(None, ""), (900, None), (901, "short text"), (0, rows[0][1])]
    known = spark.createDataFrame(labels + [(None, True), (5, None)], "doc_id long, bad boolean")
    got = quality.scored(cases.frame(spark, rows + extra, extra=True), known)
    assert got.columns == ["doc_id", "text", "key", "n_words", "found", "kept", "score", "rejected"]
    got = got.collect()
    seen = {d for d, _ in labels}
    unseen = [x for x in got if x.doc_id is not None and x.doc_id < 600 and x.doc_id not in seen]
    right = sum(x.rejected == (x.doc_id % 8 < 4) for x in unseen)
    assert right >= 0.97 * len(unseen)
    assert not any(x.rejected for x in got if x.doc_id in (None, 900, 901))
    none = quality.scored(cases.frame(spark, rows)).collect()
    assert sum(x.rejected == (x.doc_id % 8 in (0, 1, 3)) for x in none if x.doc_id % 8 != 2) >= 0.9 * 525
    assert quality.scored(spark.createDataFrame([], EMPTY), known).collect() == []


def test_em_tells_good_labellers_from_bad():
    r = np.random.default_rng(8)
    truth = r.random(4000) < 0.3
    votes = np.stack([np.where(r.random(4000) < a, np.where(truth, 1, -1), np.where(truth, -1, 1))
                      for a in (0.95, 0.85, 0.8, 0.55)], axis=1)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    bad, accuracy = quality.posteriors(patterns, counts.astype(float))
    assert ((bad[at.ravel()] > 0.5) == truth).mean() > 0.93
    assert np.allclose(accuracy, (0.95, 0.85, 0.8, 0.55), atol=0.05)


def test_em_equals_one_document_at_a_time():
    r = np.random.default_rng(3)
    votes = r.choice([-1, 0, 1], (300, 4), p=[0.3, 0.4, 0.3])
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    bad, accuracy = quality.posteriors(patterns, counts.astype(float))
    own = [0.9] * 4
    for _ in range(60):
        chance = []
        for vote in votes.tolist():
            yes, no = 1.0, 1.0
            for v, a in zip(vote, own):
                if v:
                    yes, no = (yes * a, no * (1 - a)) if v > 0 else (yes * (1 - a), no * a)
            chance.append(yes / (yes + no))
        for j in range(4):
            cast = [(c if vote[j] > 0 else 1 - c) for c, vote in zip(chance, votes.tolist()) if vote[j]]
            own[j] = min(0.999, max(0.01, (sum(cast) + 18) / (len(cast) + 20)))
    assert np.allclose(accuracy, own) and np.allclose(bad[at.ravel()], chance)


def _plain_fit(rows, target, epochs, rate=0.3, l1=3.0, l2=1.0, support=5):
    """The same learner with a dictionary for each feature's sums."""
    held = Counter(x for xs in rows for x in xs)
    z, n = Counter(), Counter()

    def weight(x):
        return 0.0 if abs(z[x]) <= l1 else -(z[x] - math.copysign(l1, z[x])) / ((0.1 + math.sqrt(n[x])) / rate + l2)
    pick = np.random.default_rng(7)
    for _ in range(epochs):
        for i in pick.permutation(len(rows)):
            own = [*[x for x in rows[i] if held[x] >= support], None]
            before = {x: weight(x) for x in own}
            g = 1 / (1 + math.exp(-sum(before.values()))) - target[i]
            for x in own:
                z[x] += g - (math.sqrt(n[x] + g * g) - math.sqrt(n[x])) / rate * before[x]
                n[x] += g * g
    return {x: weight(x) for x in [*held, None]}


def test_scorer_equals_plain_learner():
    r = random.Random(5)
    rows = [sorted(r.sample(range(40), r.randint(0, 8))) for _ in range(200)]
    target = np.array([0.9 if 3 in x or 7 in x else 0.1 for x in rows])
    weights, bias = quality.fitted(np.array([x for xs in rows for x in xs]), np.cumsum([0, *map(len, rows)]), target, steps=1000)
    want = _plain_fit(rows, target, 5)
    assert bias == pytest.approx(want.pop(None)) and all(weights[x] == pytest.approx(w) for x, w in want.items())
    assert weights[3] > 0 and not weights[40:].any()


def test_whole_classifier_equals_plain_version(spark):
    """Votes, posteriors, fit and scores of a small table, step by step on plain lists."""
    rows, labels = _labelled(6, 240)
    got = {x.doc_id: x.score for x in quality.scored(cases.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, bad boolean")).collect()}
    data = {d: quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for d, t in rows}
    label, bads, goods = dict(labels), Counter(), Counter()
    for d, bad in labels:
        (bads if bad else goods).update(set(data[d].feature.tolist()))
    n_bad, n_good = sum(label.values()), len(label) - sum(label.values())
    cues = np.array(sorted(w for w, n in bads.items() if n >= quality.CUE_TEXTS
                           and (n / n_bad) / ((goods[w] + 0.5) / (n_good + 1)) >= quality.CUE_ODDS), np.uint64)
    votes = {d: quality.votes(f, 1, cues)[0].tolist() for d, f in data.items()}
    for d, bad in labels:
        votes[d][-1] = 1 if bad else -1
    table = np.array([votes[d] for d, _ in rows])
    bad, _ = quality.posteriors(table, np.ones(len(table)))
    taught = [(d, b) for (d, _), b in sorted(zip(rows, bad)) if any(votes[d])]
    features = {d: quality.hashed(f, 1, cues)[1].tolist() for d, f in data.items()}
    want = _plain_fit([features[d] for d, _ in taught], [b for _, b in taught], max(4, -(-60_000 // len(taught))))
    for d, _ in rows:
        score = 1 / (1 + math.exp(-sum(want.get(x, 0.0) for x in features[d]) - want[None]))
        assert got[d] == pytest.approx(score, rel=1e-6, abs=1e-9)


def test_pipeline_of_nothing_and_of_clashing_columns(spark, tmp_path):
    import corpus_pipeline
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
    docs = cases.frame(spark, cases.corpus(6, 20), extra=True).withColumns({"__row": F.lit("r"), "class_id": F.lit(1), "place": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns and 0 < made.count() <= docs.count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    rows, labels = _labelled(3, 300)
    shared = [(1000 + d if d is not None and d < 500 else d, t) for d, t in cases.corpus(5)]
    first, second = (" ".join(f"{k}{j}" for j in range(40)) for k in "pq")
    shared += [(2003, first), (2005, first), (2005, second), (None, first + " more"), (None, "only here " * 30)]
    all_rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows + shared]
    docs = spark.createDataFrame(all_rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(d, 0 if b else 1, 0) for d, b in labels]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    made = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        made.append(docs.collect())
    quality_kept, lined, single, cut, packed = made
    judged = {(x.doc_id, x.text): x.rejected for x in quality.scored(
        spark.read.parquet(f"{tmp_path}/documents.parquet"), Q.labels_of(spark, str(tmp_path))).collect()}
    kept = [(d, t) for d, t, *_ in all_rows if not judged[d, t]]
    assert cases.sort((x.doc_id, x.text) for x in quality_kept) == cases.sort(kept)
    assert cases.sort((x.doc_id, x.text) for x in lined) == cases.sort((d, t) for d, t, *_ in cases.without_lines(kept))
    before = [(x.doc_id, x.text) for x in lined]
    classes = cases.near_classes(list(enumerate(t for _, t in before)))
    least = {}
    for d, t in sorted(before, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())):
        least.setdefault(classes[t or ""], (d, t))
    assert cases.sort((x.doc_id, x.text) for x in single) == cases.sort(least.values())
    ids = [x.doc_id for x in single]
    assert 2003 in ids and ids.count(2005) == 1  # of the two texts of 2005 the one that is no copy
    assert cases.sort((x.doc_id, x.text) for x in cut) == cases.sort(
        (d, t) for d, t, *_ in cases.without_passages([(x.doc_id, x.text) for x in single]))
    assert all(x.n_chars == len(x.text) for x in cut)
    assert Counter(x.doc_id for x in packed if x.start == 0) == Counter(x.doc_id for x in cut)
