"""Results over whole tables where bounded samples, shares or buckets once stood in for them."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import ann, suffix_tree

from llm import cases


def _plain_scores(rows, depth=3):
    """Scores by recursion over plain counts of words and contexts."""
    s = suffix_tree
    texts = [(d, t, (t or "").lower().split() + [None]) for d, t in rows]
    train = [w for d, _, w in texts if not s.held_out(d)]
    count = Counter(x for w in train for x in w)
    total, distinct = sum(count.values()), len(count)
    seen, occurs = {}, Counter()
    for w in train:
        for i, x in enumerate(w):
            for d in range(1, min(depth, i) + 1):
                seen.setdefault(tuple(w[i - d:i]), Counter())[x] += 1
    for c, n in seen.items():
        occurs[c] = sum(n.values())
    state = {}

    def chance(c, x):
        while c and c not in state:
            c = c[1:]
        if not c:
            return (count[x] + s.PSEUDO) / (total + s.PSEUDO * (distinct + 1))
        own, rest = state[c]
        return (own[x] - s.DISCOUNT if x in own else 0) / occurs[c] + rest * chance(c[1:], x)
    for c in sorted((c for c in seen if occurs[c] >= s.CONTEXT_COUNT), key=len):
        own = {x: n for x, n in seen[c].items() if n >= s.SYMBOL_COUNT}
        if not own:
            continue
        above = {x: chance(c[1:], x) for x in own}
        bits = sum(n / occurs[c] * math.log2(n / occurs[c] / above[x]) for x, n in own.items())
        other = 1 - sum(own.values()) / occurs[c]
        bits += other * math.log2(other / max(1e-12, 1 - sum(above.values()))) if other > 1e-12 else 0
        if bits - len(own) / (2 * math.log(2) * occurs[c]) >= s.DIVERGENCE:
            state[c] = own, 1 - sum(n - s.DISCOUNT for n in own.values()) / occurs[c]
    return Counter((d, len(w), round(sum(math.log10(chance(tuple(w[max(0, i - depth):i]), x)) for i, x in enumerate(w)), 6))
                   for d, _, w in texts), state


@pytest.mark.parametrize("share", [suffix_tree.HELD_SHARE, 0.01])
def test_scores_are_those_of_plain_counts(spark, monkeypatch, share):
    """Whatever part of the model is broadcast, all of it counts."""
    monkeypatch.setattr(suffix_tree, "HELD_SHARE", share)
    r = random.Random(6)
    rows = [(d, t and t.replace("ß", "s").replace("Ü", "u")) for d, t in cases.corpus(4, 200)]
    rows += [(5000 + i, " ".join(r.choice(["a b c d", "a c", r.choice("abcdef")]) for _ in range(30))) for i in range(60)]
    want, state = _plain_scores(rows)
    assert {len(c) for c in state} == {1, 2, 3}
    got = suffix_tree.scored(cases.frame(spark, rows)).collect()
    assert Counter((x.doc_id, x.n_tokens, round(x.score, 6)) for x in got) == want


def test_rare_contexts_are_kept_in_a_large_corpus(spark):
    """A phrase of 30 occurrences among two million tokens, a share of 1.5e-5, is learned."""
    r = random.Random(7)
    filler = [f"f{i}" for i in range(50)]
    rows = [(None, " ".join(r.choices(filler, k=25_000))) for _ in range(80)]
    rows += [(None, "rare phrase here")] * 30
    rows += [(next(i for i in range(100) if suffix_tree.held_out(i)), "rare phrase here")]
    got = [x for x in suffix_tree.scored(cases.frame(spark, rows)).collect() if x.held_out]
    # "phrase", "here" and the end follow with certainty; only "rare" is as unlikely as at the root
    assert got[0].score > got[0].base_score + 10


def _neighbours_met(spark, x):
    """Share of the true neighbours that are found; every query has as many rows as there can be."""
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for g in ann.nearest(rows, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(g.query_id, []).append((g.rank, g.vec_id))
    score, hits, total = x @ x.T, 0, min(20, len(x) - 1)
    for q in range(0, len(x), 20):
        want = [i for i in np.argsort(-score[q], kind="stable") if i != q][:total]
        found = sorted(got[q])
        assert [r for r, _ in found] == list(range(1, total + 1))
        hits += len({i for _, i in found} & set(want))
    return hits / total / len(range(0, len(x), 20))


@pytest.mark.parametrize("norms", ["outlier", "mixed"])
def test_neighbours_of_vectors_of_any_norm(spark, norms):
    r = np.random.default_rng(9)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "outlier":
        x[1] *= 20
    else:
        x *= r.lognormal(0, 1, (len(x), 1))
    assert _neighbours_met(spark, x) >= 0.95


def test_few_vectors_are_all_neighbours(spark):
    r = np.random.default_rng(10)
    for n in (1 + 1, 15, 41):
        assert _neighbours_met(spark, r.normal(size=(n, 64))) == 1.0


def test_queries_whose_buckets_hold_too_few_rows_are_scanned(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 8)
    assert _neighbours_met(spark, np.random.default_rng(10).normal(size=(41, 64))) >= 0.6
