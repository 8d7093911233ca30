"""What a model of n-grams and the scores by it leave on disk."""

import contextlib
import threading
from pathlib import Path

import numpy as np

from kinfold.llm import suffix_tree
from kinfold.llm.text import documents
from kinfold.session import scratch_dir

from llm import cases


def _most_on_disk(spark, run):
    """The result of ``run``, and the bytes of shuffle files and of the tables it wrote when there were most."""
    dirs = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), scratch_dir(spark)]

    def size():
        total = 0
        for d in dirs:
            for f in (*Path(d).glob("*/shuffle_*.data"), *Path(d).glob("*/*.parquet")):
                with contextlib.suppress(OSError):
                    total += f.stat().st_size
        return total
    before, most, over = size(), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            most.append(size())
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        return run(), max(most) - before
    finally:
        over.set()
        watcher.join()


def test_disk_by_tokens(spark, monkeypatch):
    """Nothing is broadcast, few n-grams are held by the tasks: still a few bytes of disk a token, at any moment."""
    monkeypatch.setattr(suffix_tree, "HELD_SHARE", 1e-3)
    monkeypatch.setattr(suffix_tree, "ASKED", 1 << 16, raising=False)
    docs = documents(spark, "/root/testdata/sf0.01")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, most = _most_on_disk(spark, lambda: suffix_tree.scored(docs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    tokens = sum(x.n_tokens for x in got)
    assert len(got) == docs.count() and sum(x.score - x.base_score for x in got if not x.held_out) > 0
    assert most / tokens < 18


def test_packed_runs_are_what_was_packed():
    r = np.random.default_rng(3)
    for n in (0, 1, 7, 5000):
        keys = np.sort(r.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (suffix_tree._unpacked_sorted(suffix_tree._packed_sorted(keys)) == keys).all()
        values = r.normal(size=n)
        assert (suffix_tree._unpacked(suffix_tree._packed(values), np.float64) == values).all()
        cuts = suffix_tree._cuts(keys, 7)
        assert [x for a, b in zip(cuts, cuts[1:]) for x in keys[a:b]] == keys.tolist()
        assert all(len({int(k) * 7 >> 64 for k in keys[a:b]}) <= 1 for a, b in zip(cuts, cuts[1:]))
        wanted = np.r_[keys, keys + np.uint64(1), r.integers(0, 1 << 64, 100, dtype=np.uint64)]
        assert (suffix_tree.Places(np.unique(keys)).found(wanted) == suffix_tree.found_in(np.unique(keys), wanted)).all()
    sizes = np.array([0, 3, 0, 5, 1, 0])
    at = r.integers(0, 1000, 9)
    got = suffix_tree._rising(suffix_tree._packed_rising(at, np.repeat(np.arange(6), sizes)), sizes)
    assert got.tolist() == sorted(at[:3].tolist()) + sorted(at[3:8].tolist()) + at[8:].tolist()


def test_rounds_do_not_change_scores(spark, monkeypatch):
    """Texts scored in four rounds of one n-gram a question, or all at once: each row once, repeated and null ones too."""
    monkeypatch.setattr(suffix_tree, "HELD_SHARE", 0.01)
    rows = cases.corpus(4, 120)
    rows += rows[:5]

    def scores():
        return sorted(((x.doc_id is None, x.doc_id, x.n_tokens, x.n_known, round(x.score, 6), round(x.base_score, 6))
                       for x in suffix_tree.scored(cases.frame(spark, rows)).collect()), key=repr)
    once = scores()
    monkeypatch.setattr(suffix_tree, "ASKED", 1)
    assert len(once) == len(rows) and scores() == once
