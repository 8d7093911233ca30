"""Nothing that grows with the input goes through the driver: no join of such tables is left to Spark's choice."""

import re

import pytest

from kinfold.operators import components, refine
from kinfold.operators.fold import exact_profiles
from kinfold.plans.extract import contribute
from kinfold.session import written
from kinfold.sources.envelope import messages
from kinfold.streaming import profiles

from helpers import contributed, envelopes
from test_upkeep import BATCHES


def left_to_spark(df):
    """Joins of a plan without a strategy; those told to broadcast have at most as many rows as there can be hot keys."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"\bJoin .*", plan)
    return [j for j in joins if "strategy=" not in j], len(joins)


@pytest.fixture
def seen(monkeypatch):
    """What each intermediate table had of such joins."""
    found = []

    def noting(df, name):
        found.append((name, *left_to_spark(df)))
        return written(df, name)
    for module in (components, profiles, refine):
        monkeypatch.setattr(module, "written", noting)
    return found


def test_merged_groups_are_not_broadcast(spark, seen):
    groups = written(exact_profiles(contributed(spark, [{"passport": p, "email": "a@x.es"} for p in ("P1", "P2", "P3")])), "groups")
    mapping = written(spark.createDataFrame([("passport::p1", "passport::p2"), ("passport::p2", "passport::p3")], "source_key string, target_key string"), "mapping")
    merged = refine.merge_groups(groups, mapping)
    assert [r["grouping_key"] for r in merged.collect()] == ["passport::p3"]
    seen.append(("merged", *left_to_spark(merged)))
    assert [x for x in seen if x[1]] == [] and sum(n for *_, n in seen) > 8


def test_store_batches_are_not_broadcast(spark, tmp_path, seen):
    store = profiles.ProfileStore(spark, str(tmp_path))
    for i, bodies in enumerate(BATCHES[:2]):
        store.merge_batch(contribute(messages(envelopes(spark, bodies, topic=f"t{i}"))), i, "s")
    assert {"touched", "labelled", "moved"} <= {x[0] for x in seen}
    assert [x for x in seen if x[1]] == [] and sum(n for *_, n in seen) > 8
