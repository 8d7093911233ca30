"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from kinfold.oracle import ORACLE
from kinfold.queries import QUERIES

from conftest import SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
#: Queries whose parts no other test here covers; the full set is compared by the verification run.
CHECKED = ["landing_metrics", "typed_location", "block_fields", "extract_patterns", "contributions", "batch_metrics",
           "profile_fold", "resolve_components", "export_keyset", "child_rows", "wide_professional", "upsert_target_wins",
           "pipeline_stats", "kind_frequency", "field_frequency", "consumer_lag", "progress_snapshots", "stream_landing", "wide_type_change", "extract_addresses", "persons_text_times",
           "first_hundred_fields", "hub_identifiers"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def _rows(columns, rows):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    cursor = duck.execute(ORACLE[name])
    names, want = [d[0] for d in cursor.description], cursor.fetchall()
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, want)
