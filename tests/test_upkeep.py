"""Reports kept by changes, expiry by days, progress of streams, hub identifiers, the oldest messages."""

import datetime

import pytest
from pyspark.sql import functions as F

from kinfold.operators import hubs
from kinfold.plans import reports as R
from kinfold.plans.extract import contribute, keyed
from kinfold.sources.envelope import file_stream, messages
from kinfold.streaming import landing as SL
from kinfold.streaming.profiles import ProfileStore
from kinfold.streaming.progress import ProgressTable, progress_rows, remaining

from helpers import START, envelopes

BATCHES = [[{"email": "a@acme.com"}, {"passport": "P1", "IBAN": "ES791234567890123"}, {"phone": "5"}, {"q": 1}],
           [{"passport": "P1", "email": "a@acme.com"}, {"phone": "5", "passport": "P2"}, {"passport": "P9", "address": "Main Street"}],
           [{"passport": "P2", "name": "A", "last_name": "B", "sex": "M"}, {"phone": "7"}],
           [{"nothing": True}]]


def test_kind_sets_follow_every_batch(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path))
    assert store.kind_sets().count() == 0
    for i, bodies in enumerate(BATCHES):
        rows = contribute(messages(envelopes(spark, bodies, topic=f"t{i}")))
        for _ in range(2 if i == 1 else 1):  # a batch that runs again
            store.merge_batch(rows, i, "s")
        kept = {tuple(r["kinds"]): r["n"] for r in store.kind_sets().collect()}
        assert kept == {tuple(r["kinds"]): r["n"] for r in R.kind_sets(store.profiles()).collect()}
    report = {(r["report"], r["item"]): r["n"] for r in R.kind_set_reports(store.kind_sets()).collect()}
    profiles = store.profiles()
    assert report["profiles", "all"] == profiles.count() and report["profiles", "complete"] == R.all_kinds_count(profiles).first()["n"]
    whole = R.global_completeness(profiles).first()
    assert (report["completeness", "received"], report["completeness", "needed"]) == (whole["received"], whole["needed"])
    assert {k: n for (r, k), n in report.items() if r == "kind"} == {r["kind"]: r["n"] for r in R.kind_frequency(profiles).collect()}


def test_expiry_deletes_whole_days_only(spark, tmp_path):
    root, day = str(tmp_path), 86400
    rows = envelopes(spark, [{"i": i} for i in range(12)] + ["{broken"]).withColumn(
        "timestamp", F.when(F.col("offset") != 3, F.timestamp_seconds(F.lit(START - START % day) + F.col("offset") * (day // 2))))
    SL.land_batch(rows.filter("offset < 6"), 0, root, "s")
    SL.land_batch(rows, 1, root, "s")
    first = datetime.datetime.fromtimestamp(START - START % day, datetime.UTC).date()
    assert SL.landed(spark, root).count() == 12 and SL.dead(spark, root).count() == 1
    assert SL.expire(spark, root, first) == 0
    assert SL.expire(spark, root, first + datetime.timedelta(days=2)) == 2
    assert sorted(r["offset"] for r in SL.landed(spark, root).collect()) == [3, *range(4, 12)]
    assert SL.expire_behind(spark, root, 1) == 2 and SL.dead(spark, root).count() == 1
    assert sorted(r["offset"] for r in SL.landed(spark, root).collect()) == [3, 8, 9, 10, 11]
    SL.land_batch(rows, 1, root, "s")
    assert SL.landed(spark, root).count() == 12  # what the topic still holds lands again


def test_progress_of_a_stream(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        envelopes(spark, [{"i": i}] * 4, topic=f"t{i}").coalesce(1).write.parquet(f"{source}/{i}")
    progress = ProgressTable(spark, f"{root}/progress")
    spark.streams.addListener(progress)
    try:
        query = SL.landing_query(file_stream(spark, f"{source}/*", 1), root, f"{root}/cp")
        progress.finish(query)
    finally:
        spark.streams.removeListener(progress)
    assert progress.save() == 0
    rows = progress_rows(spark, f"{root}/progress")
    assert sorted((r["batch"], r["rows"]) for r in rows.collect()) == [(0, 4), (1, 4), (2, 4)]
    assert rows.agg(F.sum("rows")).first()[0] == SL.landed(spark, root).count()
    left = remaining(rows, 20).first()
    assert (left["batches"], left["rows"], left["pending"]) == (3, 12, 8) and left["eta_seconds"] == pytest.approx(8 / left["rate"])
    assert remaining(rows).first()["pending"] is None and progress_rows(spark, f"{root}/none").count() == 0
    told = spark.createDataFrame([("q", "r", 0, 5, 2.0, 90), ("q", "r", 1, 5, 3.0, 40)], "query string, run string, batch long, rows long, seconds double, behind long")
    got = remaining(told.withColumn("ts", F.timestamp_seconds("batch"))).first()
    assert (got["pending"], got["rate"], got["eta_seconds"]) == (40, 2.0, 20.0)


def test_hubs_are_counted_exactly_and_none_is_missed(spark):
    tokens = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "email=hub").when(F.col("id") % 100 == 1, "phone=small").otherwise(
        F.concat(F.lit("passport="), "id")).alias("token"))
    parts = [hubs.sketched(tokens.filter(F.pmod(F.hash("token"), F.lit(3)) == i)) for i in range(3)] + [hubs.sketched(tokens.limit(0))]
    whole = hubs.combined(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    got = {r["token"]: (r["n"], r["of"]) for r in hubs.hubs(tokens, whole, 256).collect()}
    small = tokens.filter("token = 'phone=small'").count()
    assert got == {"email=hub": (10_000, 30_000), "phone=small": (small, 30_000)}
    assert [r["token"] for r in hubs.hubs(tokens, whole, 4).collect()] == ["email=hub"]
    with pytest.raises(ValueError):
        hubs.hubs(tokens, whole, 5000)
    nothing = tokens.limit(0)
    assert hubs.hubs(nothing, hubs.combined(hubs.sketched(nothing))).collect() == []


def test_linking_tokens_leave_out_messages_that_stand_alone(spark):
    rows = keyed(messages(envelopes(spark, [{"email": "a@b.c", "phone": "1"}, {"x": 1}])))
    assert {r["token"] for r in hubs.linking_tokens(rows).collect()} == {"email=a@b.c", "phone=1"}


def test_first_fields_and_samples(spark):
    rows = messages(envelopes(spark, [{"a": 1, "b": 2}, {"a": 1}, {"c": 1}, {"d": 1}]))
    got = {(r["part"], r["item"]): r["n"] for r in R.first_fields(rows, 3, 2).collect()}
    assert got == {("field", "a"): 2, ("field", "b"): 1, ("field", "c"): 1, ("sample", "hr_0_0"): 1, ("sample", "hr_0_1"): 2}
    assert R.first_fields(rows.limit(0)).collect() == []
