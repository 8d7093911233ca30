"""Widening columns, tables by key bucket, the change feed, counters, and blocks of any depth."""

import os

import pytest
from pyspark.sql import functions as F

from kinfold.config import Config
from kinfold.functions.fields import decode
from kinfold.operators.counters import Counters, counters, summed
from kinfold.operators.fold import exact_profiles
from kinfold.operators.upsert import upsert, widest
from kinfold.plans import publish as P
from kinfold.plans.tables import BUCKET, merge_into, table
from kinfold.plans.wide import leaves, wide_rows
from kinfold.sources.envelope import file_stream, strict_fields
from kinfold.streaming.landing import COUNTED, landing_query
from kinfold.streaming.profiles import FOLDED, ProfileStore, profile_query

from helpers import contributed, envelopes


def as_of():
    return F.lit("2024-02-01").cast("timestamp")


@pytest.mark.parametrize("a,b,wide", [
    ("bigint", "double", "double"), ("int", "bigint", "bigint"), ("bigint", "string", "string"), ("double", "string", "string"),
    ("boolean", "bigint", "string"), ("void", "bigint", "bigint"), ("date", "timestamp", "timestamp"), ("timestamp", "bigint", "string"),
    ("float", "int", "double"), ("boolean", "boolean", "boolean"), ("decimal(10,2)", "bigint", "string"), ("smallint", "tinyint", "smallint")])
def test_widest_type_in_both_orders(a, b, wide):
    assert widest(a, b) == widest(b, a) == wide


def one(spark, value, kind, key="k"):
    return spark.createDataFrame([(key, value)], f"key string, x {kind}")


def test_upsert_never_narrows(spark):
    first = one(spark, 100, "bigint", "a")
    half = upsert(first, one(spark, 2.5, "double", "b"), "key")
    assert dict(half.dtypes)["x"] == "double" and {r["key"]: r["x"] for r in half.collect()} == {"a": 100.0, "b": 2.5}
    text = upsert(half, one(spark, "n/a", "string", "b"), "key")
    assert {r["key"]: r["x"] for r in text.collect()} == {"a": "100.0", "b": "n/a"}
    back = upsert(text, one(spark, 7, "bigint", "c"), "key")
    assert {r["key"]: r["x"] for r in back.collect()} == {"a": "100.0", "b": "n/a", "c": "7"}
    empty = upsert(first, one(spark, None, "void", "a"), "key")
    assert dict(empty.dtypes)["x"] == "bigint"


def test_large_whole_numbers_are_not_rounded(spark):
    large = one(spark, 2**53 + 1, "bigint", "a")
    for got in (upsert(large, one(spark, 0.5, "double", "b"), "key"), upsert(one(spark, 0.5, "double", "b"), large, "key")):
        assert {r["key"]: r["x"] for r in got.collect()} == {"a": str(2**53 + 1), "b": "0.5"}
    least = one(spark, -2**63, "bigint", "a")
    assert dict(upsert(least, one(spark, 0.5, "double"), "key").dtypes)["x"] == "string"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(200).selectExpr("concat('k', id) as key", "id as n", "timestamp'2024-01-01 00:00:00' as created_at")
    assert merge_into(rows, path, "key", 16) == 16
    before = files(path)
    late = rows.filter("n < 2").withColumns({"n": F.col("n") + 1000, "created_at": F.lit("2025-01-01").cast("timestamp")})
    touched = merge_into(late, path, "key", 16)
    kept = before & files(path)
    assert touched <= 2 and {f.split("/" + BUCKET)[1].split("/")[0] for f in before - kept} == {
        f"={r[0]}" for r in table(spark, path).filter("n >= 1000").select(BUCKET).distinct().collect()}
    got = {r["key"]: r for r in table(spark, path).collect()}
    assert len(got) == 200 and got["k1"]["n"] == 1001 and got["k5"]["n"] == 5 and got["k1"]["created_at"].year == 2024
    assert merge_into(rows.limit(0), path, "key", 16) == 0 and merge_into(rows.withColumn("key", F.lit(None).cast("string")), path, "key", 16) == 0
    again = files(path)
    assert merge_into(late, path, "key", 16) == touched and len(files(path) & again) == len(again) - touched
    assert {tuple(r) for r in table(spark, path).collect()} == {tuple(r) for r in got.values()}


def test_new_types_rewrite_all_and_new_columns_do_not(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_into(spark.range(50).selectExpr("concat('k', id) as key", "id as n"), path, "key", 8)
    before = files(path)
    assert merge_into(spark.createDataFrame([("k3", 3, "new")], "key string, n long, extra string"), path, "key", 8) == 1
    assert len(before & files(path)) == len(before) - 1
    assert {r["key"]: r["extra"] for r in table(spark, path).collect()}["k3"] == "new"
    assert merge_into(spark.createDataFrame([("k4", "n/a")], "key string, n string"), path, "key", 8, "coalesce_new") == 8
    got = {r["key"]: r for r in table(spark, path).collect()}
    assert got["k4"]["n"] == "n/a" and got["k5"]["n"] == "5" and got["k3"]["extra"] == "new" and len(got) == 50


def test_wide_fields_that_are_absent_stay(spark):
    def blocks(*bodies):
        rows = [(f"p{i}", b) for i, b in enumerate(bodies)]
        return wide_rows(spark.createDataFrame(rows, "grouping_key string, b string").select(
            "grouping_key", *[F.lit("2024-01-01").cast("timestamp").alias(c) for c in ("created_at", "updated_at")], decode(F.col("b")).alias("block")))
    stored = P.upsert_children_wide(blocks('{"a":1,"b":"x"}', '{"a":2}'), blocks('{"a":null,"b":"y","c":true}'))
    assert {r["person_id"]: (r["a"], r["b"], r["c"]) for r in stored.collect()} == {"p0": (1, "y", True), "p1": (2, None, None)}


def test_blocks_level_by_level(spark):
    deep = '{"v":1}'
    for i in range(40):
        deep = f'{{"n{i}":{deep}}}'
    bodies = ['{"a b":{"c":1},"a":{"b":{"c":2.5}},"l":[1,"x",null,true,{"q":[2]}],"z":null,"e":{}}', '{"A-B":{"C":true}}', deep, '{"only":null}',
              '{"grouping_key":"mine","1x":"y","":"blank","t":9007199254740993}', '{"t":0.5,"a_b_c":"last","a":{"b":{"c":3}}}']
    df = spark.createDataFrame([(f"p{i}", b) for i, b in enumerate(bodies)], "grouping_key string, b string").select(
        "grouping_key", F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"),
        decode(F.col("b")).alias("block"))
    wide = wide_rows(df)
    got, types = {r["person_id"]: r.asDict() for r in wide.collect()}, dict(wide.dtypes)
    assert set(got) == {f"p{i}" for i in range(6)}
    assert got["p0"]["a_b_c"] == "2.5" and got["p1"]["a_b_c"] == "true" and got["p5"]["a_b_c"] == "3"  # the last in the document's order
    assert got["p0"]["l"] == '1,x,None,True,{"q":[2]}' and "z" not in types and "e" not in types
    assert got["p2"]["_".join(f"n{i}" for i in reversed(range(40))) + "_v"] == 1
    assert got["p4"]["c_grouping_key"] == "mine" and got["p4"]["c_1x"] == "y" and got["p4"]["col"] == "blank"
    assert types["t"] == "string" and got["p4"]["t"] == "9007199254740993" and got["p5"]["t"] == "0.5"
    assert leaves(df.limit(0).select(F.lit(1).alias("row"), "block")).count() == 0
    assert wide_rows(df.limit(0)).columns == ["person_id", "grouping_key", "created_at", "updated_at"]


def test_plan_of_a_level_does_not_grow_with_depth(spark):
    def plan(depth):
        body = '{"v":1}'
        for _ in range(depth):
            body = f'{{"n":{body}}}'
        df = spark.createDataFrame([(1, body)], "row int, b string").select("row", decode(F.col("b")).alias("block"))
        return len(leaves(df)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(plan(2) - plan(12)) < 100


BODIES = [{"passport": f"P{i}", "name": "A", "last_name": "B", "email": f"e{i}@acme.com"} for i in range(6)] + [
    {"passport": f"P{i}", "IBAN": "ES7912345678901234567890"} for i in range(4)]


def fed(spark, store, tmp_path, i, bodies):
    source = str(tmp_path / f"in{i}")
    envelopes(spark, bodies, topic=f"t{i}").coalesce(1).write.parquet(source)
    profile_query(file_stream(spark, source), store, str(tmp_path / f"cp{i}")).awaitTermination()


def test_export_reads_only_later_folders(spark, tmp_path):
    config, root = Config(required_kinds=["personal", "bank"], key_buckets=8), str(tmp_path / "tables")
    store = ProfileStore(spark, str(tmp_path / "store"), config)
    fed(spark, store, tmp_path, 0, BODIES)
    assert P.publish_changes(store, root, as_of(), config) == 0
    assert P.publish_changes(store, root, as_of(), config) is None
    before = files(f"{root}/persons")
    fed(spark, store, tmp_path, 1, [{"passport": "P5", "IBAN": "ES7912345678901234567890"}, "{broken"])
    changed = store.changes(0)
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "(batch" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert [r["grouping_key"] for r in changed.collect()] == ["passport::p5"]
    assert P.publish_changes(store, root, as_of(), config) == 1
    people = {r["grouping_key"] for r in table(spark, f"{root}/persons").collect()}
    assert people == {f"passport::p{i}" for i in (0, 1, 2, 3, 5)} and len(before - files(f"{root}/persons")) <= 1
    done = {r["batch"]: r for r in counters(spark, root, *P.EXPORTED).collect()}
    assert (done[0]["changed"], done[0]["published"], done[0]["bank_data"]) == (6, 4, 4)
    assert (done[1]["changed"], done[1]["published"], done[1]["persons"]) == (1, 1, 1) and done[1]["rate"] > 0
    folded = {r["batch"]: r for r in counters(spark, store.root, *FOLDED).collect()}
    assert (folded[0]["consumed"], folded[0]["errors"], folded[0]["profiles"]) == (10, 0, 6)
    assert (folded[1]["consumed"], folded[1]["errors"], folded[1]["read"], folded[1]["bank"]) == (2, 1, 1, 1)


def test_export_after_compaction_and_lost_checkpoint(spark, tmp_path):
    config, root = Config(required_kinds=["personal", "bank"], key_buckets=4), str(tmp_path / "tables")
    store = ProfileStore(spark, str(tmp_path / "store"), config)
    fed(spark, store, tmp_path, 0, BODIES)
    fed(spark, store, tmp_path, 1, [{"passport": "P5", "IBAN": "ES7912345678901234567890"}])
    store.compact(1)
    assert {r["grouping_key"] for r in store.changes(0).collect()} == {"passport::p5"} and store.changes(None).count() == 6
    P.publish_changes(store, root, as_of(), config)
    rows = {tuple(r) for r in table(spark, f"{root}/persons").collect()}
    os.rename(f"{root}/state", f"{root}/lost")
    assert P.publish_changes(store, root, as_of(), config) == 0
    assert {tuple(r) for r in table(spark, f"{root}/persons").collect()} == rows


def test_landing_counts_while_it_runs(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = envelopes(spark, [*BODIES, "{broken", "[1]"])
    rows.unionByName(rows.filter("offset < 3")).coalesce(1).write.parquet(source)
    landing_query(file_stream(spark, source), root, f"{root}/cp").awaitTermination()
    got = summed(counters(spark, root, *COUNTED), *COUNTED).first()
    assert (got["batches"], got["consumed"], got["errors"], got["landed"], got["dead"]) == (1, 15, 2, 10, 2)
    assert got["rate"] == pytest.approx(15 / got["seconds"])


def test_counters_of_no_rows(spark, tmp_path):
    counted = Counters()
    counted.watch(spark.range(5).filter("id > 9"), n=F.count("*"), most=F.max("id")).write.format("noop").mode("overwrite").save()
    counted.watch(spark.range(3), n=F.count("*")).write.format("noop").mode("overwrite").save()
    counted.add(k=2)
    assert counted.totals() == {"k": 2, "n": 3, "most": 0}
    counted.save(spark, str(tmp_path), 4, "n", "k")
    assert [tuple(r)[:3] for r in counters(spark, str(tmp_path), "n", "k").collect()] == [(4, 3, 2)]


def test_strict_reader_stops_at_a_bad_body(spark):
    rows = spark.createDataFrame([('{"a":1}',), ("{bad",)], "p string")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        rows.select(strict_fields(F.col("p"))).collect()


def test_wide_export_from_profiles(spark, tmp_path):
    root, config = str(tmp_path), Config(required_kinds=[], key_buckets=4)
    made = exact_profiles(contributed(spark, [{"passport": "P1", "company": "A", "salary": 10}, {"passport": "P2", "company": "C", "salary": 2.5}]))
    counted = P.export_wide(made, root, as_of(), config).totals()
    assert counted["published"] == 2 and counted["persons"] == 2 and counted["professional_data"] == 2
    got = {r["person_id"]: r["salary"] for r in table(spark, f"{root}/professional_data").collect()}
    assert got == {"passport::p1": 10.0, "passport::p2": 2.5}
