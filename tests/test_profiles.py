"""Fold, resolution, merge, refine, upsert and publishing."""

import random

from pyspark.sql import functions as F

from kinfold.config import PREFER_OBSERVED, Config
from kinfold.operators.components import components
from kinfold.operators.fold import exact_profiles
from kinfold.operators.refine import final_targets, merge_groups, refine
from kinfold.operators.resolve import key_mapping, merges, resolved_profiles, token_set_states
from kinfold.operators.skew import lookup
from kinfold.operators.upsert import upsert
from kinfold.plans import publish as P

from helpers import contributed, exact, profile_rows, resolved

PERSON = [
    {"name": "Ana", "last_name": "B", "passport": "P1", "email": "ana@acme.com"},
    {"address": "Main Street 1", "city": "Rome", "country": "Italy", "passport": "p1"},
    {"passport": "P1", "IBAN": "ES7912345678901234567890"},
]


def test_rows_are_sorted_by_a_hash_and_carry_their_order_once(spark):
    """Keys begin alike and token sets are lists, so a sort by them alone compares whole values; slots repeat the order ten times."""
    for made, by in ((exact_profiles(contributed(spark, PERSON)), "proposed_key"),
                     (token_set_states(contributed(spark, PERSON)), "tokens")):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        first = plan[plan.rindex("SortAggregate("):].splitlines()
        keys = first[0].split("key=[")[1]
        assert by in keys and "," in keys[:keys.index(by)] and "k_personal" not in first[1] and "i_email" not in first[1], first[:2]


def test_newest_block_wins_and_kinds_unite(spark):
    got = exact(spark, PERSON)["passport::p1"]
    assert got["types"] == ["bank", "location", "net", "personal", "professional"] and got["complete"]
    assert got["data"]["location"] == {"country_code": "ES", "country": "Spain"}
    assert got["ids"] == {"passport": "p1", "email": "ana@acme.com"}
    assert got["updated"] > got["created"]


def test_observed_blocks_can_be_kept(spark):
    got = exact(spark, PERSON, fold_policy=PREFER_OBSERVED)["passport::p1"]
    assert got["data"]["location"]["city"] == "rome"


def test_groups_joined_late_become_one(spark):
    bodies = [{"email": "a@acme.com"}, {"passport": "P1", "IBAN": "ES791234567890123"}, {"passport": "P1", "email": "a@acme.com"},
              {"phone": "5", "email": "old@acme.com"}, {"phone": "5"}, {"q": 1}]
    got = resolved(spark, bodies)
    assert set(got) == {"passport::p1", "email::old@acme.com"}
    assert got["passport::p1"]["ids"]["email"] == "a@acme.com"


def test_messages_without_contribution_still_link(spark):
    bodies = [{"passport": "A", "tax_id": "7"}, {"tax_id": "7", "phone": "1"}, {"passport": "A", "email": "a@b.c"}]
    got = resolved(spark, bodies)
    assert list(got) == ["passport::a"] and got["passport::a"]["ids"]["phone"] == "1"


def test_resolution_ignores_arrival_and_partitioning(spark):
    rng = random.Random(7)
    bodies = [{k: f"{k}{rng.randrange(12)}" + ("@x.org" if k == "email" else "")
               for k in rng.sample(["passport", "email", "phone", "ssn"], rng.choice([1, 1, 2]))} for _ in range(60)]
    base = contributed(spark, bodies)
    first = profile_rows(resolved_profiles(base.repartition(1)))
    second = profile_rows(resolved_profiles(base.orderBy(F.rand(3)).repartition(5), Config(hot_key_share=3)))
    assert first == second
    mapping = {r[0]: r[1] for r in key_mapping(base).collect()}
    assert set(mapping.values()) == set(first)
    assert all(a != b for a, b in merges(key_mapping(base)).collect())


def test_components_match_union_find(spark):
    rng = random.Random(1)
    pairs = [(f"t{rng.randrange(150)}", f"t{rng.randrange(150)}") for _ in range(110)]
    pairs += [("hub", f"h{i}") for i in range(300)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {t: find(t) for a, b in pairs for t in (a, b) if a != b}
    got = components(spark.createDataFrame(pairs, "u string, v string"), Config(hot_key_share=4)).collect()
    assert {r["token"]: r["label"] for r in got} == want and len(got) == len(want)


def test_lookup_keeps_every_row_of_hot_missing_and_null_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(90)] + [("a", 1), ("b", 2), (None, 3)], "k string, n int")
    table = spark.createDataFrame([("hot", "H"), ("a", "A")], "k string, v string")
    got = lookup(rows, table, "k", 3)
    assert got.count() == 93
    assert {(r["k"], r["v"]) for r in got.collect()} == {("hot", "H"), ("a", "A"), ("b", None), (None, None)}


def test_refine_adds_stored_kinds_and_is_idempotent(spark):
    df = exact_profiles(contributed(spark, PERSON)).withColumn("types_received", F.lit(None).cast("array<string>"))
    once = refine(df.withColumn("is_complete", F.lit(False)))
    row = once.first()
    assert row["is_complete"] and len(row["types_received"]) == 5 and row["changed"]
    assert not refine(once.drop("changed")).first()["changed"]


def test_merge_target_wins(spark):
    df = exact_profiles(contributed(spark, [
        {"email": "a@acme.com", "phone": "1"}, {"passport": "P1", "email": "b@beta.org", "city": "Rome"}, {"q": "nothing"}]))
    mapping = spark.createDataFrame([("email::a@acme.com", "passport::p1"), ("rawid::x", "passport::zz")],
                                    "source_key string, target_key string")
    got = profile_rows(merge_groups(df, mapping))
    assert list(got) == ["passport::p1"]
    assert got["passport::p1"]["ids"] == {"passport": "p1", "email": "b@beta.org", "phone": "1"}
    assert got["passport::p1"]["data"]["professional"]["company"] == "Beta"


def test_upsert_policies_and_new_columns(spark):
    old = spark.createDataFrame([("k1", "a", "2020"), ("k2", None, None)], "key string, x string, created_at string")
    new = spark.createDataFrame([("k2", "b", "2021", 1), ("k3", None, "2022", 2), (None, "z", "z", 3)],
                                "key string, x string, created_at string, extra int")
    rows = {r["key"]: r for r in upsert(old, new, "key").collect()}
    assert set(rows) == {"k1", "k2", "k3"}
    assert rows["k1"]["x"] == "a" and rows["k1"]["extra"] is None and rows["k2"]["created_at"] == "2021"
    again = {r["key"]: r["x"] for r in upsert(old, new.withColumn("x", F.lit(None).cast("string")), "key", "coalesce_new").collect()}
    assert again["k1"] == "a"


def test_export_order_gate_skew_and_checkpoint(spark):
    day = "2024-01-01 00:00:0"
    rows = [("b", 1, True), ("a", 1, True), ("c", 2, False), ("d", 3, True)]
    df = spark.createDataFrame([(k, f"{day}{s}", ["personal"] if not ok else ["bank", "location", "net", "personal", "professional"])
                                for k, s, ok in rows], "grouping_key string, t string, types_received array<string>")
    df = df.withColumn("updated_at", F.col("t").cast("timestamp"))

    def keys(*args, **kw):
        return [r["grouping_key"] for r in P.export_batch(df, *args, **kw).collect()]
    assert keys() == ["a", "b", "d"] and keys(limit=2) == ["a", "b"]
    assert keys(f"{day}1", "a") == ["b", "d"] and keys(f"{day}1") == ["a", "b", "d"]
    assert keys(f"{day}3", "d") == [] and keys(f"{day}3", "d", config=Config(skew_seconds=2)) == ["a", "b", "d"]
    last = P.checkpoint_of(P.export_batch(df, f"{day}1", "b", limit=1, gated=False)).first()
    assert last["last_id"] == "c"


def test_payload_emptiness_and_flattening(spark):
    from kinfold.functions.fields import decode
    cases = {'{"a":"","b":[]}': False, '{"a":0}': True, '{"a":{"b":null,"c":[""]}}': False, '{"a":[[],{"x":false}]}': True,
             '{"a":"null"}': True, '{}': False, '{"a":"",":":""}': False, '{"a":":"}': True, '{"a":"\\""}': True, '{"a\\":b":""}': False}
    df = spark.createDataFrame([(c,) for c in cases], "p string").select("p", decode(F.col("p")).alias("f"))
    assert {r["p"]: r["c"] for r in df.select("p", P.has_content(F.col("f")).alias("c")).collect()} == cases
    one = spark.createDataFrame([('{"a":{"b c":{"d":1}},"l":["x",1,true,null],"z":null}',)], "p string")
    pairs = one.select(P.flat_pairs(decode(F.col("p"))).alias("x")).first()["x"]
    assert {p["name"]: p["value"].toPython() for p in pairs} == {"a_b_c_d": 1, "l": "x,1,True,None"}


def test_publish_versions_merge(spark, tmp_path):
    as_of = F.lit("2024-02-01").cast("timestamp")
    root = str(tmp_path)
    P.publish(exact_profiles(contributed(spark, PERSON)), root, 0, as_of)
    other = [dict(m, passport="P2") for m in PERSON]
    P.publish(exact_profiles(contributed(spark, other)), root, 1, as_of, previous=0)
    assert spark.read.parquet(f"{root}/version=1/persons").count() == 2
    assert spark.read.parquet(f"{root}/version=1/bank_data").count() == 2


def test_incremental_publish_follows_its_checkpoint(spark, tmp_path):
    as_of, root = F.lit("2024-02-01").cast("timestamp"), str(tmp_path)
    first = exact_profiles(contributed(spark, PERSON)).withColumn("version", F.lit(0).cast("long"))
    assert P.publish_next(first, root, as_of) == 0
    assert P.publish_next(first, root, as_of) is None
    later = exact_profiles(contributed(spark, [*PERSON, *[dict(m, passport="P2") for m in PERSON], {"passport": "P3", "IBAN": "x"}]))
    late = F.col("updated_at") - F.expr("INTERVAL 1 DAY")  # the order of changes counts, not the time of the messages
    later = later.withColumn("updated_at", late).withColumn("version", F.when(F.col("grouping_key") == "passport::p1", 0).otherwise(1).cast("long"))
    assert P.publish_next(later, root, as_of) == 1
    people = spark.read.parquet(f"{root}/version=1/persons")
    assert sorted(r["grouping_key"] for r in people.collect()) == ["passport::p1", "passport::p2"]
    assert P.load_checkpoint(spark, root)[2] == "passport::p2"
    assert P.publish_next(later, root, as_of) is None


def test_wide_rows_gain_columns(spark):
    one = exact_profiles(contributed(spark, [{"passport": "P1", "company": "A", "salary": 10}]))
    two = exact_profiles(contributed(spark, [{"passport": "P1", "company": "B", "role": "x"}, {"passport": "P2", "dept": "y"}]))
    stored, new = P.wide_children(one, "professional"), P.wide_children(two, "professional")
    assert dict(stored.dtypes)["salary"] == "bigint"
    rows = {r["person_id"]: r for r in P.upsert_children_wide(stored, new).collect()}
    assert rows["passport::p1"]["company"] == "b" and rows["passport::p2"]["department"] == "y"
    assert set(rows["passport::p1"].asDict()) >= {"company", "salary", "position", "department"}


def test_published_key_falls_back(spark):
    df = spark.createDataFrame([("", "p", None), (None, None, "t")], "grouping_key string, passport string, tax_id string")
    keys = [r["k"] for r in df.select(P.composed_key(df).alias("k")).collect()]
    assert keys == ["passport::p", "tax::t"]


def test_only_small_sources_are_spread(spark, tmp_path):
    from kinfold.sources import message_view as mv
    spark.range(40).selectExpr("id as event_id", "id as user_id", "timestamp'2024-01-01 00:00:00' as ts").repartition(16).write.parquet(
        f"{tmp_path}/events.parquet")
    spark.range(5).selectExpr("id as c_custkey", "'n' as c_name").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    both = mv.landed(spark, str(tmp_path), "net", "personal")
    assert both.count() == 45
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and plan.index("Union") < plan.index("Repartition")
    assert "Repartition" not in mv.landed(spark, str(tmp_path), "net")._jdf.queryExecution().optimizedPlan().toString()


def test_messages_are_parsed_once(spark):
    from kinfold.operators.typed import typed
    from kinfold.sources.envelope import messages
    from helpers import envelopes
    plan = typed(messages(envelopes(spark, PERSON)), "bank")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_targets_follow_chains_and_circles(spark):
    pairs = [("a", "b"), ("b", "c"), ("d", "c"), ("d", "x"), ("p", "q"), ("q", "p")]
    df = spark.createDataFrame(pairs, "source_key string, target_key string")
    assert {tuple(r) for r in final_targets(df).collect()} == {("a", "c"), ("b", "c"), ("d", "c"), ("q", "p")}


def test_blocks_of_any_depth_and_text_times(spark):
    from kinfold.functions.fields import decode
    body = '{"a":{"b":{"c":{"d":{"e":{"f":{"g":1}}}}}},"s":"}{","l":[{"x":1}]}'
    df = spark.createDataFrame([("k", body, "2024-01-02T03:04:05Z", "no time")],
                               "grouping_key string, p string, created_at string, updated_at string")
    df = df.withColumn("bank", decode(F.col("p"))).drop("p")
    as_of = F.lit("2024-02-01").cast("timestamp")
    wide = P.wide_children(P._with_times(df, as_of), "bank").first().asDict()
    assert wide["a_b_c_d_e_f_g"] == 1 and wide["s"] == "}{"
    times = P.persons(df, as_of).select(F.unix_seconds("created_at"), F.unix_seconds("updated_at")).first()
    assert tuple(times) == (1704164645, 1706745600)


def test_messages_without_a_time_have_profiles(spark):
    from kinfold.plans.extract import contribute
    from kinfold.sources.envelope import messages
    from helpers import envelopes
    records = envelopes(spark, [{"passport": "P1", "IBAN": "ES791234567890123"}]).withColumn("timestamp", F.lit(None).cast("timestamp"))
    row = exact_profiles(contribute(messages(records))).first()
    assert row["grouping_key"] == "passport::p1" and row["updated_at"] is None
