"""Landing rules and streams: restart, replay, and equality with batch."""

from pyspark.sql import functions as F

from kinfold import queries
from kinfold.operators.resolve import resolved_profiles
from kinfold.plans.extract import contribute
from kinfold.sources import landing as L
from kinfold.sources.envelope import file_stream, messages, spread
from kinfold.streaming.landing import bounded_dedupe, dead, land_batch, landed, landing_query
from kinfold.streaming.profiles import ProfileStore, profile_query

from helpers import envelopes, profile_rows

BODIES = [{"email": "a@acme.com"}, {"passport": "P1", "IBAN": "ES791234567890123"}, {"phone": "5"},
          {"passport": "P2", "city": "Rome"}, {"passport": "P1", "email": "a@acme.com"},
          {"phone": "5", "passport": "P2"}, {"passport": "A", "tax_id": "7"}, {"tax_id": "7", "phone": "9"}]


def test_first_of_each_coordinate_is_kept(spark):
    rows = [("t", 0, 1, "a", 1), ("t", 0, 1, "b", 0), ("u", 0, 1, "c", 0), (None, None, None, "d", 0), (None, None, None, "e", 0)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, payload string, seen int")
    assert sorted(r["payload"] for r in L.first_per_coordinate(df, "seen").collect()) == ["b", "c", "d", "e"]
    stored = df.filter("topic = 'u'")
    assert sorted(r["payload"] for r in L.new_rows(df, stored, "seen").collect()) == ["b", "d", "e"]


def test_landing_again_changes_nothing(spark, tmp_path):
    root, records = str(tmp_path), envelopes(spark, [*BODIES, "{broken"])
    land_batch(records.filter("offset < 5"), 0, root)
    for _ in range(2):
        land_batch(records, 1, root)
    got = landed(spark, root)
    assert got.count() == len(BODIES) and got.filter("batch = 1").count() == len(BODIES) - 5
    assert spark.read.parquet(f"{root}/dead").count() == 1


def test_landing_stream_restarts_from_its_checkpoint(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    envelopes(spark, BODIES[:5]).coalesce(1).write.parquet(f"{source}/1")
    stream = file_stream(spark, f"{source}/*")
    landing_query(stream, root, f"{root}/cp").awaitTermination()
    envelopes(spark, BODIES).coalesce(1).write.parquet(f"{source}/2")
    landing_query(file_stream(spark, f"{source}/*"), root, f"{root}/cp").awaitTermination()
    assert landed(spark, root).groupBy("batch").count().orderBy("batch").collect() == [(0, 5), (1, 3)]


def test_a_new_checkpoint_sees_what_is_landed(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    envelopes(spark, [*BODIES[:5], "{broken"]).coalesce(1).write.parquet(f"{source}/1")
    landing_query(file_stream(spark, f"{source}/*"), root, f"{root}/cp").awaitTermination()
    changed = [{"changed": i} for i in range(5)] + ["{broken again", *BODIES[6:]]
    envelopes(spark, changed).coalesce(1).write.parquet(f"{source}/2")
    landing_query(file_stream(spark, f"{source}/*"), root, f"{root}/cp2").awaitTermination()
    rows = landed(spark, root).collect()
    assert len(rows) == len(BODIES) - 1 and not any("changed" in r["payload"] for r in rows)
    assert [bytes(r["value"]) for r in dead(spark, root).collect()] == [b"{broken"]


def test_two_streams_share_a_store(spark, tmp_path):
    records = envelopes(spark, BODIES)
    store = ProfileStore(spark, str(tmp_path / "store"))
    for i, rows in enumerate(("offset >= 4", "offset < 4")):
        records.filter(rows).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        profile_query(file_stream(spark, str(tmp_path / f"in{i}")), store, str(tmp_path / f"cp{i}")).awaitTermination()
    assert profile_rows(store.profiles()) == profile_rows(resolved_profiles(contribute(messages(records))))


def test_bounded_dedupe_keeps_one(spark, tmp_path):
    records = envelopes(spark, BODIES)
    records.unionByName(records).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = (bounded_dedupe(file_stream(spark, str(tmp_path / "in")), "1 hour").writeStream.format("parquet")
             .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(BODIES)


def test_stream_of_profiles_equals_batch(spark, tmp_path):
    records = envelopes(spark, BODIES)
    for i, rows in enumerate(("offset % 3 = 1", "offset % 3 = 2", "offset % 3 = 0")):
        records.filter(rows).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    store = ProfileStore(spark, str(tmp_path / "store"))
    profile_query(file_stream(spark, str(tmp_path / "in/*"), 1), store, str(tmp_path / "cp")).awaitTermination()
    want = profile_rows(resolved_profiles(contribute(messages(records))))
    assert profile_rows(store.profiles()) == want
    last = contribute(messages(records.filter("offset % 3 = 0")))
    store.merge_batch(last, 2)
    assert profile_rows(store.profiles()) == want
    store.compact(1)
    store.merge_batch(last, 2)
    assert profile_rows(store.profiles()) == want
    store.compact(2)
    assert profile_rows(store.profiles()) == want


def test_replay_and_unprocessed(spark):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "raw_id string, processed boolean")
    assert {r["raw_id"] for r in L.unprocessed(df).collect()} == {"b", "c"}
    marked = L.mark_processed(df, df.filter("raw_id = 'c'").select("raw_id"))
    assert {r["raw_id"] for r in L.unprocessed(marked).collect()} == {"b"}
    assert L.unprocessed(L.replay(marked)).count() == 3
    assert "processed" not in L.replay(marked, unset=True).columns
    assert L.retained(spark.range(3).withColumn("ts", F.timestamp_seconds("id")), F.timestamp_seconds(F.lit(1))).count() == 2


def test_a_batch_from_one_file_is_parsed_on_all_cores(spark, tmp_path):
    """One file that cannot be split was one task before, whatever it held."""
    envelopes(spark, [{"passport": f"p{i}"} for i in range(200)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert batch.rdd.getNumPartitions() == 1
    spread_out = spread(batch)
    assert spread_out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r["offset"] for r in spread_out.collect()) == list(range(200))
    assert spread(spread_out) is spread_out


def test_streams_of_queries_have_a_file_for_each_core(spark):
    records = envelopes(spark, [{"passport": f"p{i}"} for i in range(500)])
    stream, seen = queries._stream(spark, records), []
    stream.writeStream.foreachBatch(lambda df, batch: seen.append((df.rdd.getNumPartitions(), df.count()))).trigger(
        availableNow=True).start().awaitTermination()
    assert [n for _, n in seen] == [500] and seen[0][0] > 1
