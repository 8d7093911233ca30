"""Registered queries: each runs one part of the engine over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.config import PREFER_OBSERVED, Config
from kinfold.functions import text as T
from kinfold.functions.fields import decode
from kinfold.operators import derive, hubs, refine, resolve, typed, upsert
from kinfold.operators.blocks import light_block
from kinfold.operators.counters import counters, summed
from kinfold.operators.fold import exact_profiles
from kinfold.operators.skew import shuffled
from kinfold.plans import extract as E
from kinfold.plans import publish as P
from kinfold.plans import reports as R
from kinfold.plans.tables import table
from kinfold.session import configure, scratch_dir, written
from kinfold.sources import landing as L
from kinfold.sources import message_view as mv
from kinfold.sources.envelope import ENVELOPE, dead_letters, decoded, file_stream, strict_fields, with_fields
from kinfold.streaming import landing as SL
from kinfold.streaming.profiles import FOLDED, ProfileStore, profile_query
from kinfold.streaming.progress import ProgressTable, progress_rows, remaining

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PEOPLE = ("personal", "bank", "net")


def query(run: Query) -> Query:
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(configure(spark), sf_dir)
    QUERIES[run.__name__] = configured
    return run


def micros(column: str) -> Column:
    return F.unix_micros(column)


def listed(column: str) -> Column:
    return F.array_join(F.sort_array(column), ",")


def block_text(block: Column, name: str) -> Column:
    """Field of a block as text: strings plain, other values as JSON."""
    value = F.try_element_at(block, F.lit(name))
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string")).otherwise(F.to_json(value))


def contributed(spark: SparkSession, sf_dir: str, *views: str, config: Config = Config()) -> DataFrame:
    return E.contribute(mv.messages(spark, sf_dir, *views), config)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_profiles(contributed(spark, sf_dir))


def flat(profiles: DataFrame) -> DataFrame:
    """Profile as scalar columns: identifiers, kinds and one telling field per block."""
    data = F.col("data")
    return profiles.select(
        "grouping_key", *[F.col("identifiers")[i].alias(i) for i in V.IDENTIFIERS],
        listed("types_received").alias("types"), "is_complete",
        block_text(data["personal"], "fullname").alias("fullname"),
        block_text(data["personal"], "email").alias("personal_email"),
        block_text(data["location"], "country_code").alias("country_code"),
        block_text(data["location"], "address").alias("address"),
        block_text(data["professional"], "company").alias("company"),
        block_text(data["professional"], "salary").alias("salary"),
        block_text(data["bank"], "iban").alias("iban"), block_text(data["bank"], "swift").alias("swift"),
        block_text(data["net"], "ipv4").alias("ipv4"), block_text(data["net"], "domain").alias("domain"),
        micros("created_at").alias("created_us"), micros("updated_at").alias("updated_us"))


# --- landing ------------------------------------------------------------------

def _sent_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, and every third a second time with a changed body."""
    rows = mv.landed(spark, sf_dir, "net").withColumn("copy", F.lit(0))
    again = (rows.filter(F.col("offset") % 3 == 0)
             .withColumn("payload", F.lit('{"again":true}')).withColumn("copy", F.lit(1)))
    return rows.unionByName(again)


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as broker records, some with bodies that are no JSON object."""
    bad = F.when(F.col("offset") % 50 == 0, F.lit("{invalid json}").cast("binary")).when(
        F.col("offset") % 50 == 10, F.lit("[1]").cast("binary")).when(
        F.col("offset") % 50 == 20, F.unhex(F.lit("FFFE20"))).when(
        F.col("offset") % 50 == 30, F.concat(F.col("value"), F.lit(" tail").cast("binary")))
    return mv.envelopes(spark, sf_dir, "net").withColumn("value", F.coalesce(bad, F.col("value")))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("offset") % 4 == 0, True).when(F.col("offset") % 4 == 1, False)
    return mv.landed(spark, sf_dir, "net").withColumn("processed", flag)


@query
def landing_dedupe(spark, sf_dir):
    kept = L.first_per_coordinate(_sent_twice(spark, sf_dir), "copy")
    return kept.groupBy("topic", "partition").agg(
        F.count("*").alias("n"), F.sum("copy").alias("second_copies"), F.sum("offset").alias("offset_sum"))


@query
def landing_metrics(spark, sf_dir):
    earlier = mv.landed(spark, sf_dir, "net").filter(F.col("offset") % 10 == 1)
    return L.landing_metrics(decoded(_broken(spark, sf_dir)), earlier)


@query
def dead_letter_rows(spark, sf_dir):
    return dead_letters(_broken(spark, sf_dir)).groupBy("topic", "partition").agg(
        F.count("*").alias("n"), F.sum("offset").alias("offset_sum"))


@query
def unprocessed_scan(spark, sf_dir):
    return L.unprocessed(_flagged(spark, sf_dir)).select("raw_id", "processed")


@query
def unprocessed_ids(spark, sf_dir):
    rows = _flagged(spark, sf_dir)
    return L.unprocessed_by_ids(rows, rows.filter("processed").select("raw_id")).select("raw_id")


@query
def mark_processed(spark, sf_dir):
    rows = _flagged(spark, sf_dir)
    return L.mark_processed(rows, rows.filter("partition = 1").select("raw_id")).groupBy("processed").agg(
        F.count("*").alias("n"))


@query
def replay_reset(spark, sf_dir):
    return L.replay(_flagged(spark, sf_dir)).groupBy("processed").agg(F.count("*").alias("n"))


@query
def retention_window(spark, sf_dir):
    rows = mv.landed(spark, sf_dir, "net")
    cutoff = mv.table(spark, sf_dir, "events").select(
        (F.max("ts").cast("timestamp") - F.expr("INTERVAL 1 HOUR"))).scalar()
    return L.retained(rows, cutoff).select("raw_id", micros("ts").alias("ts_us"))


# --- classification and extraction --------------------------------------------

def _register_typed(kind: str) -> None:
    def run(spark, sf_dir):
        return typed.typed(mv.messages(spark, sf_dir), kind)
    run.__name__ = f"typed_{kind}"
    query(run)


for _kind in V.KINDS:
    _register_typed(_kind)


@query
def exact_kind_counts(spark, sf_dir):
    return typed.kind_counts(mv.messages(spark, sf_dir))


@query
def scored_kind_counts(spark, sf_dir):
    rows = E.extract(mv.messages(spark, sf_dir, *mv.VIEWS))
    return rows.groupBy("topic", "kind").agg(F.count("*").alias("n"))


@query
def block_fields(spark, sf_dir):
    rows = E.extract(mv.messages(spark, sf_dir, *mv.VIEWS))
    pairs = rows.select("topic", F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.map_keys(f"b_{k}").alias("names")) for k in V.KINDS])))
    return (pairs.select("topic", "kind", F.explode("names").alias("field"))
            .groupBy("topic", "kind", "field").agg(F.count("*").alias("n")))


@query
def light_unknown_block(spark, sf_dir):
    rows = mv.messages(spark, sf_dir, "text")
    light = rows.select("raw_id", light_block(F.col("fields"))["raw"].alias("raw"))
    return light.select("raw_id", F.array_join(F.sort_array(F.map_keys("raw")), ",").alias("names"),
                        block_text(F.col("raw"), "doc").alias("doc"), block_text(F.col("raw"), "lang").alias("lang"))


@query
def extract_patterns(spark, sf_dir):
    rows = mv.messages(spark, sf_dir, "text")
    texts = E.texts_of(rows)
    return texts.select("raw_id", T.find_iban(F.col("joined")).alias("iban"), T.find_swift(F.col("joined")).alias("swift"),
                        T.find_ipv4(F.col("joined")).alias("ipv4"))


@query
def extract_addresses(spark, sf_dir):
    """What the pattern rules read from free text and conversations, as it goes into the blocks; long values by their hash."""
    rows = E.extract(mv.messages(spark, sf_dir, "text", "chat"))
    found = rows.select("raw_id", *[block_text(F.col(b), f).alias(f) for b, f in (
        ("b_bank", "iban"), ("b_bank", "swift"), ("b_net", "ipv4"), ("b_net", "ipv6"))])
    return found.filter("coalesce(iban, swift, ipv4, ipv6) is not null").select("raw_id", "iban", "swift", "ipv4", F.md5("ipv6").alias("ipv6_md5"))


@query
def identifiers(spark, sf_dir):
    rows = E.keyed(mv.messages(spark, sf_dir))
    return rows.select("raw_id", *[F.col(f"id_{i}").alias(i) for i in V.IDENTIFIERS])


@query
def grouping_key(spark, sf_dir):
    return E.keyed(mv.messages(spark, sf_dir)).select("raw_id", "proposed_key")


@query
def typed_repeated_keys(spark, sf_dir):
    """Bank messages whose keys come twice: the last value counts, as for any JSON reader."""
    twice = F.format_string('{"passport":"A%1$d","IBAN":"x","passport":"B%1$d","salary":"1","IBAN":"Y%1$d"}', "c_custkey")
    rows = mv.table(spark, sf_dir, "customer").select(F.concat(F.lit("twice_"), "c_custkey").alias("raw_id"), twice.alias("payload"))
    return typed.typed(with_fields(rows), "bank")


# --- derivation -----------------------------------------------------------------

def _derived(spark, sf_dir, kind: str, views: tuple[str, ...], fields: list[str]) -> DataFrame:
    rows = derive.exploded(contributed(spark, sf_dir, *views)).filter(
        (F.col("contributed_kind") == kind) & F.col("derived"))
    return rows.select("raw_id", *[block_text(F.col("block"), f).alias(f) for f in fields])


@query
def derive_location(spark, sf_dir):
    return _derived(spark, sf_dir, "location", ("bank",), ["country_code", "country"])


@query
def derive_personal(spark, sf_dir):
    return _derived(spark, sf_dir, "personal", ("net",), ["email", "phone"])


@query
def derive_net(spark, sf_dir):
    return _derived(spark, sf_dir, "net", ("personal", "net"), ["domain"])


@query
def derive_professional(spark, sf_dir):
    return _derived(spark, sf_dir, "professional", ("personal", "net"), ["company", "_inferred"])


@query
def contributions(spark, sf_dir):
    rows = derive.exploded(contributed(spark, sf_dir, *mv.VIEWS))
    return rows.groupBy("topic", "contributed_kind", "derived", "step").agg(F.count("*").alias("n"))


@query
def batch_metrics(spark, sf_dir):
    return derive.batch_metrics(contributed(spark, sf_dir, *mv.VIEWS))


# --- fold and resolution ----------------------------------------------------------

@query
def profile_completeness(spark, sf_dir):
    """Flagship: messages to profiles to their distribution by number of kinds."""
    rows = exact_profiles(contributed(spark, sf_dir, *mv.VIEWS))
    return rows.groupBy(F.size("types_received").cast("long").alias("kinds"), "is_complete").agg(
        F.count("*").alias("n"))


@query
def profile_fold(spark, sf_dir):
    return flat(people(spark, sf_dir))


@query
def profile_fold_no_timestamp(spark, sf_dir):
    """Bank messages of which half have no time: their profiles exist, with the time of the others, if any."""
    rows = mv.messages(spark, sf_dir, "bank").withColumn("ts", F.when(F.col("offset") % 2 == 1, F.col("ts")))
    made = exact_profiles(E.contribute(rows))
    return made.select("grouping_key", listed("types_received").alias("types"), micros("created_at").alias("created_us"),
                       micros("updated_at").alias("updated_us"))


@query
def profile_fold_observed(spark, sf_dir):
    config = Config(fold_policy=PREFER_OBSERVED)
    return flat(exact_profiles(contributed(spark, sf_dir, config=config), config))


@query
def resolve_components(spark, sf_dir):
    return flat(resolve.resolved_profiles(contributed(spark, sf_dir, *PEOPLE)))


@query
def resolve_mapping(spark, sf_dir):
    return resolve.merges(resolve.key_mapping(contributed(spark, sf_dir, *PEOPLE)))


@query
def resolve_all_views(spark, sf_dir):
    """Persons over the messages of all seven views: free text and conversations name identifiers of nobody or anybody."""
    return flat(resolve.resolved_profiles(contributed(spark, sf_dir, *mv.VIEWS)))


def _switchboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event messages of which a third name one telephone, and a twentieth one of two e-mail addresses."""
    rows = mv.table(spark, sf_dir, "events")
    phone = F.when(F.col("event_id") % 3 == 0, "+34 000").otherwise(F.concat(F.lit("+34 "), "event_id"))
    email = F.when(F.col("event_id") % 20 == 0, F.concat(F.lit("desk"), F.col("event_id") % 40, F.lit("@acme.com")))
    body = F.to_json(F.struct(F.concat(F.lit("P"), "user_id").alias("passport"), phone.alias("phone"), email.alias("email")))
    return with_fields(rows.select(
        F.lit("hr.desk").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").cast("long").alias("offset"),
        F.col("ts").cast("timestamp").alias("ts"), body.alias("payload"), F.concat(F.lit("desk_"), "event_id").alias("raw_id")))


@query
def hub_identifiers(spark, sf_dir):
    """Identifiers that more than one in 250 links goes through, from merged sketches of four batches."""
    tokens = written(hubs.linking_tokens(E.keyed(_switchboard(spark, sf_dir)).select("offset", "tokens")), "tokens")
    batches = [hubs.sketched(tokens.filter(F.pmod(F.xxhash64("token", F.monotonically_increasing_id()), F.lit(4)) == i)) for i in range(4)]
    sketches = written(batches[0].unionByName(batches[1]).unionByName(batches[2]).unionByName(batches[3]), "sketches")
    return hubs.hubs(tokens, hubs.combined(sketches), 250)


@query
def merge_groups(spark, sf_dir):
    """Groups of the exact fold merged along the identifier they share with a customer's passport group."""
    groups = written(people(spark, sf_dir), "groups")
    targets = groups.filter(F.col("grouping_key").startswith("passport::")).select(
        F.col("grouping_key").alias("target_key"), F.col("identifiers")["email"].alias("email"))
    mapping = (groups.filter(F.col("grouping_key").startswith("email::"))
               .select(F.col("grouping_key").alias("source_key"), F.col("identifiers")["email"].alias("email"))
               .join(shuffled(targets), "email").select("source_key", "target_key"))
    return flat(refine.merge_groups(groups, mapping))


@query
def merge_groups_chain(spark, sf_dir):
    """Customers' groups merged along chains of three, their sources before the end listed twice."""
    groups = written(exact_profiles(contributed(spark, sf_dir, "personal")), "groups")
    key = F.regexp_extract("grouping_key", "passport::p(.*)", 1).cast("long")

    def of(step: Column) -> Column:
        return F.concat(F.lit("passport::p"), step.cast("string"))
    hops = groups.filter(key % 3 < 2).select(F.col("grouping_key").alias("source_key"), of(key + 1).alias("target_key"), key.alias("k"))
    mapping = hops.drop("k").unionByName(hops.filter("k % 3 = 1").drop("k"))
    return refine.merge_groups(groups, mapping).select(
        "grouping_key", F.col("identifiers")["passport"].alias("passport"), micros("created_at").alias("created_us"),
        micros("updated_at").alias("updated_us"))


@query
def refine_profiles(spark, sf_dir):
    kept = people(spark, sf_dir).withColumn("types_received", F.when(
        F.length("grouping_key") % 2 == 0, F.filter("types_received", lambda t: t == "bank")))
    done = refine.refine(kept)
    return done.select("grouping_key", listed("types_received").alias("types"), "is_complete", "changed")


# --- export and publish -------------------------------------------------------------

SINCE = ("2024-01-30 12:00:00", "passport::p5")


def _as_of() -> Column:
    return F.lit("2024-02-01").cast("timestamp")


def _exported(batch: DataFrame) -> DataFrame:
    return batch.select("grouping_key", micros("updated_at").alias("updated_us"))


@query
def export_keyset(spark, sf_dir):
    return _exported(P.export_batch(people(spark, sf_dir), *SINCE, limit=100))


@query
def export_skew(spark, sf_dir):
    return _exported(P.export_batch(people(spark, sf_dir), *SINCE, config=Config(skew_seconds=86400), limit=100))


@query
def export_gate(spark, sf_dir):
    return P.gate_counts(people(spark, sf_dir))


@query
def export_checkpoint(spark, sf_dir):
    last = P.checkpoint_of(P.export_batch(people(spark, sf_dir), limit=1000, gated=False))
    return last.select(micros("ts").alias("ts_us"), "last_id")


@query
def persons_rows(spark, sf_dir):
    rows = people(spark, sf_dir).withColumn("updated_at", F.when(F.length("grouping_key") % 3 > 0, F.col("updated_at")))
    return P.persons(rows, _as_of()).select("grouping_key", *V.IDENTIFIERS, micros("created_at").alias("created_us"),
                                            micros("updated_at").alias("updated_us"))


@query
def persons_text_times(spark, sf_dir):
    """Times that came as text: with a zone, with an offset, without either, and no time at all."""
    texts = ["2024-01-10T03:04:05Z", "2024-01-10T03:04:05+02:00", "2024-01-10 03:04:05", "soon"]
    which = F.length("grouping_key") % 4
    text = F.get(F.array(*[F.lit(t) for t in texts]), which)
    rows = people(spark, sf_dir).withColumns({"created_at": F.get(F.array(*[F.lit(t) for t in texts[1:]]), which), "updated_at": text})
    return P.persons(rows, _as_of()).select("grouping_key", micros("created_at").alias("created_us"), micros("updated_at").alias("updated_us"))


@query
def child_rows(spark, sf_dir):
    kids = P.children(people(spark, sf_dir), _as_of())
    return kids.groupBy("kind").agg(F.count("*").alias("n"), F.max(micros("updated_at")).alias("max_us"))


@query
def child_payloads(spark, sf_dir):
    """Published payloads themselves: the telling field of each kind, read back from the JSON text."""
    telling = {"personal": "email", "location": "country_code", "professional": "company", "bank": "iban", "net": "ipv4"}
    kids = P.children(people(spark, sf_dir), _as_of())
    value = F.coalesce(*[F.when(F.col("kind") == k, F.get_json_object("data", f"$.{f}")) for k, f in telling.items()])
    return kids.select("kind", "grouping_key", value.alias("value"))


@query
def publish_key_fallback(spark, sf_dir):
    """Rows whose key is missing get one composed of their identifiers; rows without any are not published."""
    rows = people(spark, sf_dir).withColumn("grouping_key", F.when(F.length("grouping_key") % 2 == 1, F.col("grouping_key")))
    return P.persons(rows, _as_of(), composed=True).select("grouping_key", "passport", "email", "phone")


@query
def export_rows_per_table(spark, sf_dir):
    return P.export_metrics(P.gate(people(spark, sf_dir)), _as_of()).select(
        "table", "rows", micros("max_ts").alias("max_us"))


def _register_wide(kind: str, columns: list[str]) -> None:
    def run(spark, sf_dir):
        rows = P.wide_children(people(spark, sf_dir), kind)
        return rows.select("person_id", *[F.col(c).cast("string").alias(c) for c in columns])
    run.__name__ = f"wide_{kind}"
    query(run)


_register_wide("bank", ["iban", "swift"])
_register_wide("personal", ["fullname", "email"])
_register_wide("location", ["address", "country_code"])
_register_wide("net", ["domain", "ipv4"])
_register_wide("professional", ["company", "inferred", "salary"])


@query
def wide_nested(spark, sf_dir):
    """A block of six levels: every leaf has a column of its own."""
    deep = F.format_string('{"company":"c","location":{"a":{"b":{"c":{"d":{"e":%d}}}},"f":"x"}}', "c_custkey")
    rows = mv.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("k"), "c_custkey").alias("grouping_key"), F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"), decode(deep).alias("professional"))
    wide = P.wide_children(rows, "professional")
    return wide.select("person_id", "company", "location_a_b_c_d_e", "location_f")


@query
def wide_upsert(spark, sf_dir):
    """Two versions of the wide tables: the second adds and replaces, and rows only in the first stay."""
    root, config = _root(spark), Config(required_kinds=[])
    made = written(people(spark, sf_dir), "people")
    half = F.length("grouping_key") % 2 == 0
    P.publish_wide(made.filter(half), root, 0, _as_of(), config=config)
    P.publish_wide(made.filter(~half), root, 1, _as_of(), previous=0, config=config)
    persons = spark.read.parquet(f"{root}/version=1/persons").select("grouping_key", *V.IDENTIFIERS)
    bank = spark.read.parquet(f"{root}/version=1/{V.CHILD_TABLES['bank']}")
    return persons.join(bank.select(F.col("person_id").alias("grouping_key"), "iban", "swift"), "grouping_key", "left")


def _one_block(spark: SparkSession, sf_dir: str, kind: str, body: Column, rows: Column) -> DataFrame:
    """Profiles of customers with a single block, read from the JSON text ``body``."""
    nothing = F.lit(None).cast("map<string,variant>")
    return mv.table(spark, sf_dir, "customer").filter(rows).select(
        F.concat(F.lit("k"), "c_custkey").alias("grouping_key"), F.array(F.lit(kind)).alias("types_received"),
        *[F.lit("2024-01-15").cast("timestamp").alias(c) for c in ("created_at", "updated_at")],
        F.struct(*[(decode(body) if k == kind else nothing).alias(k) for k in V.KINDS]).alias("data"))


@query
def wide_type_change(spark, sf_dir):
    """Fields that are whole numbers, then fractions, then text: their columns widen and keep what is stored."""
    root, config = _root(spark), Config(required_kinds=[], key_buckets=8)
    bodies = ('{"score":%1$d,"large":9007199254740993,"sure":true,"company":"c%1$d"}', '{"score":%1$d.5,"large":0.5}',
              '{"score":"n/a","sure":1,"added":{"late":[1,"x"]}}')
    seen = []
    for i, body in enumerate(bodies):
        rows = _one_block(spark, sf_dir, "professional", F.format_string(body, "c_custkey"), F.col("c_custkey") % 3 >= i)
        P.export_wide(rows, root, _as_of(), config)
        stored = written(table(spark, f"{root}/{V.CHILD_TABLES['professional']}"), "stored")
        types = dict(stored.dtypes)
        seen.append(stored.select(
            F.lit(i).cast("long").alias("export"), "person_id", *[c for n in ("score", "large", "sure", "company", "added_late") for c in (
                (F.col(n) if n in types else F.lit(None)).cast("string").alias(n), F.lit(types.get(n)).alias(f"{n}_type"))]))
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


@query
def export_partial_rewrite(spark, sf_dir):
    """Tables after a second export of a few profiles: those rows are new, all others stay, few buckets are written."""
    root, config = _root(spark), Config(required_kinds=[], key_buckets=64)
    made = written(people(spark, sf_dir).filter("grouping_key like 'passport::%'"), "people")
    first = P.export_wide(made, root, _as_of(), config).totals()
    some = made.filter("grouping_key = 'passport::p7'").withColumn("identifiers", F.col("identifiers").withField("phone", F.lit("changed")))
    second = P.export_wide(some, root, _as_of(), config).totals()
    rows = table(spark, f"{root}/persons").select("grouping_key", "passport", "phone")
    one_bucket_a_table = second["buckets"] == sum(n > 0 for t, n in second.items() if t not in ("buckets", "published"))
    return rows.select("*", F.lit(first["published"]).cast("long").alias("first_export"), F.lit(second["published"]).cast(
        "long").alias("second_export"), F.lit(one_bucket_a_table).alias("one_bucket_a_table"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored and incoming person rows made from customers; they overlap in the middle."""
    base = mv.table(spark, sf_dir, "customer").selectExpr(
        "concat('passport::p', c_custkey) as grouping_key", "c_custkey as k", "c_name", "c_mktsegment", "c_nationkey")
    count = mv.table(spark, sf_dir, "customer").select(F.count("*")).scalar()
    rows = base.withColumn("total", count)
    stored = rows.filter("k < total * 2 / 3").selectExpr(
        "grouping_key", "c_name as passport", "if(k % 2 = 0, c_mktsegment, null) as email",
        "if(k % 5 = 0, null, timestamp'2023-01-01 00:00:00') as created_at",
        "timestamp'2023-02-01 00:00:00' as updated_at")
    given = rows.filter("k >= total / 3").selectExpr(
        "grouping_key", "if(k % 3 = 0, null, concat('new ', k)) as passport",
        "if(k % 4 = 0, null, cast(c_nationkey as string)) as email",
        "timestamp'2024-01-01 00:00:00' as created_at", "timestamp'2024-02-01 00:00:00' as updated_at")
    return stored, given


def _register_upsert(policy: str) -> None:
    def run(spark, sf_dir):
        stored, given = _halves(spark, sf_dir)
        return upsert.upsert(stored, given, "grouping_key", policy).select(
            "grouping_key", "passport", "email", micros("created_at").alias("created_us"),
            micros("updated_at").alias("updated_us"))
    run.__name__ = f"upsert_{policy}"
    query(run)


for _policy in (upsert.REPLACE, upsert.COALESCE_NEW, upsert.TARGET_WINS):
    _register_upsert(_policy)


# --- reports ----------------------------------------------------------------------

@query
def pipeline_stats(spark, sf_dir):
    return R.pipeline_stats(_flagged(spark, sf_dir), people(spark, sf_dir))


@query
def kind_frequency(spark, sf_dir):
    return R.kind_frequency(people(spark, sf_dir))


@query
def kind_distribution(spark, sf_dir):
    return R.kind_distribution(people(spark, sf_dir))


@query
def all_kinds_count(spark, sf_dir):
    return R.all_kinds_count(people(spark, sf_dir))


@query
def global_completeness(spark, sf_dir):
    return R.global_completeness(people(spark, sf_dir))


@query
def field_frequency(spark, sf_dir):
    return R.field_frequency(mv.messages(spark, sf_dir, *mv.VIEWS))


@query
def first_hundred_fields(spark, sf_dir):
    """Fields of the hundred oldest messages, and the five oldest."""
    return R.first_fields(mv.messages(spark, sf_dir, *mv.VIEWS))


@query
def count_by_field(spark, sf_dir):
    return R.count_by_field(mv.messages(spark, sf_dir, *mv.VIEWS), "lang")


@query
def landing_stats(spark, sf_dir):
    kind = F.coalesce(typed.exact_kind(F.col("fields")), F.lit("unknown"))
    return R.count_by(mv.messages(spark, sf_dir, *mv.VIEWS), kind, "kind").orderBy(F.desc("n"), "kind")


@query
def topic_totals(spark, sf_dir):
    return R.topic_totals(R.end_offsets(mv.landed(spark, sf_dir)))


@query
def consumer_lag(spark, sf_dir):
    offsets = R.end_offsets(mv.landed(spark, sf_dir))
    done = (mv.landed(spark, sf_dir, "bank", "net").filter("not (topic = 'hr.net' and partition = 2)")
            .filter("offset % 100 < 90").groupBy("topic", "partition")
            .agg(F.count("*").alias("committed")))
    return R.consumer_lag(offsets, done)


@query
def consumer_lag_total(spark, sf_dir):
    offsets = R.end_offsets(mv.landed(spark, sf_dir))
    done = mv.landed(spark, sf_dir, "bank").groupBy("topic", "partition").agg(F.count("*").alias("committed"))
    return R.total_lag(R.consumer_lag(offsets, done))


@query
def first_rows(spark, sf_dir):
    return L.first_rows(mv.landed(spark, sf_dir), 50).select("raw_id", micros("ts").alias("ts_us"))


@query
def sample_messages(spark, sf_dir):
    """Two messages of each exact kind."""
    rows = mv.messages(spark, sf_dir, *mv.VIEWS).select(
        F.coalesce(typed.exact_kind(F.col("fields")), F.lit("unknown")).alias("kind"), "raw_id", *L.COORDS)
    return L.per_key_sample(rows, ["kind"], L.COORDS, 2).select("kind", "raw_id")


@query
def strict_parse(spark, sf_dir):
    """Every message parsed by the reader that stops at the first bad body."""
    rows = mv.landed(spark, sf_dir, *mv.VIEWS).select("topic", F.size(strict_fields(F.col("payload"))).alias("n"))
    return rows.groupBy("topic").agg(F.count("*").alias("n"), F.sum("n").cast("long").alias("fields"))


@query
def stage_reconciliation(spark, sf_dir):
    rows = mv.landed(spark, sf_dir)
    return R.stage_reconciliation(rows, rows.filter("not (partition = 1 and offset % 10 = 3)"))


@query
def progress_snapshots(spark, sf_dir):
    days = mv.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("processed"), F.sum("event_id").alias("pending"))
    shots = days.select(F.lit("events").alias("pipeline"), F.col("day").cast("timestamp").alias("ts"),
                        "processed", "pending")
    return R.progress(shots).select(
        F.col("ts").cast("date").cast("string").alias("day"), "processed", "delta",
        F.round("speed", 9).alias("speed"), F.round("eta_seconds", 3).alias("eta_seconds"))


@query
def latest_rows(spark, sf_dir):
    return L.latest(mv.landed(spark, sf_dir), 50).select("raw_id", micros("ts").alias("ts_us"))


@query
def sample_profiles(spark, sf_dir):
    rows = people(spark, sf_dir).select(F.size("types_received").cast("long").alias("kinds"), "grouping_key")
    return L.per_key_sample(rows, ["kinds"], ["grouping_key"], 2).select("kinds", "grouping_key")


@query
def find_by_identifier(spark, sf_dir):
    return flat(R.find_by_identifier(people(spark, sf_dir), "passport", "p7"))


@query
def nonempty_blocks(spark, sf_dir):
    return R.nonempty_blocks(people(spark, sf_dir), "net").select("grouping_key")


# --- streams ------------------------------------------------------------------------

def _as_files(spark: SparkSession, records: DataFrame, files: int) -> str:
    path = f"{scratch_dir(spark)}/records-{uuid.uuid4().hex}"
    records.repartition(files, "topic", "partition", "offset").write.parquet(path)
    return path


def _stream(spark: SparkSession, records: DataFrame, batches: int = 1) -> DataFrame:
    """Records as a stream of at most ``batches`` batches, each of a file for each core, so that no task reads a batch alone."""
    cores = spark.sparkContext.defaultParallelism
    return file_stream(spark, _as_files(spark, records, batches * cores), cores)


def _root(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"


@query
def stream_landing(spark, sf_dir):
    records, root = _broken(spark, sf_dir), _root(spark)
    stream = file_stream(spark, _as_files(spark, records.unionByName(records.filter("offset % 3 = 0")), 4), 2)
    SL.landing_query(stream, root, f"{root}/checkpoint").awaitTermination()
    return SL.landed(spark, root).groupBy("topic", "partition").agg(
        F.count("*").alias("n"), F.sum("offset").alias("offset_sum"))


@query
def stream_kind_counts(spark, sf_dir):
    records = mv.envelopes(spark, sf_dir).select(*[c.split()[0] for c in ENVELOPE.split(", ")])
    root = _root(spark)
    SL.kind_counts_query(file_stream(spark, _as_files(spark, records, 4), 2), root, f"{root}/checkpoint").awaitTermination()
    return SL.latest_kind_counts(spark, root)


@query
def stream_profiles(spark, sf_dir):
    root = _root(spark)
    stream = _stream(spark, mv.envelopes(spark, sf_dir, *PEOPLE), 2)
    store = ProfileStore(spark, f"{root}/store")
    profile_query(stream, store, f"{root}/checkpoint").awaitTermination()
    return flat(store.profiles())


@query
def stream_kind_sets(spark, sf_dir):
    """Reports kept up by the changes of three batches, of which later ones merge and complete profiles of earlier ones."""
    root = _root(spark)
    store = ProfileStore(spark, f"{root}/store")
    for i, view in enumerate(("net", "personal", "bank")):
        stream = _stream(spark, mv.envelopes(spark, sf_dir, view))
        profile_query(stream, store, f"{root}/checkpoint{i}").awaitTermination()
    return R.kind_set_reports(store.kind_sets())


@query
def landing_expiry(spark, sf_dir):
    """A landed month after all but its last ten whole days have been deleted: rows a day, and folders that went."""
    root = _root(spark)
    SL.landing_query(file_stream(spark, _as_files(spark, _broken(spark, sf_dir), 2), 1), root, f"{root}/checkpoint").awaitTermination()
    SL.expire_behind(spark, root, 10)
    kept = [df.select("day", F.lit(state).alias("state")) for df, state in ((SL.landed(spark, root), "landed"), (SL.dead(spark, root), "dead"))]
    return kept[0].unionByName(kept[1]).groupBy(F.col("day").cast("string").alias("day"), "state").agg(F.count("*").alias("n"))


@query
def stream_progress(spark, sf_dir):
    """Progress rows of a landing stream, saved by its listener: batches, rows, what is pending of all events."""
    root, records = _root(spark), mv.envelopes(spark, sf_dir, "net")
    progress = ProgressTable(spark, f"{root}/progress")
    spark.streams.addListener(progress)
    try:
        stream = file_stream(spark, _as_files(spark, records.filter("offset % 4 < 3"), 3), 1)
        progress.finish(SL.landing_query(stream, root, f"{root}/checkpoint"))
    finally:
        spark.streams.removeListener(progress)
    left = remaining(progress_rows(spark, f"{root}/progress"), records.count())
    return left.select("batches", "rows", "pending", ((F.col("rate") > 0) & (F.col("eta_seconds") > 0)).alias("timed"))


@query
def stream_landing_replay(spark, sf_dir):
    """The topic read again under a new checkpoint, with other bodies: what landed first stays, once."""
    root, records = _root(spark), _broken(spark, sf_dir)
    again = records.withColumn("value", F.when(F.col("offset") % 50 == 0, F.lit("{still broken").cast("binary")).otherwise(
        F.when((F.col("offset") % 50).isin(10, 20, 30), F.col("value")).otherwise(F.lit('{"again":true}').cast("binary"))))
    half = records.filter("offset % 2 = 0")
    for i, rows in enumerate((half, again.filter("offset % 2 = 0").unionByName(records.filter("offset % 2 = 1")))):
        SL.landing_query(file_stream(spark, _as_files(spark, rows, 2), 1), root, f"{root}/checkpoint{i}").awaitTermination()
    counted = [SL.landed(spark, root).select("topic", "partition", "offset", F.lit("landed").alias("state"),
                                             F.contains("payload", F.lit("again")).cast("long").alias("changed")),
               SL.dead(spark, root).select("topic", "partition", "offset", F.lit("dead").alias("state"),
                                           F.contains(F.col("value").cast("string"), F.lit("still")).cast("long").alias("changed"))]
    return counted[0].unionByName(counted[1]).groupBy("topic", "partition", "state").agg(
        F.count("*").alias("n"), F.sum("offset").alias("offset_sum"), F.sum("changed").alias("changed"))


@query
def stream_counts_replay(spark, sf_dir):
    """Counts of a stream started anew replace those of the earlier stream."""
    records = mv.envelopes(spark, sf_dir).select(*[c.split()[0] for c in ENVELOPE.split(", ")])
    root = _root(spark)
    for i, rows in enumerate((records.filter("offset % 2 = 0"), records)):
        SL.kind_counts_query(file_stream(spark, _as_files(spark, rows, 2), 1), root, f"{root}/checkpoint{i}").awaitTermination()
    return SL.latest_kind_counts(spark, root)


@query
def stream_profiles_two_sources(spark, sf_dir):
    """Two streams, each with its own checkpoint, fold into one store."""
    root = _root(spark)
    store = ProfileStore(spark, f"{root}/store")
    for i, views in enumerate((("net", "bank"), ("personal",))):
        stream = _stream(spark, mv.envelopes(spark, sf_dir, *views))
        profile_query(stream, store, f"{root}/checkpoint{i}").awaitTermination()
    return flat(store.profiles())


def _late_exports(spark: SparkSession, sf_dir: str) -> tuple[str, list[DataFrame]]:
    """A store fed and exported twice; bank messages of odd passports come with the second batch. The persons after each."""
    root, config = _root(spark), Config(required_kinds=["personal", "bank"])
    store, people = ProfileStore(spark, f"{root}/store", config), []
    bank = mv.envelopes(spark, sf_dir, "bank")
    odd = F.get_json_object(F.col("value").cast("string"), "$.passport").rlike("[13579] $")
    for i, rows in enumerate((mv.envelopes(spark, sf_dir, "personal").unionByName(bank.filter(~odd)), bank.filter(odd))):
        profile_query(_stream(spark, rows), store, f"{root}/checkpoint{i}").awaitTermination()
        P.publish_changes(store, f"{root}/tables", _as_of(), config)
        people.append(written(table(spark, f"{root}/tables/persons"), "persons"))
    return root, people


@query
def publish_late_profiles(spark, sf_dir):
    """Profiles that messages older than the last export complete are published by the next one, each once."""
    _, people = _late_exports(spark, sf_dir)
    first = people[0].select("grouping_key", F.lit(0).cast("long").alias("export"))
    return people[1].join(shuffled(first), "grouping_key", "left").select("grouping_key", F.coalesce("export", F.lit(1).cast("long")).alias("export"))


@query
def export_counters(spark, sf_dir):
    """What two exports counted while they ran: profiles changed and published, rows for each table."""
    root, _ = _late_exports(spark, sf_dir)
    return counters(spark, f"{root}/tables", *P.EXPORTED).select(
        F.col("batch").alias("export"), "changed", "published", "persons", *V.CHILD_TABLES.values(),
        ((F.col("seconds") > 0) & (F.col("rate") > 0)).alias("timed"))


@query
def stream_landing_counters(spark, sf_dir):
    """What the batches of a landing stream counted while they ran, summed."""
    records, root = _broken(spark, sf_dir), _root(spark)
    stream = file_stream(spark, _as_files(spark, records.unionByName(records.filter("offset % 3 = 0")), 4), 2)
    SL.landing_query(stream, root, f"{root}/checkpoint").awaitTermination()
    whole = summed(counters(spark, root, *SL.COUNTED), *SL.COUNTED)
    return whole.select("batches", *SL.COUNTED, (F.col("consumed") - F.col("errors") - F.col("landed")).alias("duplicates"),
                        ((F.col("seconds") > 0) & (F.col("rate") > 0)).alias("timed"))


@query
def stream_profile_counters(spark, sf_dir):
    """What two batches of a profile stream counted while they ran: messages, errors, upserts, groups merged away."""
    root = _root(spark)
    store = ProfileStore(spark, f"{root}/store")
    for i, rows in enumerate((_broken(spark, sf_dir), mv.envelopes(spark, sf_dir, "personal"))):
        profile_query(_stream(spark, rows), store, f"{root}/checkpoint{i}").awaitTermination()
    return counters(spark, store.root, *FOLDED).select(
        "batch", "consumed", "errors", "read", "upserts", "merges", *V.KINDS, "skipped_unknown", "skipped_empty",
        ((F.col("seconds") > 0) & (F.col("rate") > 0)).alias("timed"))
