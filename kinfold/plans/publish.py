"""Publishing: incremental export of complete profiles to person and child tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.config import Config
from kinfold.functions.fields import is_object, json_of, let
from kinfold.functions.text import as_timestamp, column_name
from kinfold.operators.counters import Counters
from kinfold.operators.fold import complete
from kinfold.operators.upsert import COALESCE_NEW, newest_per_key, upsert
from kinfold.plans.tables import merge_into
from kinfold.plans.wide import item_text, wide_rows
from kinfold.session import exists, scratch, side_by_side, written
from kinfold.streaming.profiles import ProfileStore
from kinfold.streaming.store import stored


def gate(profiles: DataFrame, required: list[str] = V.KINDS) -> DataFrame:
    """Profiles that received every required kind."""
    return profiles.filter(complete(F.col("types_received"), required))


def after(since_ts, since_id: str | None, skew_seconds: int = 0,
          ts: str = "updated_at", key: str = "grouping_key") -> Column:
    """Rows behind a checkpoint in (ts, key) order.

    A skew moves the time back and drops the tie-break; without a usable key the whole instant is read again.
    """
    if since_ts is None:
        return F.lit(True)
    start = F.lit(since_ts) if isinstance(since_ts, int) else F.lit(since_ts).cast("timestamp")
    if skew_seconds:
        return F.col(ts) >= start - F.make_dt_interval(secs=F.lit(skew_seconds))
    if not since_id:
        return F.col(ts) >= start
    return (F.col(ts) > start) | ((F.col(ts) == start) & (F.col(key) > since_id))


def export_batch(profiles: DataFrame, since_ts=None, since_id: str | None = None,
                 config: Config = Config(), limit: int | None = None, gated: bool = True) -> DataFrame:
    """Next batch in (updated_at, grouping_key) order: a filter and a top-k, no full sort."""
    rows = gate(profiles, config.required_kinds) if gated else profiles
    return (rows.filter(after(since_ts, since_id, config.skew_seconds))
            .orderBy("updated_at", "grouping_key").limit(limit or config.batch_rows))


def gate_counts(batch: DataFrame, required: list[str] = V.KINDS) -> DataFrame:
    passed = complete(F.col("types_received"), required)
    return batch.agg(F.count_if(passed).alias("passed"), F.count_if(~passed).alias("skipped"))


def checkpoint_of(batch: DataFrame) -> DataFrame:
    """One row: the last (ts, key) of a batch. Taken from all rows read, so skipped rows never stall it."""
    last = batch.agg(F.max(F.struct("updated_at", "grouping_key")).alias("last"))
    return last.select(F.col("last.updated_at").alias("ts"), F.col("last.grouping_key").alias("last_id"))


def _path(df: DataFrame, path: str) -> Column | None:
    """Column or struct field when the frame has it."""
    schema = df.schema
    for part in path.split("."):
        if not hasattr(schema, "fieldNames") or part not in schema.fieldNames():
            return None
        schema = schema[part].dataType
    return F.col(path)


def _text(column: Column) -> Column:
    return F.nullif(column.cast("string"), F.lit(""))


def _first_of(df: DataFrame, *paths: str) -> Column:
    found = [_text(c) for c in (_path(df, p) for p in paths) if c is not None]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def publish_key(df: DataFrame) -> Column:
    """First non-empty of the key columns."""
    return _first_of(df, "_grouping_key", "grouping_key", "id", "_id")


def composed_key(df: DataFrame) -> Column:
    """Stored key, else a key composed from identifiers (tax id and social security included), else the row id."""
    stored = _first_of(df, "_grouping_key", "grouping_key")
    prefixes = {"passport": "passport", "email": "email", "phone": "phone", "tax_id": "tax", "ssn": "ssn"}
    made = [F.concat(F.lit(f"{p}::"), identifier(df, i)) for i, p in prefixes.items()]
    return F.coalesce(stored, *made, _first_of(df, "_id"))


def identifier(df: DataFrame, name: str) -> Column:
    return _first_of(df, f"identifiers.{name}", name, f"personal.{name}")


def payload(df: DataFrame, kind: str) -> Column:
    """Block of a kind: from ``data``, else ``payloads``, else a top-level column."""
    found = [c for c in (_path(df, p) for p in (f"data.{kind}", f"payloads.{kind}", kind)) if c is not None]
    return F.coalesce(*found)


def _with_times(df: DataFrame, as_of: Column) -> DataFrame:
    """Times as timestamps, from ISO text as well; what is missing or no time is filled."""
    created, updated = (as_timestamp(F.col(c)) if kind == "string" else F.col(c)
                        for c, kind in ((c, dict(df.dtypes)[c]) for c in ("created_at", "updated_at")))
    updated = F.coalesce(updated, as_of.cast("timestamp"))
    return df.withColumns({"created_at": F.coalesce(created, updated), "updated_at": updated})


def persons(profiles: DataFrame, as_of: Column, composed: bool = False) -> DataFrame:
    """Person rows; a missing update time becomes ``as_of``, a missing creation time the update time."""
    df = _with_times(profiles, as_of)
    key = composed_key(df) if composed else publish_key(df)
    return df.select(key.alias("grouping_key"), *[identifier(df, i).alias(i) for i in V.IDENTIFIERS],
                     "created_at", "updated_at").filter(F.col("grouping_key").isNotNull())


def has_content(value: Column) -> Column:
    """A payload with any leaf besides null, ``""``, ``{}`` and ``[]``; numbers and booleans count.

    Read from the compact JSON text, string by string: keys, empty strings and nulls go, another string
    leaves its closing quote. If nothing but punctuation of lists and objects is left, there is no leaf.
    """
    leaf = F.regexp_replace(json_of(value), r'"(?:[^"\\]|\\.)*"\s*:|""|null|"(?:[^"\\]|\\.)+(")', "$1")
    return F.coalesce(leaf.rlike(r"[^\[\]{},\s]"), F.lit(False))


def children(profiles: DataFrame, as_of: Column) -> DataFrame:
    """``kind, grouping_key, data, updated_at``: one row per non-empty block, all kinds in one pass."""
    df = _with_times(profiles, as_of)
    key = publish_key(df)
    blocks = F.array(*[F.struct(F.lit(k).alias("kind"), payload(df, k).alias("block")) for k in V.KINDS])
    rows = df.select(key.alias("grouping_key"), "updated_at", F.inline(blocks))
    return (rows.filter(F.col("grouping_key").isNotNull() & has_content(F.col("block")))
            .select("kind", "grouping_key", F.to_json("block").alias("data"), "updated_at"))


def flat_pairs(block: Column, parent: Column | None = None, depth: int = 3) -> Column:
    """``array<struct<name, value>>`` of a nested block: keys joined and cleaned, lists as text, nulls dropped.

    ``depth`` is how many levels of objects lie within the block's values; ``plans.wide`` needs no such bound.
    """
    def pair(e: Column) -> Column:
        raw = e["key"] if parent is None else F.concat(parent, F.lit("__"), e["key"])

        def rows(name: Column) -> Column:
            value = e["value"]
            listed = F.array_join(F.transform(value.cast("array<variant>"), item_text), ",").cast("variant")
            one = F.array(F.struct(name.alias("name"), F.when(
                F.schema_of_variant(value).startswith("ARRAY"), listed).otherwise(value).alias("value")))
            nothing = F.filter(one, lambda _: F.lit(False))
            inner = flat_pairs(value.cast("map<string,variant>"), name, depth - 1) if depth else one
            return F.when(F.is_variant_null(value), nothing).when(is_object(value), inner).otherwise(one)
        return let(column_name(raw), rows)
    return F.flatten(F.transform(F.map_entries(block), pair))


def wide_children(profiles: DataFrame, kind: str) -> DataFrame:
    """One typed column per field of the kind's blocks, person key and times in front."""
    return wide_rows(profiles.filter(F.size(payload(profiles, kind)) > 0).select(
        publish_key(profiles).alias("grouping_key"), "created_at", "updated_at", payload(profiles, kind).alias("block")))


def export_metrics(profiles: DataFrame, as_of: Column) -> DataFrame:
    """Rows per published table and the newest update."""
    df = _with_times(profiles, as_of).filter(publish_key(profiles).isNotNull())
    filled = [F.when(has_content(payload(df, k)), k) for k in V.KINDS]
    names = F.filter(F.array(F.lit("persons"), *filled), lambda n: n.isNotNull())
    return df.select("updated_at", F.explode(names).alias("table")).groupBy("table").agg(
        F.count("*").alias("rows"), F.max("updated_at").alias("max_ts"))


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], like.schema)


def tables_of(ready: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Rows of the person table and of each child table."""
    tables = {"persons": newest_per_key(persons(ready, as_of), "grouping_key", ["updated_at"])}
    kids = written(children(ready, as_of), "children")
    for kind, name in V.CHILD_TABLES.items():
        rows = kids.filter(F.col("kind") == kind).drop("kind")
        tables[name] = newest_per_key(rows, "grouping_key", ["updated_at"])
    return tables


def wide_tables_of(ready: DataFrame, as_of: Column) -> dict[str, Callable[[], DataFrame]]:
    """What makes the rows of the person table and of each child table with a column for each field."""
    def people() -> DataFrame:
        return newest_per_key(persons(ready, as_of, composed=True), "grouping_key", ["updated_at"])
    return {"persons": people} | {name: partial(wide_children, ready, kind) for kind, name in V.CHILD_TABLES.items()}


def publish(profiles: DataFrame, root: str, version: int, as_of: Column, previous: int | None = None,
            config: Config = Config(), policy: str = "replace") -> None:
    """Write version ``version`` of all tables under ``root``: the previous one with ``profiles`` merged in.

    A version is written to its own folder, never over the one being read, so a lost job can simply
    run again. Parquet has no row updates; a JDBC target takes the same rows as a staging table.
    """
    spark = profiles.sparkSession
    ready = written(gate(profiles, config.required_kinds), "export")
    for name, rows in tables_of(ready, as_of).items():
        old = _stored(spark, f"{root}/version={previous}/{name}", rows)
        keep = ("created_at",) if name == "persons" else ()
        upsert(old, rows, "grouping_key", policy, keep_first=keep).write.mode("overwrite").parquet(
            f"{root}/version={version}/{name}")


CHECKPOINT = "change long, last_id string, version int"


def load_checkpoint(spark: SparkSession, root: str) -> tuple:
    """``(version, change, last_id)`` of the newest finished export; version -1 before the first."""
    last = stored(spark, f"{root}/state", CHECKPOINT).orderBy(F.desc("version")).first()
    return (-1, None, None) if last is None else (last["version"], last["change"], last["last_id"])


def publish_next(profiles: DataFrame, root: str, as_of: Column, config: Config = Config()) -> int | None:
    """Publish all complete profiles that changed behind the checkpoint, then move it; None when there are none.

    ``profiles`` has ``version``, a number that grows with every change the profile store makes, so a profile that late
    messages complete is published as surely as any other. Tables first, checkpoint last: a job
    lost in between publishes the same rows again, which the upsert makes harmless. The whole backlog goes
    in one batch, since each version rewrites its tables.
    """
    spark = profiles.sparkSession
    version, change, last_id = load_checkpoint(spark, root)
    with scratch(spark):
        pending = gate(profiles, config.required_kinds).filter(after(change, last_id, ts="version"))
        batch = written(pending, "pending")
        if batch.isEmpty():
            return None
        publish(batch, root, version + 1, as_of, version, config)
        last = batch.agg(F.max(F.struct("version", "grouping_key")).alias("last"))
        (last.select(F.col("last.version").alias("change"), F.col("last.grouping_key").alias("last_id")).coalesce(1)
         .write.mode("overwrite").parquet(f"{root}/state/version={version + 1}"))
    return version + 1


def publish_wide(profiles: DataFrame, root: str, version: int, as_of: Column, previous: int | None = None,
                 config: Config = Config()) -> None:
    """Write version ``version`` of the person table, never blanking what is stored, and of all wide child tables."""
    spark = profiles.sparkSession
    with scratch(spark):
        ready = written(_with_times(gate(profiles, config.required_kinds), as_of), "export")
        for name, make in wide_tables_of(ready, as_of).items():
            rows = make()
            old = _stored(spark, f"{root}/version={previous}/{name}", rows)
            merge = upsert_persons_keep if name == "persons" else upsert_children_wide
            merge(old, rows).write.mode("overwrite").parquet(f"{root}/version={version}/{name}")


def upsert_children_wide(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Fields a person's block has replace the stored ones, and those it lacks stay; so does the first creation time.

    Columns new to the table are added, and a column whose field changed its type is widened.
    """
    return upsert(stored, rows, "person_id", COALESCE_NEW)


def upsert_persons_keep(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Person rows merged without ever blanking a stored identifier."""
    return upsert(stored, rows, "grouping_key", COALESCE_NEW)


#: What an export counts: profiles that changed and those of them it published, buckets it rewrote, rows for each table.
EXPORTED = ["changed", "published", "buckets", "persons", *V.CHILD_TABLES.values()]


def publish_changes(store: ProfileStore, root: str, as_of: Column, config: Config = Config()) -> int | None:
    """Merge all complete profiles that changed behind the checkpoint into the tables under ``root``, then move it.

    A batch writes the whole state of each profile it touches, so the folders of later batches hold all there is to
    publish: nothing older is read, and a profile that is complete by now has a state there. Of each table only
    the buckets of those profiles are rewritten. Tables come first, the checkpoint last: a job lost in between publishes the
    same rows again, which the upsert makes harmless. The number of the export, None when nothing changed.
    """
    spark, counted = store.spark, Counters()
    export, upto, _ = load_checkpoint(spark, root)
    with scratch(spark):
        changed = counted.watch(store.changes(upto), changed=F.count("*"), upto=F.max("version"))
        ready = written(counted.watch(gate(changed, config.required_kinds), published=F.count("*")), "pending")
        totals = counted.totals()
        if not totals["changed"]:
            return None
        def merged(name: str, rows: DataFrame) -> int:
            return merge_into(counted.watch(rows, **{name: F.count("*")}), f"{root}/{name}", "grouping_key", config.key_buckets,
                              keep_first=("created_at",) if name == "persons" else ())
        counted.add(buckets=sum(side_by_side([partial(merged, *t) for t in tables_of(ready, as_of).items()])))
    counted.save(spark, root, export + 1, *EXPORTED)
    state = spark.createDataFrame([(totals["upto"], None)], "change long, last_id string")
    state.coalesce(1).write.mode("overwrite").parquet(f"{root}/state/version={export + 1}")
    return export + 1


def export_wide(profiles: DataFrame, root: str, as_of: Column, config: Config = Config()) -> Counters:
    """Merge complete profiles into the wide tables under ``root``, of which only their buckets are rewritten.

    A field whose type changed widens its column, in all files of its table.
    """
    spark, counted = profiles.sparkSession, Counters()
    with scratch(spark):
        ready = written(_with_times(counted.watch(
            gate(profiles, config.required_kinds), published=F.count("*")), as_of), "export")

        def merged(name: str, make: Callable[[], DataFrame]) -> int:
            return merge_into(counted.watch(make(), **{name: F.count("*")}), f"{root}/{name}",
                              "grouping_key" if name == "persons" else "person_id", config.key_buckets, COALESCE_NEW)
        counted.add(buckets=sum(side_by_side([partial(merged, *t) for t in wide_tables_of(ready, as_of).items()])))
    return counted
