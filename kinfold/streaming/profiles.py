"""Incremental profiles: each batch merges into the profiles it touches, and only those.

The store is two append-only tables with one folder per batch, numbered by the store itself, so that any
number of streams can fold into it one after the other. ``states`` holds the new state of
every touched profile, and a tombstone for a key that was merged away; ``index`` maps a token to
the key of its profile. Readers take the newest row per key or token. A batch writes only its own
folders and reads only earlier ones, so running it again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.config import Config
from kinfold.operators.components import components
from kinfold.operators.counters import Counters
from kinfold.operators.derive import batch_counts
from kinfold.operators.fold import SLOTS, kinds_of, merge, profiles
from kinfold.operators.resolve import labelled, link_edges, token_set_states
from kinfold.operators.skew import lookup, shuffled
from kinfold.plans.extract import contribute
from kinfold.session import scratch, written
from kinfold.sources.envelope import decoded, good, spread
from kinfold.streaming.store import folder_number, stored, stream_id
from kinfold.vocabulary import KINDS

STATE = [*SLOTS, "best", "first_ts", "last_ts"]
#: What a batch counts: envelopes and those it could not read, then messages, upserts of blocks, profiles written and merged away.
FOLDED = ["consumed", "errors", "read", "upserts", "profiles", "merges", *KINDS, "skipped_unknown", "skipped_empty"]
#: Marks a stored profile as a vertex of the link graph; no token starts like this.
NODE = "~"


class ProfileStore:
    def __init__(self, spark: SparkSession, root: str, config: Config = Config()):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config

    def _compacted(self, before: int | None) -> int | None:
        """Last batch held by the newest finished compaction."""
        marks = stored(self.spark, f"{self.root}/compacted", "done boolean, upto int")
        marks = marks if before is None else marks.filter(F.col("upto") < before)
        return marks.agg(F.max("upto")).first()[0]

    def _exists(self, table: str) -> bool:
        return not stored(self.spark, f"{self.root}/{table}", "batch int").isEmpty()

    def _rows(self, table: str, before: int | None) -> DataFrame:
        """Rows of batches before ``before``; those a compaction holds come from it."""
        rows = self.spark.read.parquet(f"{self.root}/{table}")
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        upto = self._compacted(before)
        if upto is None:
            return rows
        base = self.spark.read.parquet(f"{self.root}/{table}_base").filter(F.col("upto") == upto)
        batch = F.col("changed").cast("int") if "changed" in base.columns else F.col("upto")
        base = base.withColumn("batch", batch).drop("upto", "changed")
        return rows.filter(F.col("batch") > upto).unionByName(base)

    def compact(self, upto: int) -> None:
        """Write the newest row per key and token of all batches up to ``upto`` to one place.

        The mark comes last, so readers never see half a compaction. Older folders are no longer
        read and can be removed by the storage's own retention.
        """
        live = self._newest_states(self._rows("states", upto + 1)).withColumn("gone", F.lit(False))
        live.withColumnRenamed("version", "changed").write.mode("overwrite").parquet(f"{self.root}/states_base/upto={upto}")
        index = self._rows("index", upto + 1).groupBy("token").agg(F.max_by("key", "batch").alias("key"))
        (index.sortWithinPartitions("token").write.mode("overwrite")
         .parquet(f"{self.root}/index_base/upto={upto}"))
        self.spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(
            f"{self.root}/compacted/upto={upto}")

    def _newest_states(self, rows: DataFrame) -> DataFrame:
        newest = rows.groupBy("key").agg(F.max_by(F.struct(*STATE, "gone", F.col("batch").cast("long").alias("version")),
                                                  F.col("batch")).alias("row"))
        return newest.select("key", "row.*").filter(~F.col("gone")).drop("gone")

    def current(self, before: int | None = None) -> DataFrame:
        """Live states by key, with the version that changed them last."""
        return self._newest_states(self._rows("states", before))

    def profiles(self) -> DataFrame:
        return profiles(self.current(), F.col("key"), "version")

    def changes(self, since: int | None) -> DataFrame:
        """Profiles that batches behind ``since`` changed, as they are now, from the folders of those batches alone."""
        rows = self._rows("states", None)
        return profiles(self._newest_states(rows if since is None else rows.filter(F.col("batch") > since)), F.col("key"), "version")

    def kind_sets(self) -> DataFrame:
        """``(kinds, n)``: profiles of each set of kinds, from the changes of all batches; no profile is read."""
        changes = stored(self.spark, f"{self.root}/kind_changes", "kinds array<string>, n long, batch long")
        return changes.groupBy("kinds").agg(F.sum("n").alias("n")).filter("n <> 0")

    def merge_batch(self, contributed: DataFrame, stream_batch: int, stream: str = "", counted: Counters | None = None) -> int:
        """Fold one batch of a stream into the store; the store's number of the batch is the version of its changes.

        What the batch did is counted while it runs, and kept as the batch's row of counters.
        """
        batch = folder_number(self.spark, self.root, stream, stream_batch)
        counted = counted or Counters()
        with scratch(self.spark):
            self._merge(counted.watch(contributed, **batch_counts()), batch, counted)
        counted.save(self.spark, self.root, batch, *FOLDED)
        return batch

    def _merge(self, contributed: DataFrame, batch: int, counted: Counters) -> None:
        fresh = written(token_set_states(contributed, self.config), "batch-states")
        edges = link_edges(fresh)
        tokens = (fresh.select(F.explode("tokens").alias("token"))
                  .filter(~F.col("token").startswith("key=rawid::")).distinct())
        old, has_history = None, batch > 0 and self._exists("index")
        if has_history:
            known = (self._rows("index", batch).join(shuffled(tokens), "token", "left_semi")
                     .groupBy("token").agg(F.max_by("key", "batch").alias("key")))
            touched = written(known, "touched")
            edges = edges.unionByName(touched.select(
                F.col("token").alias("u"), F.concat(F.lit(NODE), "key").alias("v")))
            keys = touched.select("key").distinct()
            old = self._newest_states(self._rows("states", batch).join(shuffled(keys), "key", "left_semi"))
        labels = components(edges, self.config)
        rows = labelled(fresh, labels, self.config).withColumn("old_key", F.lit(None).cast("string"))
        if old is not None:
            nodes = old.withColumn("tokens", F.array(F.concat(F.lit(NODE), "key")))
            rows = rows.unionByName(labelled(nodes.withColumnRenamed("key", "old_key").drop("version"), labels, self.config))
        rows = written(rows, "labelled")
        heads = merge(rows, "label").withColumn("key", F.coalesce(F.col("best")["key"], F.concat(F.lit("?"), "label")))
        heads = written(counted.watch(heads, profiles=F.count("*")), "heads")
        keys = heads.select("label", "key")
        share = self.config.hot_key_share
        moved = lookup(rows.filter("old_key is not null").select("label", "old_key"), keys, "label", share).filter(
            "old_key <> key").select("old_key", "key")
        moved = written(counted.watch(moved, merges=F.count("*")), "moved")
        signed = rows.filter("old_key is not null").withColumn("n", F.lit(-1)).select("best", "n", *SLOTS).unionByName(
            heads.withColumn("n", F.lit(1)).select("best", "n", *SLOTS))
        (signed.filter("best is not null").groupBy(F.array_sort(kinds_of()).alias("kinds")).agg(F.sum("n").alias("n"))
         .write.mode("overwrite").parquet(f"{self.root}/kind_changes/batch={batch}"))
        gone = moved.select(F.col("old_key").alias("key"), F.lit(True).alias("gone"))
        (heads.select("key", *STATE).withColumn("gone", F.lit(False))
         .unionByName(gone, allowMissingColumns=True)
         .write.mode("overwrite").parquet(f"{self.root}/states/batch={batch}"))
        own = (rows.filter("old_key is null").select("label", F.explode("tokens").alias("token"))
               .filter(~F.col("token").startswith("key=rawid::")).distinct())
        index = lookup(own, keys, "label", share).select("token", "key")
        if has_history and not moved.isEmpty():
            earlier = self._rows("index", batch).select("token", F.col("key").alias("old_key")).distinct()
            followers = lookup(earlier, moved, "old_key", share).filter("key is not null")
            index = index.unionByName(followers.select("token", "key"))
        (index.distinct().sortWithinPartitions("token")
         .write.mode("overwrite").parquet(f"{self.root}/index/batch={batch}"))


def profile_query(stream: DataFrame, store: ProfileStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Fold a stream of broker records into the store."""
    def fold(df: DataFrame, batch: int) -> None:
        counted = Counters()
        rows = counted.watch(decoded(spread(df)), consumed=F.count("*"), errors=F.count_if(F.col("fields").isNull()))
        store.merge_batch(contribute(good(rows), store.config), batch, stream_id(df.sparkSession), counted)
    return (stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
