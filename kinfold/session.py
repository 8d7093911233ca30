"""Session settings and lineage cuts shared by all jobs."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runtime SQL settings the semantics rely on.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated key inside a nested object keeps its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

_local_scratch: str | None = None
_open: list[list[str]] = []


def per_context(build: Callable) -> Callable:
    """Build unresolved columns once per Spark application; they belong to no DataFrame.

    Large expressions take thousands of calls into the JVM, which would otherwise be paid per plan.
    """
    made: dict = {}

    @functools.wraps(build)
    def cached(*args):
        context = SparkContext._active_spark_context
        key = (context.applicationId if context else None, args)
        if key not in made:
            made[key] = build(*args)
        return made[key]
    return cached


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the results depend on; performance settings stay the caller's."""
    for key, value in SEMANTIC_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def computed_once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Add columns that later projections and filters use many times.

    A plain projection would be merged into its consumers and evaluated once per use, filters
    included. A generator over a one-element array is a boundary the optimizer keeps.
    """
    made = df.select(*keep, *[c.alias(n) for n, c in columns.items()])
    return made.select(*keep, F.inline(F.array(F.struct(*columns))))


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the one the cluster names, else (local runs only) our own."""
    global _local_scratch
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="kinfold-")
    return _local_scratch


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the ``scratch`` it is asked for in."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan is computed once, its lineage is cut, and a lost executor costs only a re-read.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(jobs: list[Callable[[], int]]) -> list[int]:
    """Results of independent jobs that the driver submits at once; Spark fills the cores that one of them leaves idle."""
    with ThreadPoolExecutor(max(1, len(jobs))) as threads:
        return list(threads.map(lambda job: job(), jobs))


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store."""
    store, place = _place(spark, path)
    return store.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever store holds it."""
    store, place = _place(spark, path)
    store.delete(place, True)


@contextlib.contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Add what ``written`` writes inside to ``paths``, for the caller to delete."""
    _open.append(paths)
    try:
        yield
    finally:
        _open.pop()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``written`` wrote inside; results must have been stored elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)
