"""Published tables, one folder for each bucket of the key: an export rewrites only buckets it has rows for.

Merged rows are staged in the shared folder first and then replace their buckets by a dynamic partition
overwrite, so the plan that reads a table never writes it. A job lost in between merges the same rows again,
which changes nothing. A table has one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.upsert import REPLACE, merged_types, upsert
from kinfold.session import exists, written

#: Names of fields never begin with an underscore once they are cleaned.
BUCKET = "_bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def table(spark: SparkSession, path: str) -> DataFrame | None:
    """A published table with its ``_bucket``, or None before its first rows.

    Files written before a column came up lack it, so schemas are merged.
    """
    return spark.read.option("mergeSchema", True).parquet(path) if exists(spark, path) else None


def merge_into(rows: DataFrame, path: str, key: str, buckets: int, policy: str = REPLACE,
               keep_first: tuple[str, ...] = ("created_at",)) -> int:
    """Upsert ``rows``, one for each key, into the table at ``path``; the number of buckets that were rewritten.

    The buckets that ``rows`` fall into are read, merged and replaced; the others keep their files. A column that gets
    another type is another type in all files, so all buckets are rewritten then, as by ALTER TABLE. ``buckets`` stays
    what it was when the table was made.
    """
    spark = rows.sparkSession
    given = written(rows.filter(F.col(key).isNotNull()).withColumn(BUCKET, bucket_of(key, buckets)), "given")
    touched = [r[0] for r in given.select(BUCKET).distinct().collect()]  # at most ``buckets``
    if not touched:
        return 0
    old, merged = table(spark, path), given.drop(BUCKET)
    if old is not None:
        types = merged_types(old.drop(BUCKET), merged)
        same = all(types[c] == t for c, t in old.drop(BUCKET).dtypes)
        kept = old.filter(F.col(BUCKET).isin(touched)) if same else old
        touched = touched if same else range(buckets)
        merged = upsert(kept.drop(BUCKET), merged, key, policy, keep_first=keep_first)
    staged = written(merged.withColumn(BUCKET, bucket_of(key, buckets)), "merged")
    (staged.repartition(F.col(BUCKET)).sortWithinPartitions(BUCKET, key).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path))
    return len(touched)
