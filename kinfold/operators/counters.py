"""Counts of a job, taken by the job itself while its rows pass: no second scan, no extra job."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F



class Counters:
    """Observed aggregates and given numbers of one batch, with the seconds since it was made.

    Each ``watch`` belongs to the first action that runs its rows. The totals are ready once those actions are done.
    """

    def __init__(self) -> None:
        self._started = time.monotonic()
        self._seen: list[tuple[Observation, list[str]]] = []
        self._known: dict[str, int] = {}

    def watch(self, rows: DataFrame, **aggregates: Column) -> DataFrame:
        """``rows`` unchanged; their aggregates become totals of these names, added where a name is watched twice."""
        seen = Observation()
        self._seen.append((seen, list(aggregates)))
        return rows.observe(seen, *[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in aggregates.items()])

    def add(self, **numbers: int) -> None:
        """Numbers that the job knows already."""
        for name, n in numbers.items():
            self._known[name] = self._known.get(name, 0) + n

    def totals(self) -> dict[str, int]:
        """Rows that a plan turned out not to need, as those of an empty table, count as none."""
        out = dict(self._known)
        for seen, names in self._seen:
            found = seen.get
            for name in names:
                out[name] = out.get(name, 0) + (found.get(name) or 0)
        return out

    def save(self, spark: SparkSession, root: str, batch: int, *names: str) -> None:
        """Write the totals of ``names`` and the seconds as the row of ``batch``; a batch that runs again replaces its row."""
        totals = self.totals()
        row = [(*[int(totals.get(n, 0)) for n in names], time.monotonic() - self._started)]
        schema = ", ".join([*[f"{n} long" for n in names], "seconds double"])
        spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").parquet(f"{root}/counters/batch={batch}")


def counters(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """The saved rows ``(batch, names, seconds, rate)``; the rate is the first of ``names`` per second."""
    schema = ", ".join([*[f"{n} long" for n in names], "seconds double", "batch long"])
    rows = spark.read.schema(schema).parquet(f"{root}/counters")
    return rows.select("batch", *names, "seconds", F.try_divide(F.col(names[0]), F.col("seconds")).alias("rate"))


def summed(rows: DataFrame, *names: str) -> DataFrame:
    """All batches as one row: sums, seconds, and the rate over all of their time."""
    whole = rows.agg(F.count("*").alias("batches"), *[F.sum(n).alias(n) for n in names], F.sum("seconds").alias("seconds"))
    return whole.withColumn("rate", F.try_divide(F.col(names[0]), F.col("seconds")))
