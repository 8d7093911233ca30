"""Small message tables for golden cases."""

import json

from pyspark.sql import functions as F

from kinfold.operators.fold import exact_profiles
from kinfold.operators.resolve import resolved_profiles
from kinfold.plans.extract import contribute, extract
from kinfold.sources.envelope import ENVELOPE, messages

START = 1_700_000_000


def envelopes(spark, bodies, topic="hr"):
    """Broker records, one second apart, in one partition; bodies are text, bytes or objects."""
    rows = []
    for i, body in enumerate(bodies):
        raw = body if isinstance(body, bytes) else (body if isinstance(body, str) else json.dumps(body)).encode()
        rows.append((topic, 0, i, START + i, raw))
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, s long, value binary")
    return df.withColumn("timestamp", F.timestamp_seconds("s")).select(*[c.split()[0] for c in ENVELOPE.split(", ")])


def plain(value):
    """Row, map and variant values as plain Python."""
    if value is None:
        return None
    if hasattr(value, "toPython"):
        return value.toPython()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def by_offset(df):
    return {r["offset"]: {k: plain(v) for k, v in r.asDict().items()} for r in df.collect()}


def extracted(spark, bodies, **config):
    from kinfold.config import Config
    return by_offset(extract(messages(envelopes(spark, bodies)), Config(**config)))


def contributed(spark, bodies, **config):
    from kinfold.config import Config
    return contribute(messages(envelopes(spark, bodies)), Config(**config))


def profile_rows(df):
    out = {}
    for r in df.collect():
        out[r["grouping_key"]] = {
            "ids": {k: v for k, v in r["identifiers"].asDict().items() if v is not None},
            "data": {k: plain(v) for k, v in r["data"].asDict().items() if v is not None},
            "types": r["types_received"], "complete": r["is_complete"],
            "created": r["created_at"], "updated": r["updated_at"]}
    return out


def exact(spark, bodies, **config):
    from kinfold.config import Config
    return profile_rows(exact_profiles(contributed(spark, bodies, **config), Config(**config)))


def resolved(spark, bodies):
    return profile_rows(resolved_profiles(contributed(spark, bodies)))
