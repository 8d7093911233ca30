"""Landed messages to extracted and contributed rows: one narrow stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.config import Config
from kinfold.functions.fields import JOINT, joined, keys, norms, pairs, strings, texts
from kinfold.operators.blocks import alias_block, alias_hits, filled, pattern_hits
from kinfold.operators.classify import score, winner
from kinfold.operators.derive import contribution_columns, source_columns
from kinfold.operators.identifiers import grouping_key, id_columns, identifiers, name_birth_key, tokens
from kinfold.session import computed_once, per_context

COORDINATES = ["topic", "partition", "offset", "ts", "raw_id"]
IDS = [f"id_{name}" for name in V.IDENTIFIERS]
#: The field stream: lists by place.
STREAM = ["keys", "texts", "norms", "values"]
#: What the patterns found in a message, as columns ``hit_<field>``.
HITS = ["iban", "swift", "ipv4", "ipv6"]


@per_context
def _pair_columns() -> dict[str, Column]:
    """Lists are written with a bracket, line breaks inside strings with a backslash."""
    return {"pairs": pairs(F.col("payload"), F.col("fields")), "has_lists": F.contains("payload", F.lit("[")),
            "has_escapes": F.contains("payload", F.lit("\\"))}


@per_context
def _stream_columns() -> dict[str, Column]:
    values = F.col("pairs")["value"]
    return {"keys": keys(F.col("pairs")["key"]), "texts": texts(values), "values": values}


@per_context
def _norm_columns() -> dict[str, Column]:
    return {"norms": norms(F.col("keys"), F.col("texts"))}


@per_context
def _text_columns(scan_metadata: bool) -> dict[str, Column]:
    scanned, escapes = strings(F.col("has_lists"), F.col("texts"), F.col("values")), F.col("has_escapes")
    if scan_metadata:
        scanned = F.concat(scanned, F.array("raw_id", "topic"))
        escapes = escapes | F.contains(F.concat("raw_id", "topic"), F.lit(JOINT))
    return {"strings": scanned, "has_breaks": escapes, **_norm_columns(),
            **{f"h_{k}": alias_hits(F.col("keys"), k) for k in V.KINDS}}


@per_context
def _joined_columns() -> dict[str, Column]:
    return {"joined": joined(F.col("strings"))}


@per_context
def _identifier_columns() -> dict[str, Column]:
    found = {f"id_{name}": c for name, c in identifiers(F.col("keys"), F.col("norms")).items()}
    return {**found, "name_birth": name_birth_key(F.col("keys"), F.col("norms"))}


@per_context
def _block_columns() -> dict[str, Column]:
    stream = [F.col(name) for name in STREAM]
    blocks = {f"a_{k}": alias_block(F.col(f"h_{k}"), *stream, k) for k in V.KINDS}
    hits = {f"hit_{name}": c for name, c in pattern_hits(F.col("strings"), F.col("joined")).items()}
    return {**blocks, **hits, **_identifier_columns(), "lowered": F.lower("joined"),
            "plain": ~F.col("has_breaks") & (F.octet_length("joined") == F.char_length("joined"))}


@per_context
def _score_columns() -> dict[str, Column]:
    words, text, lowered = F.col("strings"), F.col("joined"), F.col("lowered")
    hits = {name: F.col(f"hit_{name}") for name in HITS}
    blocks = {k: filled(k, F.col(f"a_{k}"), hits) for k in V.KINDS}
    scores = {f"s_{k}": score(k, blocks[k], words, text, lowered, F.col("plain"), hits) for k in V.KINDS}
    return {**{f"b_{k}": blocks[k] for k in V.KINDS}, **scores}


@per_context
def _key_columns() -> dict[str, Column]:
    ids, name_birth, row = id_columns(), F.col("name_birth"), F.col("raw_id")
    return {"proposed_key": grouping_key(ids, name_birth, row), "tokens": tokens(ids, name_birth, row)}


@per_context
def _kind_columns() -> dict[str, Column]:
    return {"kind": winner({k: F.col(f"s_{k}") for k in V.KINDS}), **_key_columns(), **source_columns()}


@per_context
def _contribution_columns() -> dict[str, Column]:
    return contribution_columns()


def field_streams(messages: DataFrame) -> DataFrame:
    """``messages(topic, partition, offset, ts, raw_id, payload, fields)`` to ``keys``, ``texts`` and ``values`` by place."""
    paired = computed_once(messages, COORDINATES, **_pair_columns())
    return computed_once(paired, [*COORDINATES, "has_lists", "has_escapes"], **_stream_columns())


def keyed(messages: DataFrame) -> DataFrame:
    """Identifiers, proposed key and link tokens only (no blocks)."""
    scanned = computed_once(field_streams(messages), [*COORDINATES, "keys"], **_norm_columns())
    made = computed_once(scanned, COORDINATES, **_identifier_columns())
    return computed_once(made, [*COORDINATES, *IDS], **_key_columns())


def texts_of(messages: DataFrame, config: Config = Config()) -> DataFrame:
    """Field stream, its strings, and the strings joined."""
    scanned = computed_once(field_streams(messages), [*COORDINATES, "keys", "texts", "values"],
                            **_text_columns(config.scan_metadata))
    return computed_once(scanned, [*COORDINATES, "strings", "has_breaks", *STREAM, *[f"h_{k}" for k in V.KINDS]], **_joined_columns())


def extract(messages: DataFrame, config: Config = Config()) -> DataFrame:
    """Blocks, kind, identifiers, proposed key, tokens and sources of derived blocks of every message."""
    blocks = computed_once(texts_of(messages, config), [*COORDINATES, "strings", "joined"], **_block_columns())
    scored = computed_once(blocks, [*COORDINATES, *IDS, "name_birth"], **_score_columns())
    return computed_once(scored, [*COORDINATES, *[f"b_{k}" for k in V.KINDS], *IDS], **_kind_columns())


def contribute(messages: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per message with at most one block per kind, ready to fold."""
    keep = [*COORDINATES, *IDS, "kind", "proposed_key", "tokens"]
    return computed_once(extract(messages, config), keep, **_contribution_columns())
