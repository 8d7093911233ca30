"""The ordered, typed field stream of a JSON message: lists of its keys, texts and values, by place.

Three facts drive the form of these expressions. Alias lookup is by document order, so objects are
parsed to maps, which keep it (VARIANT objects sort their keys). Value types matter, so map values
are VARIANT. And a nested object loses its order inside a VARIANT, so where a payload has one, its
raw text is taken from a second, string-valued parse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.functions.text import clean, let

#: Every key some rule looks for; only their texts are normalised.
KNOWN_KEYS = sorted({key for lists in [*V.ALIASES.values(), V.IDENTIFIER_ALIASES] for keys in lists.values()
                     for key in keys} | set(V.FULLNAME_ALIASES) | set(V.BIRTH_ALIASES))

MAP = "map<string,variant>"
JSON_OPTIONS = {"allowSingleQuotes": "false"}


def decode(payload: Column) -> Column:
    """JSON object text to ``map<string,variant>``; null for anything else. A repeated key has its last value.

    The payload is parsed as the first of two array elements: text after the object would make
    the array malformed or of another length, while a bare parse would ignore it.
    """
    wrapped = F.from_json(F.concat(F.lit("["), payload, F.lit(',{"":0}]')), f"array<{MAP}>", JSON_OPTIONS)
    found = let(wrapped, lambda w: F.when(F.size(w) == 2, F.get(w, F.lit(0))))
    return let(found, lambda m: F.when(F.size(F.array_distinct(F.map_keys(m))) < F.size(m), F.map_from_entries(
        _one_per_key(F.map_entries(m)))).otherwise(m))


def _one_per_key(entries: Column) -> Column:
    """Last value of a repeated key, at the place of its first occurrence."""
    def dedupe(es: Column) -> Column:
        keys = F.transform(es, lambda e: e["key"])
        distinct = F.array_distinct(keys)
        return F.when(F.size(distinct) == F.size(keys), es).otherwise(
            F.transform(distinct, lambda k: F.element_at(F.filter(es, lambda e: e["key"] == k), -1)))
    return let(entries, dedupe)


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def _nested_entries(payload: Column, top: Column) -> Column:
    """Pairs of every nested object, in source order, one level deep."""
    texts = _one_per_key(F.map_entries(F.from_json(payload, "map<string,string>", JSON_OPTIONS)))

    def unpack(ts: Column) -> Column:
        inner = F.transform(top, lambda e, i: F.when(
            is_object(e["value"]),
            _one_per_key(F.map_entries(F.from_json(F.get(ts, i)["value"], MAP, JSON_OPTIONS)))))
        return F.flatten(F.filter(inner, lambda x: x.isNotNull()))
    return let(texts, unpack)


def pairs(payload: Column, fields: Column) -> Column:
    """Pairs ``array<struct<key,value>>`` of a message: top-level ones, then those of nested objects."""
    has_inner = F.instr(F.substr(F.ltrim(payload), F.lit(2)), "{") > 0
    top = F.map_entries(fields)
    return F.when(has_inner, let(top, lambda t: F.concat(t, _nested_entries(payload, t)))).otherwise(top)


#: Fields that are read place by place. Lambdas, which Spark interprets, read those of messages with more.
PLACES = 8


def _by_place(size: Column, at: Callable[[int], Column], longer: Column) -> Column:
    """Array of ``at(place)`` for ``size`` places."""
    return F.when(size <= PLACES, F.slice(F.array(*[at(i) for i in range(PLACES)]), F.lit(1), size)).otherwise(longer)


#: Between keys that are lower-cased at once.
_BETWEEN = "\x01"


def keys(names: Column) -> Column:
    """Names in lower case, at once where none changes or all are ASCII."""
    whole = F.array_join(names, _BETWEEN)
    parts = F.split(F.lower(whole), _BETWEEN)
    return (F.when(F.lower(whole) == whole, names)
            .when((F.octet_length(whole) == F.char_length(whole)) & (F.size(parts) == F.size(names)), parts)
            .otherwise(F.transform(names, F.lower)))


def texts(values: Column) -> Column:
    """Texts of the values that are strings, null for others, at the places of their keys."""
    def text(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))
    return _by_place(F.size(values), lambda i: text(F.get(values, F.lit(i))), F.transform(values, text))


def norms(stream_keys: Column, found: Column) -> Column:
    """Texts normalised, at the places of their keys, where some rule may ask for the key."""
    def norm(text: Column, key: Column) -> Column:
        return F.when(text.isNotNull() & key.isin(KNOWN_KEYS), clean(F.lower(text)))
    return _by_place(F.size(found), lambda i: norm(F.get(found, F.lit(i)), F.get(stream_keys, F.lit(i))),
                     F.transform(found, lambda text, i: norm(text, F.get(stream_keys, i))))


def strings(has_lists: Column, found: Column, values: Column) -> Column:
    """Every string of the stream, including strings inside lists. Other fields may stand as nulls."""
    def of_value(v: Column, i: Column) -> Column:
        items = F.transform(F.filter(v.cast("array<variant>"),
                                     lambda x: F.schema_of_variant(x) == "STRING"),
                            lambda x: x.cast("string"))
        return (F.when(F.get(found, i).isNotNull(), F.array(F.get(found, i)))
                .when(F.schema_of_variant(v).startswith("ARRAY"), items))
    inside = F.flatten(F.filter(F.transform(values, of_value), lambda x: x.isNotNull()))
    return F.when(has_lists, inside).otherwise(found)


#: Joins the strings of a message for whole-message pattern tests; no pattern or keyword holds it.
JOINT = "\n"


def joined(strings: Column) -> Column:
    """All strings as one text. The first pattern hit in it is the first hit of the first string with one."""
    return F.array_join(strings, JOINT)


def first_text(stream_keys: Column, texts: Column, wanted: list[str]) -> Column:
    """Normalised text of the first entry, in document order, whose key is one of ``wanted`` (even with a null value).

    Null when there is none or it is not a string. Places of keys need no lambda, which Spark would interpret.
    """
    places = F.array(*[F.array_position(stream_keys, key) for key in wanted])
    return F.get(texts, (F.array_min(F.array_remove(places, F.lit(0).cast("long"))) - 1).cast("int"))


def json_of(value: Column) -> Column:
    return F.to_json(value)


def is_useful(value: Column) -> Column:
    """Not null, not ``""``, not ``[]``; 0 and false are useful."""
    return ~F.coalesce(json_of(value), F.lit("null")).isin("null", '""', "[]")


def is_truthy(value: Column) -> Column:
    """True unless missing, null, empty, zero or false."""
    text = F.coalesce(json_of(value), F.lit("null"))
    other = ~(text.isin("null", "[]", "{}", "false") | F.coalesce(text.try_cast("double") == 0, F.lit(False)))
    return (F.when(value.isNull(), F.lit(False))
            .when(F.schema_of_variant(value) == "STRING", value.cast("string") != "").otherwise(other))
