"""Data blocks: the canonical fields of one kind found in a message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.functions import text as T
from kinfold.functions.fields import MAP, is_object, is_truthy, is_useful, let


def _canonical_names(kind: str) -> tuple[list[str], Column]:
    pairs = [(alias, name) for name, aliases in V.ALIASES[kind].items() for alias in aliases]
    names = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return [alias for alias, _ in pairs], names


def alias_hits(keys: Column, kind: str) -> Column:
    """Keys of a message that are aliases of ``kind``, each once, in document order."""
    return F.array_intersect(keys, F.array(*[F.lit(alias) for alias in _canonical_names(kind)[0]]))


#: Fields of a block that are taken one by one, without lambdas; blocks with more take them.
FIELDS = 4


def alias_block(hits: Column, keys: Column, texts: Column, norms: Column, values: Column, kind: str) -> Column:
    """Canonical fields of ``kind`` by alias (``alias_hits``), first hit in document order, useless values dropped.

    Text is normalised, but only trimmed for bank data, where case carries meaning.
    """
    _, names = _canonical_names(kind)
    plain = [name for name, aliases in V.ALIASES[kind].items() if name in aliases]

    def name(key: Column) -> Column:
        return F.when(key.isin(plain), key).otherwise(F.element_at(names, key))

    def field(key: Column) -> tuple[Column, Column]:
        """Whether the first value of a key is of use, and that value."""
        place = (F.array_position(keys, key) - 1).cast("int")
        value = F.get(values, place)
        text = T.strip(F.get(texts, place)) if kind == "bank" else F.get(norms, place)
        return (F.when(text.isNotNull(), text != "").otherwise(is_useful(value)),
                F.when(text.isNotNull(), text.cast("variant")).otherwise(value))

    def single(i: int) -> Column:
        key, earlier = F.get(hits, F.lit(i)), [F.get(hits, F.lit(j)) for j in range(i)]
        useful, value = field(key)
        wanted = reduce(lambda a, b: a & b, [F.size(hits) > i, *[name(key) != name(e) for e in earlier], useful])
        return F.when(wanted, F.create_map(name(key), value)).otherwise(empty_block())

    def pair(key: Column) -> Column:
        useful, value = field(key)
        return F.struct(name(key).alias("key"), value.alias("value"), useful.alias("useful"))

    def build(pairs: Column) -> Column:
        first = F.filter(pairs, lambda p, i: p["useful"] & (F.array_position(pairs["key"], p["key"]) == i + 1))
        return F.map_from_entries(F.transform(first, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))))

    n = F.size(hits)
    return (F.when(n == 0, empty_block()).when(n == 1, single(0))
            .when(n <= FIELDS, F.map_concat(*[single(i) for i in range(FIELDS)])).otherwise(let(F.transform(hits, pair), build)))


#: Fields that a pattern fills when no alias does, by kind.
PATTERN_FIELDS = {"bank": ["iban", "swift"], "net": ["ipv4", "ipv6"]}


def pattern_hits(strings: Column, joined: Column) -> dict[str, Column]:
    """What each pattern finds first in any string, or null."""
    whole = F.get(F.filter(F.transform(strings, T.find_ipv6), lambda s: s.isNotNull()), F.lit(0))
    return {"iban": T.find_iban(joined), "swift": T.find_swift(joined), "ipv4": T.find_ipv4(joined),
            "ipv6": F.when(F.contains(joined, F.lit(":")), T.normalize(whole))}


def _filled(block: Column, name: str, found: Column) -> Column:
    """Fill ``name`` from ``found`` when the alias gave nothing truthy. Most messages need neither look-up nor lambda."""
    rest = F.map_filter(block, lambda k, _: k != name)
    return F.when(found.isNull() | is_truthy(F.try_element_at(block, F.lit(name))), block).otherwise(
        F.map_concat(rest, F.create_map(F.lit(name), found.cast("variant"))))


def filled(kind: str, block: Column, hits: dict[str, Column]) -> Column:
    """Block of ``kind`` over columns: its ``alias_block``, then (bank, net) the first pattern found in any string."""
    for name in PATTERN_FIELDS.get(kind, []):
        block = _filled(block, name, hits[name])
    return block


def light_block(fields: Column) -> Column:
    """What is kept of a message of no known kind: its scalar fields not starting with ``_``."""
    scalar = F.map_filter(fields, lambda k, v: ~k.startswith("_") & ~F.is_variant_null(v)
                          & ~is_object(v) & ~F.schema_of_variant(v).startswith("ARRAY"))
    return F.map_from_arrays(F.array(F.lit("raw")), F.array(scalar))


def text_of(block: Column, name: str) -> Column:
    """Field of a block when it is a string, else null."""
    value = F.try_element_at(block, F.lit(name))
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def empty_block() -> Column:
    return F.from_json(F.lit("{}"), MAP)
