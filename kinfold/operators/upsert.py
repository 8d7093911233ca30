"""Upsert of one keyed table into another as a join; both sides hold one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole number types from narrow to wide, and numbers with a fraction.
INTEGERS = ("tinyint", "smallint", "int", "bigint")
FRACTIONS = ("float", "double")
#: Whole numbers up to this are doubles without loss.
EXACT = 1 << 53

REPLACE = "replace"
COALESCE_NEW = "coalesce_new"
TARGET_WINS = "target_wins"


def newest_per_key(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Last row of each key by ``by``; pre-aggregated, so a heavy key is no heavy task."""
    rest = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("row"))
    return newest.select(key, "row.*").select(*rows.columns)


def widest(a: str, b: str) -> str:
    """The least type that holds the values of both: ``void`` is below all, numbers widen to double, dates to timestamps.

    Types with nothing in common meet in ``string``, which holds every scalar.
    """
    if a == b or b == "void":
        return a
    if a == "void":
        return b
    for ladder in (INTEGERS, FRACTIONS, ("date", "timestamp")):
        if a in ladder and b in ladder:
            return max(a, b, key=ladder.index)
    return "double" if {a, b} <= {*INTEGERS, *FRACTIONS} else "string"


def merged_types(target: DataFrame, source: DataFrame) -> dict[str, str]:
    """Columns of both sides with the type that holds the values of both.

    A column of whole numbers that meets fractions becomes double only if that keeps every number, else string; its
    values are looked at where that question comes up, and nowhere else.
    """
    old, new = dict(target.dtypes), dict(source.dtypes)
    types = {c: widest(old.get(c, "void"), new.get(c, "void")) for c in {**old, **new}}
    for side, own in ((target, old), (source, new)):
        asked = [c for c, t in own.items() if t == "bigint" and types[c] == "double"]
        if asked:
            large = side.agg(*[F.bool_or(~F.col(f"`{c}`").between(-EXACT, EXACT)).alias(f"c{i}") for i, c in enumerate(asked)]).first()
            types.update({c: "string" for i, c in enumerate(asked) if large[i]})
    return types


def aligned(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the given columns and types; columns it lacks are null."""
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c)
                       for c, t in columns.items()])


def upsert(target: DataFrame, source: DataFrame, key: str, policy: str = REPLACE,
           keep_first: tuple[str, ...] = ("created_at",), newest: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Full outer merge of ``source`` into ``target``.

    ``replace``: source values win, nulls included. ``coalesce_new``: source values win unless null.
    ``target_wins``: the source only fills what the target lacks. In all of them ``keep_first``
    columns keep a stored value and ``newest`` columns take the source's. Columns only one side
    has are added; columns of both get a type that holds the values of both. Rows without a key are not stored.
    """
    types = merged_types(target, source)
    t = aligned(target.filter(F.col(key).isNotNull()), types).withColumn("stored", F.lit(True)).alias("t")
    s = aligned(source.filter(F.col(key).isNotNull()), types).withColumn("given", F.lit(True)).alias("s")

    def value(c: str) -> Column:
        old, new = F.col(f"t.`{c}`"), F.col(f"s.`{c}`")
        if c == key or c in keep_first:
            return F.coalesce(old, new)
        if c in newest or policy == REPLACE:
            return F.when(F.col("s.given"), new).otherwise(old)
        return F.coalesce(new, old) if policy == COALESCE_NEW else F.coalesce(old, new)

    return (t.join(s, F.col(f"t.`{key}`") == F.col(f"s.`{key}`"), "full_outer")
            .select(*[value(c).alias(c) for c in types]))
