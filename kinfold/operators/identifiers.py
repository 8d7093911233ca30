"""Identifiers of a message and the grouping key proposed from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.functions.fields import first_text


#: Identifiers as columns by name. They travel as flat columns ``id_<name>``: pruning fields of a
#: struct through several generators loses attributes in Spark 4.1.
Ids = dict[str, Column]


def id_columns() -> Ids:
    return {name: F.col(f"id_{name}") for name in V.IDENTIFIERS}


def identifiers(keys: Column, texts: Column) -> Ids:
    """The five identifiers, normalised; null where absent or no string."""
    found = {name: first_text(keys, texts, V.IDENTIFIER_ALIASES[name]) for name in V.IDENTIFIERS}
    return {name: F.when(text != "", text) for name, text in found.items()}


def name_birth_key(keys: Column, texts: Column) -> Column:
    """``fullnamedob::name::birth`` when both are strings."""
    return F.concat(F.lit("fullnamedob::"), first_text(keys, texts, V.FULLNAME_ALIASES),
                    F.lit("::"), first_text(keys, texts, V.BIRTH_ALIASES))


def grouping_key(ids: Ids, name_birth: Column, raw_id: Column) -> Column:
    strong = [F.concat(F.lit(f"{name}::"), ids[name]) for name in ("passport", "email", "phone")]
    return F.coalesce(*strong, name_birth, F.concat(F.lit("rawid::"), raw_id))


def presence(ids: Ids) -> Column:
    """Presence vector (passport first) as a number; higher is the better anchor."""
    bits = [F.when(ids[name].isNotNull(), 1 << (len(V.IDENTIFIERS) - 1 - i)).otherwise(0)
            for i, name in enumerate(V.IDENTIFIERS)]
    return sum(bits[1:], bits[0])


def tokens(ids: Ids, name_birth: Column, raw_id: Column) -> Column:
    """What links a message to others: its identifiers and its name-and-birth key.

    A message with none of these stands alone under its raw id.
    """
    named = F.array(*[F.concat(F.lit(f"{name}="), ids[name]) for name in V.IDENTIFIERS],
                    F.when(ids["passport"].isNull() & ids["email"].isNull() & ids["phone"].isNull(),
                           F.concat(F.lit("key="), name_birth)))
    # No two begin alike, so that only the nulls go.
    found = F.array_except(named, F.array(F.lit(None).cast("string")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.concat(F.lit("key=rawid::"), raw_id)))
