"""What one message contributes to a profile: its own block and the blocks derived from it."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.functions import text as T
from kinfold.functions.text import let
from kinfold.operators.blocks import text_of
from kinfold.operators.classify import UNKNOWN
from kinfold.operators.identifiers import Ids, id_columns


def _text_map(**values: Column) -> Column:
    """Map of the given non-null texts; null when all are null."""
    sets = [names for n in range(len(values), 0, -1) for names in combinations(values, n)]
    return F.coalesce(*[
        F.when(reduce(lambda a, b: a & b, [values[k].isNotNull() for k in names]),
               F.create_map(*[x for k in names for x in (F.lit(k), values[k].cast("variant"))])) for names in sets])


def source_columns() -> dict[str, Column]:
    """What derived blocks are made from, over blocks and identifiers, as columns: each is used several times."""
    mail = T.email_domain(F.col("id_email"))
    return {"country_code": T.iban_country_code(text_of(F.col("b_bank"), "iban")), "mail_domain": mail,
            "domain": F.coalesce(mail, text_of(F.col("b_net"), "domain"))}


def location_from_bank(code: Column) -> Column:
    """Country of the IBAN."""
    return _text_map(country_code=code, country=T.country_name(code))


def personal_from_ids(ids: Ids) -> Column:
    return _text_map(email=ids["email"], phone=ids["phone"])


def net_from_email(mail_domain: Column) -> Column:
    return _text_map(domain=mail_domain)


def professional_from_domain(domain: Column) -> Column:
    """Company named by the mail domain, else by the net block's domain; marked as inferred."""
    return F.when(domain.isNotNull(), let(T.company_from_domain(domain), lambda c: F.when(c.isNotNull(), F.map_from_arrays(
        F.array(F.lit("company"), F.lit("_inferred")),
        F.array(c.cast("variant"), F.lit(True).cast("variant"))))))


def contribution_columns() -> dict[str, Column]:
    """Contributions of a message over the columns of ``plans.extract.extract``.

    A message adds each kind at most once, so its contributions are five nullable columns
    ``c_<kind>``, not up to five rows: later stages shuffle one row per message.
    ``observed`` lists the kinds read from the message itself.
    """
    kind = F.col("kind")

    def block(k: str) -> Column:
        return F.col(f"b_{k}")

    def own(k: str) -> Column:
        return F.when((kind == k) & (F.size(block(k)) > 0), block(k))

    ids = id_columns()
    real_job = F.when(F.size(block("professional")) > 0, block("professional"))
    made = {
        "personal": F.coalesce(own("personal"), personal_from_ids(ids)),
        "location": F.coalesce(own("location"), location_from_bank(F.col("country_code"))),
        "professional": F.coalesce(real_job, professional_from_domain(F.col("domain"))),
        "bank": own("bank"),
        "net": F.coalesce(own("net"), net_from_email(F.col("mail_domain"))),
    }
    observed = F.array_except(F.array(
        F.coalesce(*[F.when((kind == k) & (F.size(block(k)) > 0), kind) for k in V.KINDS]),
        F.when((kind != "professional") & (F.size(block("professional")) > 0), F.lit("professional"))),
        F.array(F.lit(None).cast("string")))
    return {"observed": observed, **{f"c_{k}": made[k] for k in V.KINDS}}


def exploded(contributed: DataFrame) -> DataFrame:
    """Long form: ``kind, block, derived, step`` rows, in the order the engine applies them."""
    steps = ["location", "personal", "net", "professional"]
    rows = F.array(*[
        F.struct(F.lit(k).alias("contributed_kind"), F.col(f"c_{k}").alias("block"),
                 (~F.array_contains("observed", k)).alias("derived"),
                 F.when(F.col("kind") == k, 1).otherwise(steps.index(k) + 2 if k in steps else 1).alias("step"))
        for k in V.KINDS])
    keep = [c for c in contributed.columns if not c.startswith("c_")]
    return contributed.select(*keep, F.inline(F.filter(rows, lambda r: r["block"].isNotNull())))


def batch_metrics(contributed: DataFrame) -> DataFrame:
    """Counts of one batch: read, upserts (also per kind), skipped messages."""
    return contributed.agg(*[c.alias(n) for n, c in batch_counts().items()])


def batch_counts() -> dict[str, Column]:
    """The same as aggregates, for a job that counts while it folds."""
    none = F.array_contains("observed", F.col("kind"))
    upserts = sum((F.count(f"c_{k}") for k in V.KINDS[1:]), F.count(f"c_{V.KINDS[0]}"))
    return {"read": F.count("*"), "upserts": upserts, **{k: F.count(f"c_{k}") for k in V.KINDS},
            "skipped_unknown": F.count_if(F.col("kind") == UNKNOWN),
            "skipped_empty": F.count_if((F.col("kind") != UNKNOWN) & ~none)}
