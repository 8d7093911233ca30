"""SpotSigs fingerprints: chains of content words behind common-word anchors (Theobald et al., SIGIR 2008).

All of it is DataFrame expressions. A text's words are its runs of letters and digits, lower-cased. Each
anchor, a word of ``ANCHORS``, gives the signature of itself and the ``CHAIN`` content words that follow it,
other anchors skipped; at the end of the text the chain is as long as it can be. A text without any signature
is its content words' chains without an anchor, so that texts in other languages have fingerprints, too.
A fingerprint is the sorted set of 32-bit signature hashes, in hexadecimal.

Near pairs: with similarity t, sets can match only if the smaller has at least t of the larger's size. Sizes
are cut into ranges that grow by 1/t, so a set meets its own and the next range only. In a range, sets meet
that share one of their rarest signatures: as many as two matching sets cannot both avoid. Pairs are then
counted exactly. Equal fingerprints are one set first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.skew import lookup
from kinfold.session import written

#: Common words of the corpus' languages that stand before content words.
ANCHORS = ("a an and are as at be by for from had has have he her his in is it its of on or she that the their they this to "
           "was were which with will not but "
           "au aux ce dans de des du elle en est et il la le les leur ne ou par pas pour que qui se sur un une "
           "auf das dem den der die ein eine er es für ist mit nicht sich sie und von zu "
           "al como con del el las lo los más no para por su una y").split()
CHAIN = 2
#: Documents that a block of neighbours is meant to hold; blocks grow beyond ``BLOCKS`` of them.
BLOCK, BLOCKS = 2000, 1024


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, however often they are used: a generator is never merged away."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def signatures(df: DataFrame, text: str, name: str, chain: int = CHAIN) -> DataFrame:
    """Add ``name``, the sorted distinct signatures of the column ``text`` as integers; null is empty."""
    words, places = f"{name}_words", f"{name}_places"
    df = _once(df, **{words: F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")})
    df = _once(df, **{places: F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (i < F.size(words)) & ~F.coalesce(
        F.get(F.col(words), i), F.lit("")).isin(ANCHORS))})

    def linked(k: Column) -> list[Column]:
        return [F.coalesce(F.get(F.col(words), F.get(F.col(places), k + i)), F.lit("")) for i in range(chain)]

    def spots(k: Column) -> Column:
        """The anchors between content words ``k - 1`` and ``k``, each with the chain from ``k``."""
        before = F.when(k == 0, F.lit(-1)).otherwise(F.get(F.col(places), k - 1))
        between = F.get(F.col(places), k) - before - 1
        return F.when(between > 0, F.transform(F.slice(words, before + 2, between), lambda anchor: F.hash(anchor, *linked(k)))
                      ).otherwise(F.array().cast("array<int>"))
    # the sequence ends one too late, as it could not be empty otherwise
    steps = F.filter(F.sequence(F.lit(0), F.size(places)), lambda k: k < F.size(places))
    df = _once(df, **{f"{name}_spots": F.flatten(F.transform(steps, spots))})
    plain = F.transform(steps, lambda k: F.hash(F.lit(""), *linked(k)))
    df = _once(df, **{name: F.array_sort(F.array_distinct(F.when(
        F.size(f"{name}_spots") > 0, F.col(f"{name}_spots")).otherwise(plain)))})
    return df.drop(words, places, f"{name}_spots")


def fingerprint(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two signature columns; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def neighbours(docs: DataFrame, make: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """``make(docs)`` with ``next_<column>`` of the next row by falling ``doc_id``; after the last comes the first.

    What finds the blocks reads ids only, and nothing is made for it.

    Blocks of ids, cut at ids that quantiles pick, are sorted independently. Into each block goes a copy of
    the rows that follow it, so that no row needs another block. Ties of ids are taken by text; null ids come last.
    """
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n, top = docs.agg(F.count("*"), F.max(place)).first()
    blocks = max(1, min(BLOCKS, n // BLOCK))
    cuts = docs.agg(F.percentile_approx(place, [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0] \
        if blocks > 1 else []
    cuts = sorted({c for c in cuts if c < top})
    # block b holds the ids above cut b - 1, up to cut b, which some row has
    below = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c < place))
    own = make(docs).select("doc_id", *carried, below.alias("block"), F.lit(0).alias("copied"))
    heads = make(docs.filter(place.isin([*cuts, top]))).select(
        "doc_id", *carried, F.when(place == top, 0).otherwise(below + 1).alias("block"), F.lit(1).alias("copied"))
    order = Window.partitionBy("block").orderBy("copied", place.desc(), F.asc_nulls_first("text"))
    nexts = {f"next_{c}": F.lead(c).over(order) for c in carried}
    return own.unionByName(heads).withColumns(nexts).filter("copied = 0").drop("block", "copied")


def edited(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike it is to that and to the next text.

    The edited text has the last third of the code points, rounded down, replaced by the first as many (or all)
    of the next row's text. Null texts are empty. Repeated rows are each other's next; a single row is its own.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = neighbours(texts, lambda df: signatures(df, "text", "spots", chain), ["text", "spots"])
    cut = F.expr("length(text) div 3").cast("int")
    rows = _once(rows, other=F.concat(F.substring("text", F.lit(1), F.length("text") - cut),
                                      F.substring("next_text", F.lit(1), cut)))
    rows = signatures(rows, "other", "other_spots", chain)
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("other", 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("other_spots")).alias("edited_fingerprint"),
        likeness("spots", "other_spots").alias("near_edited"), likeness("spots", "next_spots").alias("near_next"))


def near_pairs(docs: DataFrame, similarity: float = 0.8, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: ``(doc_id, class_id)``, one class for each fingerprint, and ``(a, b, likeness)`` of classes.

    A class is named by its least id. Null ids are left out. Texts without words are one class.
    """
    made = signatures(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(
        "text").cast("string").alias("text")), "text", "spots", chain).select("doc_id", "spots")
    sets = written(made.groupBy("spots").agg(F.min("doc_id").alias("class_id")), "fingerprints")
    members = made.join(sets, "spots").select("doc_id", "class_id")
    size = F.size("spots")
    span = F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / similarity)))
    # in one order of all signatures, two matching sets share one of their first size - ceil(similarity * size) + 1; with
    # the rarest first, a signature of many sets is among the first of few
    each = sets.filter(size > 0).select("class_id", size.alias("size"), span.alias("span"), F.explode("spots").alias("spot"))
    often = written(each.groupBy("spot").agg(F.count("*").alias("n")), "often")
    rarest = Window.partitionBy("class_id").orderBy("n", "spot")
    heads = written(lookup(each, often, "spot", 256).withColumn("turn", F.row_number().over(rarest)).filter(
        F.col("turn") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1).drop("turn", "n"), "heads")
    small = heads.select(F.col("class_id").alias("a"), F.col("size").alias("a_size"), "spot", "span")
    large = heads.select(F.col("class_id").alias("b"), F.col("size").alias("b_size"), "spot",
                         F.explode(F.array("span", F.col("span") - 1)).alias("span"))
    met = small.join(large, ["spot", "span"]).filter(
        (F.col("a_size") >= similarity * F.col("b_size")) & (
            (F.col("a_size") < F.col("b_size")) | (F.col("a_size") == F.col("b_size")) & (F.col("a") < F.col("b"))))
    pairs = (met.select("a", "b").distinct()
             .join(sets.select(F.col("class_id").alias("a"), F.col("spots").alias("a_spots")), "a")
             .join(sets.select(F.col("class_id").alias("b"), F.col("spots").alias("b_spots")), "b")
             .select("a", "b", likeness("a_spots", "b_spots").alias("likeness")).filter(F.col("likeness") >= similarity))
    return members, pairs
