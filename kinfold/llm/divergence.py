"""Divergence of sources by their words, over texts collapsed to one copy each.

Equal texts of a language are gathered first, with the number of times each source holds them, so that a text is split
into words once, however often it was copied. Its counts, and itself as a document, are then added with
those weights. What is left is one row for each language, source and term, on which everything else works.

Sources are compared over the terms that either of them holds. All terms that one lacks have the same share there, so that
a source's own terms against another source's missing ones depend on its counts alone: they are summed over a table of
how many terms have each count. Terms that both hold are met in a join by term, and correct that sum; terms
that neither holds are one number, counted off the vocabulary. Nothing is summed over a whole vocabulary for each pair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.text import PIECE_BYTES, map_batches, texts_of
from kinfold.session import written

MIN_DOCS = 3
TERM_RANKS = 200
SCALE = 1_000_000_000
#: Rows that a task gathers before it hands them on.
GATHERED = 1 << 18
#: ASCII letters and everything outside ASCII, in UTF-8 bytes; lower-casing bytes changes A to Z only.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")
_COUNTED = "lang string, source string, term string, n long, docs long"


def terms_of(text: bytes) -> Counter:
    """How often a text holds each term; a long text is read in pieces that end between terms."""
    if len(text) <= PIECE_BYTES:
        return Counter(TERM.findall(text.lower()))
    found: Counter = Counter()
    at = 0
    while at < len(text):
        stop = _BREAK.search(text, min(len(text), at + PIECE_BYTES))
        to = stop.end() if stop else len(text)
        found.update(TERM.findall(text[at:to].lower()))
        at = to
    return found


def plain(docs: DataFrame) -> DataFrame:
    """``(lang, source, text)`` as strings, null as empty, and ``same``, which tells equal texts."""
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.withColumn("same", F.unhex(F.sha2("text", 256)))


def collapsed(rows: DataFrame) -> DataFrame:
    """``(lang, text, copies)``: each text of a language once, with the number of copies in each source.

    Both sides are reduced per task before they are shuffled, by the same key, so their join moves nothing more.
    """
    texts = rows.groupBy("lang", "same").agg(F.any_value("text").alias("text"))
    copies = rows.groupBy("lang", "same", "source").agg(F.count("*").alias("times")).groupBy("lang", "same").agg(
        F.collect_list(F.struct("source", "times")).alias("copies"))
    return texts.join(copies, ["lang", "same"]).select("lang", "text", "copies")


def counted(texts: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of a term and documents that hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found: dict[tuple, dict[bytes, list[int]]] = {}
        held = 0

        def given() -> dict:
            rows = [(lang, source, term.decode(), n, d) for (lang, source), own in found.items() for term, (n, d) in own.items()]
            return dict(zip(("lang", "source", "term", "n", "docs"), map(list, zip(*rows))))
        for batch in batches:
            for lang, text, copies in zip(batch.column("lang").to_pylist(), texts_of(batch), batch.column("copies").to_pylist()):
                terms = terms_of(text)
                for c in copies:
                    own, times = found.setdefault((lang, c["source"]), {}), c["times"]
                    for term, n in terms.items():
                        if (sums := own.get(term)) is None:
                            own[term] = [n * times, times]
                            held += 1
                        else:
                            sums[0] += n * times
                            sums[1] += times
                    if held >= GATHERED:
                        yield given()
                        found, held = {}, 0
        if held:
            yield given()
    # rows are gathered before they leave the worker, so another round of it before the shuffle would only cost time
    parts = map_batches(texts, run, _COUNTED).repartition("lang", "source", "term")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + 1) / (total + terms))`` in whole numbers."""
    parts = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + _div(parts, F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q) ** 2 / q)``; shares are at most SCALE + 1, so a long holds the square."""
    return _div((p - q) * (p - q), q)


def _exact(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: the summed distance of each source from each other one of its language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("held").alias("item_held"))
    none = distance(F.col("p0"), F.col("q0"))
    neither = groups.join(other, "lang").filter("source <> item").select(
        "lang", "source", "item", (_exact(F.col("terms") - F.col("held") - F.col("item_held")) * _exact(none)).alias("value"))

    levels = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    one = levels.join(other.drop("item_held"), "lang").filter("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(_exact(F.col("k")) * _exact(distance(F.col("p"), F.col("q0")))).alias("own"),
        F.sum(_exact(F.col("k")) * _exact(distance(F.col("q0"), F.col("p")))).alias("others"))
    one = one.select("lang", F.inline(F.array(
        F.struct("source", "item", F.col("own").alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("others").alias("value")))))

    left = shares.select("lang", "term", "source", "p", "p0")
    right = shares.select("lang", "term", *[F.col(c).alias(d) for c, d in (("source", "item"), ("p", "q"), ("p0", "q0"))])

    def both(p: str, p0: str, q: str, q0: str) -> Column:
        p, p0, q, q0 = map(F.col, (p, p0, q, q0))
        return F.sum(_exact(distance(p, q)) - _exact(distance(p, q0)) - _exact(distance(p0, q)) + _exact(distance(p0, q0)))
    met = left.join(right, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(
        both("p", "p0", "q", "q0").alias("there"), both("q", "q0", "p", "p0").alias("back"))
    met = met.select("lang", F.inline(F.array(
        F.struct("source", "item", F.col("there").alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))))

    wide = [df.select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value")) for df in (neither, one, met)]
    return wide[0].unionByName(wide[1]).unionByName(wide[2]).groupBy("lang", "source", "item").agg(
        F.sum("value").cast("long").alias("value"))


def report(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every source of every language.

    ``pair``: each other source of the language by the distance of its shares from this one's, over all terms that
    at least ``min_docs`` documents of the language hold. ``term``: the terms of which this source has a larger share than
    the language, by distance, to rank ``term_ranks``. Nulls are empty strings, which are a language and a
    source like others. Rows that repeat an id are documents of their own. Ties go by item. A language without such terms
    has pairs of value 0, one with a single source none. No rows: no result.
    """
    rows = plain(docs)
    counts = written(counted(collapsed(rows)), "terms")
    vocabulary = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                         .filter(F.col("docs") >= min_docs).drop("docs"), "vocabulary")
    kept = written(counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.count("*").alias("held"), F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["held", "total", "terms", "lang_total"])
    groups = written(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    shares = written(kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("whole")), "shares")

    def ranked(df: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = shares.filter("p > whole").select(
        "lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("whole")).alias("value"))
    return ranked(_pairs(shares, groups), "pair").unionByName(
        ranked(terms, "term").filter(F.col("rank") <= term_ranks))
