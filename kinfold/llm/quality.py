"""A quality classifier from weak labels: labellers, their accuracies by EM, and a hashed linear scorer.

Labellers look at one trait of a text each and vote to reject it, to keep it, or not at all. They overlap and
err. Expectation-maximisation over how often each pattern of votes occurs, at most 3 ** labellers numbers however
large the corpus, estimates how often each labeller is right when it votes, and with that the probability that a text of
a pattern is bad. These posteriors are the labels of a logistic scorer over hashed
traits, words and word beginnings, which L1 regularisation keeps sparse; the scorer alone decides.

Votes and patterns cover all documents. Two steps look at bounded samples, chosen by a hash of ``doc_id``: the
cue labeller counts words in at most ``LABELLED`` documents that the label table covers, and the scorer is
fitted on at most ``FITTED`` documents, in one task that holds their features; the driver sees its weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinfold.llm.text import LOWER, id_text, map_batches, pieces, rows_of, signed, word_hashes, word_spans

#: Most labelled documents whose words are counted, and most documents that the scorer is fitted on.
LABELLED, FITTED = 20_000, 20_000
#: A cue is found in so many bad texts of the sample at least, and so many times as often as in good ones.
CUE_TEXTS, CUE_ODDS = 5, 40.0
BITS = 18
REJECT = 0.5

#: Words that abuse others.
ABUSE = ("clown disgusting idiot idiots loser losers moron morons pathetic scum stupid trash worthless "
         "bastard bitch crap cunt dickhead dumbass fag fuck fucking nigger retard shit slut whore").split()
#: Traits of a text with the values above which they are rejected; each is a share.
TRAITS = {"symbols": 0.05, "capitals": 0.4, "bars": 0.08, "repeats": 0.2, "sameness": 0.7, "exclamations": 0.3}
LABELLERS = [*TRAITS, "abuse", "cues", "plain", "label"]
#: Steps that turn a trait into binary features.
_STEPS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
#: Buckets of the scorer: words, steps of traits, and whether a word is abuse or a cue.
SIZE = (1 << BITS) + len(TRAITS) * len(_STEPS) + 2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*+<=>@[\\]^_`{}~")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
#: What a word may be wrapped in.
_EDGE = np.zeros(256, bool)
_EDGE[list(b"!\"'(),-.:;?[]")] = True


def _shares(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, whole: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(table[data])]
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(whole, 1)


@dataclass
class Features:
    """Of some rows: ``row, feature`` pairs of words and word beginnings, and the traits ``(trait, row)``."""

    row: np.ndarray
    feature: np.ndarray
    word: np.ndarray
    traits: dict[str, np.ndarray]


def among(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(wanted), bool)
    return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted


def by_row(row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by row, then value. Row numbers of a piece mostly fit 16 bits, which numpy sorts by digits."""
    order = np.argsort(values)
    own = row[order]
    return order[np.argsort(own.astype(np.uint16) if len(row) and row.max() < 1 << 16 else own, kind="stable")]


def features(data: np.ndarray, offsets: np.ndarray, distinct: bool = True) -> Features:
    """What a text is judged by; votes, which only ask whether a text has a feature, need not have them ``distinct``."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    lower = LOWER[data]
    starts, ends, first = word_spans(lower, offsets)
    row, words = rows_of(first), np.diff(first)
    plain = word_hashes(lower, starts, ends)
    again = np.zeros(len(row), bool)
    again[1:] = (plain[1:] == plain[:-1]) & (row[1:] == row[:-1])
    order = by_row(row, plain)
    first_of = np.ones(len(row), bool)
    first_of[1:] = (plain[order][1:] != plain[order][:-1]) | (row[order][1:] != row[order][:-1])
    kinds = np.bincount(row[order][first_of], minlength=rows)
    bars = np.bincount(row[(ends - starts == 1) & (lower[starts] == 124)], minlength=rows)
    letters = np.r_[0, np.cumsum(_LETTER[data])]
    letters = letters[offsets[1:]] - letters[offsets[:-1]]
    marks = np.r_[0, np.cumsum(data == 33)]
    traits = {
        "symbols": _shares(data, offsets, _SYMBOL, sizes),
        "capitals": np.where(letters >= 20, _shares(data, offsets, _CAPITAL, letters), 0.0),
        "bars": np.where(words >= 10, bars / np.maximum(words, 1), 0.0),
        "repeats": np.where(words >= 10, np.bincount(row[again], minlength=rows) / np.maximum(words, 1), 0.0),
        "sameness": np.where((words >= 50) & (words < 2000), 1 - kinds / np.maximum(words, 1), 0.0),
        "exclamations": np.where(words >= 10, (marks[offsets[1:]] - marks[offsets[:-1]]) / np.maximum(words, 1), 0.0)}
    bare, stop = starts.copy(), ends.copy()
    for _ in range(2):  # at most two marks on each side
        bare += (bare < stop - 1) & _EDGE[lower[np.minimum(bare, len(lower) - 1)]] if len(bare) else 0
        stop -= (bare < stop - 1) & _EDGE[lower[stop - 1]] if len(bare) else 0
    word = word_hashes(lower, bare, stop)
    begin = [word_hashes(lower, bare, np.minimum(bare + n, stop)) + np.uint64(n) for n in (4, 5, 6)]
    longer = [stop - bare > n for n in (4, 5, 6)]
    feature = np.concatenate([word, *(h[x] for h, x in zip(begin, longer))])
    owner = np.concatenate([row, *(row[x] for x in longer)])
    if not distinct:
        return Features(owner, feature, word, traits)
    order = by_row(owner, feature)
    feature, owner = feature[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (feature[1:] != feature[:-1]) | (owner[1:] != owner[:-1])
    return Features(owner[new], feature[new], word, traits)


def _hash_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


def votes(found: Features, rows: int, cues: np.ndarray) -> np.ndarray:
    """``(rows, labellers)`` of 1 to reject, -1 to keep, 0 for no vote.

    Traits and words can only speak against a text; the plain labeller keeps one in which all of them are far from
    doing so. The label's own vote is left at 0.
    """
    out = np.zeros((rows, len(LABELLERS)), np.int8)
    plain = np.ones(rows, bool)
    for j, (trait, above) in enumerate(TRAITS.items()):
        out[:, j] = found.traits[trait] > above
        plain &= found.traits[trait] <= above / 2
    for j, known in ((len(TRAITS), np.sort(_hash_of(ABUSE))), (len(TRAITS) + 1, cues)):
        if len(known):
            out[:, j] = np.bincount(found.row[among(known, found.feature)], minlength=rows) > 0
            plain &= out[:, j] == 0
    out[:, LABELLERS.index("plain")] = np.where(plain, -1, 0)
    return out


def hashed(found: Features, rows: int, cues: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)`` of all distinct binary features, sorted by row: hashed words, steps of traits, kinds of words."""
    row, bucket = [found.row], [(found.feature >> np.uint64(64 - BITS)).astype(np.int64)]
    for t, trait in enumerate(TRAITS):
        for s, step in enumerate(_STEPS):
            over = np.flatnonzero(found.traits[trait] > step)
            row.append(over)
            bucket.append(np.full(len(over), (1 << BITS) + t * len(_STEPS) + s))
    for k, known in enumerate((np.sort(_hash_of(ABUSE)), cues)):
        hit = np.unique(found.row[among(known, found.feature)])
        row.append(hit)
        bucket.append(np.full(len(hit), SIZE - 2 + k))
    pair = np.unique(np.concatenate(row) * SIZE + np.concatenate(bucket))
    return pair // SIZE, pair % SIZE


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """``(bad, accuracy)``: each pattern's probability of being bad, and how often each labeller is right if it votes.

    Votes are taken as independent given the class, and whether a labeller votes as saying nothing. Classes are
    taken as equally likely: with labellers that only ever vote one way, their shares and the accuracies could not both be
    told from votes. Accuracies start from, and are smoothed by, a prior of twenty votes of which eighteen are right.
    """
    accuracy = np.full(patterns.shape[1], 0.9)
    bad = np.zeros(len(patterns))
    for _ in range(rounds):
        bad = 1 / (1 + np.exp(-np.clip(patterns @ np.log(accuracy / (1 - accuracy)), -500, 500)))
        right = np.where(patterns > 0, bad[:, None], 1 - bad[:, None])
        voted = (patterns != 0) * counts[:, None]
        accuracy = np.clip(((right * voted).sum(axis=0) + 18) / (voted.sum(axis=0) + 20), 0.01, 0.999)
    return bad, accuracy


def fitted(values: np.ndarray, cuts: np.ndarray, target: np.ndarray, steps: int = 60_000, rate: float = 0.3, l1: float = 3.0,
           l2: float = 1.0, support: int = 5) -> tuple[np.ndarray, float]:
    """``(weights, bias)`` of a logistic scorer over binary features, by follow-the-regularised-leader.

    Row ``i`` has the distinct features ``values[cuts[i]:cuts[i + 1]]``.

    It goes over the rows four times at least, and so often that it takes ``steps`` steps. Features of fewer
    than ``support`` rows get no weight.
    """
    epochs = max(4, -(-steps // max(1, len(target))))
    size = SIZE
    held = (np.bincount(values, minlength=size) >= support)[values]
    cuts = np.r_[0, np.cumsum(held)][cuts]
    values = values[held]
    z, n, weights = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    pick = np.random.default_rng(7)
    for _ in range(epochs if len(target) else 0):
        for i in pick.permutation(len(target)):
            x = np.append(values[cuts[i]:cuts[i + 1]], size)
            w = np.where(np.abs(z[x]) <= l1, 0.0, -(z[x] - np.sign(z[x]) * l1) / ((0.1 + np.sqrt(n[x])) / rate + l2))
            weights[x] = w
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -50, 50))) - target[i]
            z[x] += g - (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / rate * w
            n[x] += g * g
    weights = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((0.1 + np.sqrt(n)) / rate + l2))
    return weights[:-1], float(weights[-1]) if len(target) else -10.0


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    accuracy: np.ndarray
    cues: np.ndarray


def _sample(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct ids, those of the least hashes."""
    return ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(most)


def cue_hashes(texts: DataFrame, labels: DataFrame, most: int) -> np.ndarray:
    """Hashes of words and word beginnings that bad labelled texts hold far more often than good ones."""
    chosen = _sample(labels, most).join(labels.groupBy("doc_id").agg(F.max("bad").alias("bad")), "doc_id")
    known = texts.join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                found = features(data, offsets)
                bad = np.asarray(batch.column("bad").slice(lo, hi - lo).to_pylist(), bool)[found.row]
                key, at = np.unique(found.feature, return_inverse=True)
                yield {"key": signed(key), "bad": np.bincount(at, bad, len(key)).astype(np.int64),
                       "good": np.bincount(at, ~bad, len(key)).astype(np.int64)}
    counts = map_batches(known, run, "key long, bad long, good long").groupBy("key").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    texts_bad, texts_good = known.agg(F.count_if(F.col("bad")), F.count_if(~F.col("bad"))).first()
    odds = (F.col("bad") / F.lit(max(1, texts_bad))) / ((F.col("good") + 0.5) / F.lit(texts_good + 1))
    cues = counts.filter((F.col("bad") >= CUE_TEXTS) & (odds >= CUE_ODDS)).select("key")
    return np.sort(cues.toPandas()["key"].to_numpy(np.int64).view(np.uint64))


def learned(docs: DataFrame, labels: DataFrame | None, labelled: int = LABELLED, fit_on: int = FITTED) -> Model:
    """The scorer of ``docs``. ``labels`` has ``doc_id`` and a boolean ``bad``; None or empty: only heuristics vote."""
    texts = id_text(docs)
    spark = docs.sparkSession
    if labels is None:
        labels = spark.createDataFrame([], "doc_id long, bad boolean")
    labels = labels.filter("doc_id is not null and bad is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "bad")
    cues = cue_hashes(texts, labels, labelled)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                made = votes(features(data, offsets, distinct=False), hi - lo, cues) + 1
                yield {"doc_id": batch.column("doc_id").slice(lo, hi - lo),
                       "pattern": ["".join(map(str, v)) for v in made[:, :-1].tolist()]}
    label_of = labels.groupBy("doc_id").agg(F.max("bad").alias("bad"))
    mark = F.when(F.col("bad"), "2").when(~F.col("bad"), "0").otherwise("1")
    patterns = (map_batches(texts, voted, "doc_id long, pattern string").join(label_of, "doc_id", "left")
                .groupBy(F.concat("pattern", mark).alias("pattern")).agg(F.count("*").alias("n")).collect())
    table = np.array([[int(v) - 1 for v in r["pattern"]] for r in patterns], np.int8).reshape(-1, len(LABELLERS))
    bad, accuracy = posteriors(table, np.array([r["n"] for r in patterns], float))
    bad_of = {r["pattern"]: b for r, b in zip(patterns, bad.tolist())}

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                found = features(data, offsets)
                made = votes(found, hi - lo, cues) + 1
                made[:, -1] = batch.column("mark").slice(lo, hi - lo).cast(pa.int8()).to_numpy(False)
                row, bucket = hashed(found, hi - lo, cues)
                cuts = np.searchsorted(row, np.arange(1, hi - lo))
                split = np.split(bucket.astype(np.int32), cuts)
                voted = np.flatnonzero((made != 1).any(axis=1)).tolist()  # a text without a vote teaches nothing
                yield {"doc_id": batch.column("doc_id").slice(lo, hi - lo).take(pa.array(voted, pa.int64())),
                       "bad": [bad_of["".join(map(str, made[i].tolist()))] for i in voted],
                       "buckets": [split[i] for i in voted]}
    chosen = _sample(texts.filter("doc_id is not null"), fit_on).join(label_of, "doc_id", "left").select(
        "doc_id", mark.alias("mark"))

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id").combine_chunks()  # the same fit however the rows arrive
        buckets = rows.column("buckets").combine_chunks()
        cuts = np.r_[0, np.cumsum(pa.compute.list_value_length(buckets).to_numpy(False))]
        own, bias = fitted(buckets.flatten().to_numpy(), cuts, rows.column("bad").to_numpy())
        at = np.flatnonzero(own)
        return pa.table({"bucket": np.append(at, SIZE).astype(np.int32), "weight": np.append(own[at], bias)})
    sample = map_batches(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "mark"), sampled,
                         "doc_id long, bad double, buckets array<int>")
    found = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(fit, "bucket int, weight double").toArrow()
    weights = np.zeros(SIZE + 1)
    weights[found.column("bucket").to_numpy()] = found.column("weight").to_numpy()
    return Model(weights[:-1], float(weights[-1]) if found.num_rows else -10.0, accuracy, cues)


def scored(docs: DataFrame, labels: DataFrame | None = None, labelled: int = LABELLED, fit_on: int = FITTED) -> DataFrame:
    """``docs`` with ``score``, the probability that the text is bad, and ``rejected``, whether it goes.

    A null or empty text has no features and is scored by the bias. Equal texts have equal scores. Rows that
    repeat an id are scored by their own texts; one without an id is scored, but not sampled. A
    document with several labels is bad if one of them says so. Columns named as the new ones are replaced.
    """
    model = learned(docs, labels, labelled, fit_on)
    weights, bias, cues = model.weights, model.bias, model.cues
    own = docs.select(*[docs[c].cast("string").alias(c) if c == "text" else docs[c] for c in docs.columns
                        if c.lower() not in ("score", "rejected")])
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                row, bucket = hashed(features(data, offsets), hi - lo, cues)
                score = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[bucket], hi - lo) + bias, -50, 50)))
                yield {n: batch.column(n).slice(lo, hi - lo) for n in names} | {"score": score, "rejected": score >= REJECT}
    return map_batches(own, run, StructType([*own.schema, *StructType.fromDDL("score double, rejected boolean")]))
