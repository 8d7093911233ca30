"""Hard negatives for anchors, by bounds along spanning trees of the anchors.

Anchors are dealt by their direction to blocks, and in each block a minimum spanning tree joins them by
distance. All rows are dealt to blocks as well, and each pair of blocks is one task, which walks the tree
from its root. There every row's score is computed. A child's score of a row differs from its parent's by no more than the
edge's length times the row's norm, so each row has bounds at the child; only a row whose bounds reach into the
window of scores asked for is scored there, and the others hand their bounds on to the child's children.

That is done twice: the window of the first pass begins at the least of the best scores that so far belong to rows of
the anchor's label, which gives the anchor its positives; the windows of the second are shares of the positives' scores,
and are kept by rows of other labels. Each task returns its best few rows for each window, and the best
of those are taken by window. Anchors are a stated set of rows, and every row is met by each of them once.

Scores are inner products of whole numbers and exact: from doubles where all sums stay below 2 ** 53, else from
Python's integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.text import importable
from kinfold.session import written

POSITIVES = NEGATIVES = 5
#: Percentages of a positive's score between which its negatives lie.
LOW, HIGH = 80, 100
SCALE = 256
#: Anchors of a tree, and rows of a block.
TREE, BLOCK = 1024, 8192
#: Relative slack of bounds, against rounding in norms and lengths.
SLACK = 1e-9
#: The largest score that is told apart.
MOST = (1 << 63) - 1


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(row, vec_id, label, vector)`` of rows that take part, components as whole numbers in doubles."""
    def odd(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.transform(F.col("embedding").cast("array<double>"), lambda x: x * scale).alias("vector"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(~F.exists("vector", odd))
    # floor() of a double is a long in Spark, which the largest doubles exceed; those are whole already
    whole = F.transform("vector", lambda x: F.when(F.abs(x) < 2.0 ** 52, F.floor(x).cast("double")).otherwise(x))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("vector"))


def matrix(lists: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros, which leaves their products as they are."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pa.compute.list_value_length(lists).to_numpy(False).astype(np.int64)
    flat = lists.flatten().to_numpy(False)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, parent, edge)``: Prim's tree from row 0, parents before children; the root has parent -1."""
    n = len(x)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    near, best, left = np.zeros(n, np.int64), np.full(n, np.inf), np.ones(n, bool)
    now = 0
    for k in range(n):
        order[k], left[now] = now, False
        if k:
            parent[now], edge[now] = near[now], best[now]
        with np.errstate(over="ignore"):
            d = np.sqrt(((x - x[now]) ** 2).sum(axis=1))
        closer = left & (d < best)
        near[closer], best[closer] = now, d[closer]
        if k + 1 < n:
            rest = np.flatnonzero(left)  # a row whose distance overflows comes last, by an edge that bounds nothing
            now = int(rest[np.argmin(best[rest])])
    return order, parent, edge


def _blocks(anchors: DataFrame, tree: int) -> DataFrame:
    """Add ``tree``: ranges of a random direction, so that anchors of a block tend to lie near each other.

    A range that holds more than its share, as where many anchors are equal, is split by a hash. What the driver
    sees is a number for each ``tree`` anchors.
    """
    def component(x: Column, i: Column) -> Column:
        return x * (F.pmod(F.xxhash64(i), F.lit(2)) * 2 - 1)
    ranges = -(-anchors.count() // tree) or 1
    turned = anchors.withColumn("turned", F.aggregate(F.transform("vector", component), F.lit(0.0), lambda s, x: s + x))
    cuts = sorted(set(turned.approxQuantile("turned", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    dealt = written(turned.withColumn("range", F.size(F.filter(
        F.lit(cuts).cast("array<double>"), lambda c: c < F.col("turned")))).drop("turned"), "anchors")
    parts, first = {}, 0
    for r in dealt.groupBy("range").count().collect():
        parts[r["range"]] = first, -(-r["count"] // tree)
        first += parts[r["range"]][1]
    cut = anchors.sparkSession.createDataFrame([(r, *p) for r, p in parts.items()], "range int, first int, parts int")
    return dealt.join(F.broadcast(cut), "range").withColumn(
        "tree", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int")).drop("range", "first", "parts")


def trees(anchors: DataFrame, tree: int = TREE) -> DataFrame:
    """Anchors with ``tree``, their block, and their place, parent and edge in its spanning tree."""
    def grow(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        order, parent, edge = spanning_tree(matrix(rows.column("vector")))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        up = np.where(parent < 0, -1, place[parent])
        return rows.append_column("place", pa.array(place)).append_column("parent", pa.array(up)).append_column(
            "edge", pa.array(edge))
    return written(_blocks(anchors, tree).select("row", "vec_id", "label", "vector", "tree").groupBy("tree").applyInArrow(
        grow, "row long, vec_id long, label long, vector array<double>, tree int, place long, parent long, edge double"),
        "trees")


class _Block:
    """Rows of one block, in the order of their ids, and the bounds of their scores at anchors met so far."""

    def __init__(self, rows: pa.Table, width: int):
        ids = rows.column("vec_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        rows = rows.take(order)
        self.rows, self.labels = rows.column("row").to_numpy(), rows.column("label").to_numpy()
        self.ids = rows.column("vec_id")
        self.x = matrix(rows.column("vector"), width)
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((self.x ** 2).sum(axis=1))
        self.most = float(np.abs(self.x).max(initial=0))
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def scores(self, anchor: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Exact scores of some rows."""
        if self.most * float(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < 2.0 ** 53:
            made = (self.x @ anchor)[some] if 2 * len(some) > len(self.x) else self.x[some] @ anchor
            return made.astype(np.int64)
        own = [int(v) for v in anchor]
        made = (sum(int(v) * w for v, w in zip(row, own)) for row in self.x[some])
        return np.fromiter((max(-MOST, min(MOST, m)) for m in made), np.int64, len(some))

    def reached(self, parent: int, edge: float) -> tuple[np.ndarray, np.ndarray]:
        """Bounds at a child of ``parent``."""
        if parent < 0 or not np.isfinite(edge):
            return np.full(len(self.x), -np.inf), np.full(len(self.x), np.inf)
        low, high = self.bounds[parent]
        with np.errstate(over="ignore", invalid="ignore"):
            reach = edge * self.norms * (1 + SLACK)
            return low - reach - np.abs(low) * SLACK, high + reach + np.abs(high) * SLACK

    def known(self, place: int, low: np.ndarray, high: np.ndarray, some: np.ndarray, scores: np.ndarray) -> None:
        low, high = low.copy(), high.copy()
        cut = np.abs(scores) >= MOST  # a score that was cut to a long bounds nothing
        low[some], high[some] = np.where(cut, -np.inf, scores), np.where(cut, np.inf, scores)
        self.bounds[place] = np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def _first(scores: np.ndarray, places: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` of ``places``, which are in the order of ids, by falling score."""
    if len(places) > 4 * count:
        least = np.partition(scores, -count)[-count]
        some = np.flatnonzero(scores > least)
        some = np.sort(np.concatenate([some, np.flatnonzero(scores == least)[:count - len(some)]]))
        return some[np.argsort(-scores[some], kind="stable")]
    return np.argsort(-scores, kind="stable")[:count]


def _walk(anchors: pa.Table, rows: pa.Table, window, pick, columns: tuple[str, ...]) -> pa.Table:
    """Walk a tree over a block: ``window(anchor, block, low, high)`` says which rows to score, ``pick`` what to return."""
    out: list[tuple] = []
    if anchors.num_rows and rows.num_rows:
        anchors = anchors.sort_by("place")
        width = max(int(pa.compute.max(pa.compute.list_value_length(t.column("vector"))).as_py() or 0) for t in (anchors, rows))
        x, block = matrix(anchors.column("vector"), width), _Block(rows, width)
        parents = anchors.column("parent").to_numpy()
        children = np.bincount(parents[parents >= 0], minlength=len(x))
        for k, anchor in enumerate(anchors.drop_columns(["vector"]).to_pylist()):
            low, high = block.reached(anchor["parent"], anchor["edge"])
            some = np.flatnonzero(window(anchor, block, low, high)) if anchor["parent"] >= 0 else np.arange(len(low))
            scores = block.scores(x[k], some)
            if children[k]:
                block.known(k, low, high, some, scores)
            out += pick(anchor, block, some, scores)
            if anchor["parent"] >= 0:
                children[anchor["parent"]] -= 1
                if not children[anchor["parent"]]:
                    block.bounds.pop(anchor["parent"], None)
    made = list(zip(*out)) or [()] * len(columns)
    return pa.table({c: pa.array(list(v), pa.int64()) for c, v in zip(columns, made)})


def _over_blocks(anchors: DataFrame, rows: DataFrame, walk, schema: str, block: int) -> DataFrame:
    """``walk`` for every tree and every block of rows, a task each."""
    ids = [r["tree"] for r in anchors.select("tree").distinct().collect()]  # one for each TREE anchors
    blocks = -(-rows.count() // block) or 1
    each = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = anchors.withColumn("block", F.explode(each))
    right = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn(
        "tree", F.explode(F.lit(ids).cast("array<int>")))
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(walk, schema)


def mined(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
          low: int = LOW, high: int = HIGH, scale: int = SCALE, tree: int = TREE, block: int = BLOCK) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components are multiplied by ``scale`` and rounded down. Anchors are the rows for which ``is_anchor``, a condition on
    ``vec_id`` and ``label``, holds. An anchor's positives are the first ``positives`` other rows of its label; for each of them the first
    ``negatives`` rows of other labels with ``low * positive <= 100 * negative <= high * positive`` are returned.
    First is the highest score, then the least id, a null id last. Rows without a label or vector, or with a component
    that is null or not finite, also after scaling, take no part. Vectors of unequal lengths are compared as if filled with zeros. Rows that repeat an
    id are rows of their own. Labels are whole numbers. Scores beyond a long count as its nearest bound. A positive
    without negatives has no rows.
    """
    spark = importable(vectors.sparkSession)
    rows = written(prepared(vectors, scale), "rows")
    anchors = trees(rows.filter(F.coalesce(is_anchor, F.lit(False))), tree)

    def same(anchor: dict, b: _Block) -> np.ndarray:
        return (b.labels == anchor["label"]) & (b.rows != anchor["row"])

    def best_window(anchor, b, lows, highs):
        own = same(anchor, b)
        if own.sum() > positives:
            own &= highs >= np.partition(lows[own], -positives)[-positives]
        return own

    def best(anchor, b, some, scores):
        own = np.flatnonzero(same(anchor, b)[some])
        own = own[_first(scores[own], own, positives)]
        return [(anchor["row"], b.ids[int(some[i])].as_py(), int(b.rows[some[i]]), int(scores[i])) for i in own]

    def positive_walk(a: pa.Table, r: pa.Table) -> pa.Table:
        return _walk(a, r, best_window, best, ("anchor", "vec_id", "row", "score"))
    found = _over_blocks(anchors, rows, positive_walk, "anchor long, vec_id long, row long, score long", block)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    chosen = found.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= positives)
    windows = written(chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.col("vec_id").alias("id"), "score"))).alias("positives")), "positives")
    asked = written(anchors.join(windows, anchors["row"] == windows["anchor"], "left").drop("anchor"), "asked")

    def inside(anchor, lows, highs):
        """Each positive with the rows whose scores, or their bounds, reach its window."""
        for p in anchor["positives"] or ():
            least, most = max(-(-low * p["score"] // 100), -MOST), min(high * p["score"] // 100, MOST)
            yield p, (highs >= least) & (lows <= most) if least <= most else np.zeros(len(lows), bool)

    def negative_window(anchor, b, lows, highs):
        reached = np.zeros(len(lows), bool)
        for _, there in inside(anchor, lows, highs):
            reached |= there
        return reached & (b.labels != anchor["label"])

    def hardest(anchor, b, some, scores):
        out, other = [], b.labels[some] != anchor["label"]
        for p, there in inside(anchor, scores, scores):
            own = np.flatnonzero(other & there)
            own = own[_first(scores[own], own, negatives)]
            out += [(anchor["row"], anchor["vec_id"], p["turn"], p["id"], p["score"], b.ids[int(some[i])].as_py(),
                     int(b.rows[some[i]]), int(scores[i])) for i in own]
        return out
    columns = ("anchor", "anchor_id", "turn", "positive_id", "positive_score", "negative_id", "row", "negative_score")

    def negative_walk(a: pa.Table, r: pa.Table) -> pa.Table:
        return _walk(a, r, negative_window, hardest, columns)
    met = _over_blocks(asked, rows, negative_walk, ", ".join(f"{c} long" for c in columns), block)
    order = Window.partitionBy("anchor", "turn").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "row")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
