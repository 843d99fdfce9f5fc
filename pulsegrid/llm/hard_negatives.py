"""Hard negatives of anchors: rows of another label that score nearly as well
as the anchor's positives.

Anchors are dealt into blocks, each with a minimum spanning tree over its
vectors. For a candidate x and a tree edge from anchor p to anchor c,

    |<c, x> - <p, x>|  <=  |c - p| * |x|,

so a score at the parent bounds the score at the child. Only candidates whose
bounds overlap the child's window of useful scores are scored there; for the
others the bounds go on down the tree. The window of an anchor's positives is
all above its fifth best so far, that of its negatives the margin of its
positives, from below raised to what is still needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import forget, release, stored
from pulsegrid.operators.ranks import with_positions
from pulsegrid.session import shared_dir

BLOCK_BYTES = 16 << 20   # vectors of one block of anchors, as long
BLOCK_ROWS = 4096        # anchors of one block at most
GROUP = 1024             # candidates that go down a tree together
PAIRS = 1 << 16          # pairs that are scored at once

_TREE = "block long, place long, parent long, depth long, edge double, id long, label long, vector array<long>"


# ------------------------------------------------------------ spanning trees

def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prim's minimum spanning tree: the order in which the points join it,
    and by place in that order the parent's place (-1: root), depth and edge."""
    n = len(vectors)
    points = vectors.astype(np.float64)
    squares = (points * points).sum(axis=1)
    best = np.full(n, np.inf)
    nearest = np.full(n, -1)
    order, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    parent, depth = np.full(n, -1), np.zeros(n, np.int64)
    out, at = np.ones(n, bool), 0
    for i in range(n):
        order[i], place[at], out[at] = at, i, False
        if i:
            parent[i] = place[nearest[at]]
            depth[i] = depth[parent[i]] + 1
        away = squares + squares[at] - 2.0 * (points @ points[at])
        closer = out & (away < best)
        best[closer], nearest[closer] = away[closer], at
        at = int(np.argmin(np.where(out, best, np.inf)))
        if not out[at]:
            at = int(np.argmax(out))
            nearest[at] = order[i] if nearest[at] < 0 else nearest[at]
    edge = np.zeros(n)
    if n > 1:
        edge[1:] = np.sqrt(((points[order[1:]] - points[order[parent[1:]]]) ** 2).sum(axis=1))
    return order, parent, depth, edge


def _plant(block: pd.DataFrame) -> pd.DataFrame:
    vectors = np.array(block["vector"].tolist(), np.int64).reshape(len(block), -1)
    order, parent, depth, edge = spanning_tree(vectors)
    return pd.DataFrame({"block": block["block"], "place": np.arange(len(block)), "parent": parent,
                         "depth": depth, "edge": edge, "id": block["id"].to_numpy()[order],
                         "label": block["label"].to_numpy()[order],
                         "vector": [vectors[i] for i in order]})


class Tree:
    """One block of anchors, parents before children."""

    def __init__(self, table: pd.DataFrame):
        table = table.sort_values("place")
        self.ids = table["id"].to_numpy(np.int64)
        self.labels = table["label"].to_numpy(np.int64)
        self.parent = table["parent"].to_numpy(np.int64)
        self.edge = table["edge"].to_numpy(np.float64)
        self.vectors = np.array(table["vector"].tolist(), np.int64).reshape(len(table), -1)
        depth = table["depth"].to_numpy()
        self.levels = [np.nonzero(depth == d)[0] for d in range(int(depth.max()) + 1)]

    def descend(self, vectors: np.ndarray, wanted: Callable, low: np.ndarray, high: np.ndarray
                ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (anchor place, candidate, score) whose score may be in the
        anchor's window [low, high]; ``wanted(places)`` says which candidates
        an anchor may have at all. Scores are exact 64-bit integers, bounds
        have room for the rounding of what they are made from."""
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        size = float(np.abs(vectors).max(initial=0)) * float(np.abs(self.vectors).max(initial=0))
        exact = size * max(vectors.shape[1], 1) < 2.0 ** 53  # doubles hold every sum
        kind = np.float64 if exact else np.int64
        given, anchors = vectors.astype(kind), self.vectors.astype(kind)
        least = np.empty((len(self.ids), len(vectors)))
        most = np.empty_like(least)
        for level in self.levels:
            if level[0] == 0:
                least[level], most[level] = -np.inf, np.inf
            else:
                above, reach = self.parent[level], self.edge[level, None] * norms * (1 + 1e-9) + 1.0
                least[level] = least[above] - reach - 1e-12 * np.abs(least[above])
                most[level] = most[above] + reach + 1e-12 * np.abs(most[above])
            overlap = wanted(level) & (most[level] >= low[level, None]) & (least[level] <= high[level, None])
            if level[0] == 0:
                overlap = overlap | True  # the root's scores bound all others
            who, what = np.nonzero(overlap)
            for a in range(0, len(who), PAIRS):
                rows, cols = level[who[a:a + PAIRS]], what[a:a + PAIRS]
                scores = np.einsum("ij,ij->i", anchors[rows], given[cols]).astype(np.int64)
                least[rows, cols] = most[rows, cols] = scores
                yield rows, cols, scores


def best(group: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group, by score, ties to the smaller id;
    an id counts once in a group, by its best score."""
    order = np.lexsort((-scores, ids, group))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(group[order]) != 0) | (np.diff(ids[order]) != 0)
    order = order[new]
    order = order[np.lexsort((ids[order], -scores[order], group[order]))]
    g = group[order]
    first = np.searchsorted(g, g, side="left")
    return order[np.arange(len(g)) - first < k]


class _Lists:
    """The first k (id, score) of every group, fed bit by bit."""

    def __init__(self, groups: int, k: int):
        self.groups, self.k = groups, k
        self.group = self.ids = self.scores = np.zeros(0, np.int64)

    def add(self, group: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(group):
            group, ids, scores = (np.concatenate(p) for p in (
                (self.group, group), (self.ids, ids), (self.scores, scores)))
            keep = best(group, ids, scores, self.k)
            self.group, self.ids, self.scores = group[keep], ids[keep], scores[keep]

    def last(self) -> np.ndarray:
        """Per group the k-th score, or the least number where it has fewer."""
        out = np.full(self.groups, -np.inf)
        full = np.bincount(self.group, minlength=self.groups) == self.k
        ends = np.searchsorted(self.group, np.nonzero(full)[0], side="right") - 1
        out[full] = self.scores[ends]
        return out


# ------------------------------------------------------------ passes over all rows

def _groups(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        ids = b.column("id").to_numpy(zero_copy_only=False)
        labels = b.column("label").to_numpy(zero_copy_only=False)
        flat = b.column("vector").flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(len(ids), -1) if len(ids) else flat.reshape(0, 0)
        for a in range(0, len(ids), GROUP):
            yield ids[a:a + GROUP], labels[a:a + GROUP], vectors[a:a + GROUP]


def _positives(tree, k: int):
    """Per task and anchor the first k rows of its label."""
    def run(batches):
        t = tree.value
        lists = _Lists(len(t.ids), k)
        for ids, labels, vectors in _groups(batches):
            def wanted(places):
                return (t.labels[places, None] == labels) & (t.ids[places, None] != ids)
            high = np.full(len(t.ids), np.inf)
            found = [(r, ids[c], s) for r, c, s in t.descend(vectors, wanted, lists.last(), high)
                     for ok in [(t.labels[r] == labels[c]) & (t.ids[r] != ids[c])]
                     for r, c, s in [(r[ok], c[ok], s[ok])]]
            lists.add(*(np.concatenate(p) for p in zip(*found)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(lists.group), pa.array(lists.ids), pa.array(lists.scores)], names=["place", "id", "score"])
    return run


def _negatives(tree, positives, k: int, low: int, high: int):
    """Per task, anchor and positive the first k rows of another label whose
    score is from ``low`` to ``high`` percent of the positive's."""
    def run(batches):
        t = tree.value
        place, score = positives.value                      # by place, then list
        lists = _Lists(len(place), k)
        first = np.searchsorted(place, np.arange(len(t.ids)), side="left")
        count = np.searchsorted(place, np.arange(len(t.ids)), side="right") - first
        most = np.full(len(t.ids), -np.inf)
        np.maximum.at(most, place, score * (high / 100) + np.abs(score) * 1e-12)
        floor = score * (low / 100) - np.abs(score) * 1e-12
        # in Python's integers, which 100 * score does not leave
        lowest = np.array([-(-low * int(x) // 100) for x in score], np.int64)
        highest = np.array([high * int(x) // 100 for x in score], np.int64)
        for ids, labels, vectors in _groups(batches):
            def wanted(places):
                return (t.labels[places, None] != labels) & (count[places, None] > 0)
            least = np.full(len(t.ids), np.inf)
            np.minimum.at(least, place, np.maximum(floor, lists.last()))
            for r, c, s in t.descend(vectors, wanted, least, most):
                ok = (t.labels[r] != labels[c]) & (s >= least[r]) & (s <= most[r])
                r, c, s = r[ok], c[ok], s[ok]
                n = count[r]
                pair = np.repeat(np.arange(len(r)), n)
                slot = first[r][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
                s, c = s[pair], c[pair]
                ok = (lowest[slot] <= s) & (s <= highest[slot])
                lists.add(slot[ok], ids[c[ok]], s[ok])
        yield pa.RecordBatch.from_arrays(
            [pa.array(lists.group), pa.array(lists.ids), pa.array(lists.scores)], names=["slot", "id", "score"])
    return run


def _first(found: DataFrame, group: str, k: int) -> DataFrame:
    """The first k of each group over all tasks, with their rank."""
    once = found.groupBy(group, "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), "id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def quantised(vector: str, scale: int = 256) -> F.Column:
    """Each component x as floor(scale * x), x as double; beyond 64 bits the
    nearest 64-bit integer. Null for a vector with a component that is null,
    infinite or no number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def hard_negatives(rows: DataFrame, is_anchor: F.Column, n_positive: int = 5, n_negative: int = 5,
                   low: int = 80, high: int = 100, id_col: str = "vec_id", label: str = "label",
                   vector: str = "vector") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: id, label and a vector of integers; ``is_anchor`` marks the rows
    that are anchors. Scores are integer inner products in 64 bits. An
    anchor's positives are its first ``n_positive`` other rows of its label,
    higher scores first, ties to the smaller id; per positive the first
    ``n_negative`` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    Rows with a null id, label or vector take no part, vectors of different
    lengths are not compared. Of rows with equal ids each counts with its own
    label and vector, an id once in a list by its best score, and no row with
    the anchor's id is its positive; an anchor id that repeats is taken once,
    by its least label and vector. Fewer rows give shorter lists; a positive
    without negatives, or an empty table, gives no rows.

    Every block of anchors takes two passes over the rows of its length; what
    goes to the driver and to the tasks at once is one block (16 MB of
    vectors) and its positives, and lists leave a task already cut.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                        F.col(vector).cast("array<long>").alias("vector"),
                        F.coalesce(is_anchor, F.lit(False)).alias("anchor")).dropna(subset=["id", "label", "vector"])
    given = stored(given, "rows")
    anchors = (given.where("anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a"))
               .select("id", "a.label", "a.vector", F.size("a.vector").alias("length")))
    placed = with_positions(anchors, [F.col("length"), F.col("label"), F.col("vector"), F.col("id")])
    per_block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(
        F.lit(BLOCK_BYTES) / (8 * F.greatest("length", F.lit(1))))))
    blocks = placed.withColumn("block", F.col("length") * (1 << 40) + F.floor(F.col("position") / per_block))
    trees = stored(blocks.select("block", "id", "label", "vector").groupBy("block").applyInPandas(_plant, _TREE), "trees")
    path, some = shared_dir(spark, "hard-negatives"), False
    for (block,) in trees.select("block").distinct().orderBy("block").toLocalIterator():
        table = trees.where(F.col("block") == block).toPandas()   # at most BLOCK_BYTES of vectors
        tree = spark.sparkContext.broadcast(Tree(table))
        same = given.where(F.size("vector") == len(table["vector"].iloc[0])).select("id", "label", "vector")
        found = same.mapInArrow(_positives(tree, n_positive), "place long, id long, score long")
        positives = stored(_first(found, "place", n_positive), "positives")
        lists = positives.toPandas().sort_values(["place", "rank"])  # at most n_positive an anchor
        if len(lists):
            slots = spark.sparkContext.broadcast((lists["place"].to_numpy(), lists["score"].to_numpy()))
            names = lists.reset_index(drop=True)
            names["anchor_id"] = tree.value.ids[names["place"].to_numpy()]
            names["slot"] = np.arange(len(names))
            named = spark.createDataFrame(names[["slot", "anchor_id", "id", "score"]],
                                          "slot long, anchor_id long, positive_id long, positive_score long")
            found = same.mapInArrow(_negatives(tree, slots, n_negative, low, high),
                                    "slot long, id long, score long")
            (_first(found, "slot", n_negative).join(named, "slot")
             .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
                     "positive_score", F.col("score").alias("negative_score"))
             .write.mode("append").parquet(path))
            some = True
            slots.unpersist()
        tree.unpersist()
        forget(positives)
        release(spark)
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
              "negative_score long")
    return spark.read.schema(schema).parquet(path) if some else spark.createDataFrame([], schema)
