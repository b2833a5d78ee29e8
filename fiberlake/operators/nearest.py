"""The nearest point of a table to each row of another, by a tree of boxes.

Points (pos, x, y) are split at medians into leaves of about LEAF points, and each node of the tree has the box of its
points. A batch of probes goes down the tree together: once to the nearest leaf of each, which bounds its distance, then
over all nodes whose box is within that bound. So a probe looks at few leaves, however many points there are.

The tree of at most HELD points is broadcast and the search is a projection without a shuffle. More points are cut into
blocks of consecutive pos. The blocks' boxes are broadcast, each probe goes to the blocks that may hold its nearest
point, and the best of them is kept. A block's probes are dealt to as many groups as keep one under PROBES rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 16
#: Points of a broadcast tree (24 bytes each) and of a block.
HELD = 1 << 20
BLOCK = 1 << 16
#: Probes of a group on average, if all go to one block.
PROBES = 1 << 18
#: Pairs of a probe and a leaf that are measured at once.
PAIRS = 1 << 15
#: Boxes are pruned with this much to spare for rounding.
SLACK = 1 + 1e-9


class Tree:
    def __init__(self, pos: np.ndarray, x: np.ndarray, y: np.ndarray):
        order = np.lexsort((pos, y, x))
        same = np.zeros(len(order), bool)
        same[1:] = (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])
        order = order[~same]  # of equal places the smallest pos
        self.depth = max(0, int(np.ceil(np.log2(max(len(order), 1) / LEAF))))
        self.edges = np.linspace(0, len(order), (1 << self.depth) + 1).astype(np.int64)
        for level in range(self.depth):
            step = 1 << (self.depth - level)
            for a, m, b in zip(self.edges[:-1:step], self.edges[step // 2 :: step], self.edges[step::step], strict=True):
                own = order[a:b]
                key = x[own] if np.ptp(x[own]) >= np.ptp(y[own]) else y[own]
                order[a:b] = own[np.argpartition(key, min(m - a, b - a - 1))]
        self.pos, self.x, self.y = pos[order], x[order], y[order]
        self.boxes = []  # of each level: least x, least y, greatest x, greatest y
        if len(order):
            at = self.edges[:-1]
            box = np.stack([np.minimum.reduceat(self.x, at), np.minimum.reduceat(self.y, at), np.maximum.reduceat(self.x, at), np.maximum.reduceat(self.y, at)])
            self.boxes.append(box)
            while box.shape[1] > 1:
                box = np.concatenate([np.minimum(box[:2, ::2], box[:2, 1::2]), np.maximum(box[2:, ::2], box[2:, 1::2])])
                self.boxes.append(box)
            self.boxes.reverse()

    def _off(self, level: int, node: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Squared distance of each place from a node's box."""
        box = self.boxes[level][:, node]
        dx, dy = np.maximum(np.maximum(box[0] - x, x - box[2]), 0), np.maximum(np.maximum(box[1] - y, y - box[3]), 0)
        return dx * dx + dy * dy

    def _measure(self, leaf: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least distance of each place to a leaf's points, and the smallest pos that has it."""
        widest = int(np.diff(self.edges).max())
        at = np.minimum(self.edges[leaf][:, None] + np.arange(widest), self.edges[leaf + 1][:, None] - 1)
        dx, dy = x[:, None] - self.x[at], y[:, None] - self.y[at]
        away = np.sqrt(dx * dx + dy * dy)
        best = away.min(axis=1)
        return best, np.where(away == best[:, None], self.pos[at], np.iinfo(np.int64).max).min(axis=1)

    def search(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance, pos) of the nearest point to each place; (NaN, -1) for places that are not finite."""
        best, pos = np.full(len(x), np.nan), np.full(len(x), -1, np.int64)
        good = np.flatnonzero(np.isfinite(x) & np.isfinite(y)) if self.boxes else np.zeros(0, np.int64)
        for at in range(0, len(good), 4096):
            rows = good[at : at + 4096]
            best[rows], pos[rows] = self._search(x[rows], y[rows])
        return best, pos

    def _search(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node = np.zeros(len(x), np.int64)
        for level in range(1, self.depth + 1):
            left = 2 * node
            node = left + (self._off(level, left + 1, x, y) < self._off(level, left, x, y))
        best, pos = self._measure(node, x, y)
        near = best * best * SLACK
        probe, there = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(1, self.depth + 1):
            probe, there = np.repeat(probe, 2), (2 * there[:, None] + np.arange(2)).ravel()
            within = self._off(level, there, x[probe], y[probe]) <= near[probe]
            probe, there = probe[within], there[within]
        for at in range(0, len(probe), PAIRS):
            p, leaf = probe[at : at + PAIRS], there[at : at + PAIRS]
            away, found = self._measure(leaf, x[p], y[p])
            order = np.lexsort((found, away, p))
            p, away, found = p[order], away[order], found[order]
            first = np.ones(len(p), bool)
            first[1:] = p[1:] != p[:-1]
            p, away, found = p[first], away[first], found[first]
            better = (away < best[p]) | ((away == best[p]) & (found < pos[p]))
            best[p[better]], pos[p[better]] = away[better], found[better]
        return best, pos


FOUND = "dist_m double, pos long"


def _found(best: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"dist_m": best, "pos": pd.Series(pos, dtype="Int64").where(pos >= 0)})  # NaN counts as null


def nearest(probes: DataFrame, points: DataFrame, x: str, y: str, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """probes with dist_m and pos of the nearest point (the smallest pos of equals), null where there is none. points:
    (pos, x, y) with pos from 0 on; points without a place are left out."""
    points = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)").select(F.col("pos").cast("long").alias("pos"), "x", "y")
    if points.count() > held:
        return _by_blocks(probes, points, x, y, block)
    rows = points.toPandas()  # at most `held` points
    tree = probes.sparkSession.sparkContext.broadcast(Tree(*(rows[c].to_numpy() for c in ("pos", "x", "y"))))

    @F.pandas_udf(FOUND)
    def search(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return _found(*tree.value.search(a.to_numpy(float), b.to_numpy(float)))

    found = probes.withColumn("__found", search(F.col(x).cast("double"), F.col(y).cast("double")))
    return found.select(*probes.columns, "__found.dist_m", "__found.pos")


def _by_blocks(probes: DataFrame, points: DataFrame, x: str, y: str, block: int) -> DataFrame:
    spark = probes.sparkSession
    points = points.withColumn("__block", F.floor(F.col("pos") / block))
    rows = points.groupBy("__block").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).toPandas()  # a row for `block` points
    boxes = spark.sparkContext.broadcast(rows.to_numpy(float))

    @F.pandas_udf("array<long>")
    def blocks(a: pd.Series, b: pd.Series) -> pd.Series:
        number, left, low, right, high = boxes.value.T
        out = []
        for px, py in zip(a.to_numpy(float), b.to_numpy(float), strict=True):
            dx, dy = np.maximum(np.maximum(left - px, px - right), 0), np.maximum(np.maximum(low - py, py - high), 0)
            fx, fy = np.maximum(np.abs(px - left), np.abs(px - right)), np.maximum(np.abs(py - low), np.abs(py - high))
            out.append(number[dx * dx + dy * dy <= (fx * fx + fy * fy).min() * SLACK].astype(np.int64))
        return pd.Series(out)

    keyed = probes.withColumn("__id", F.monotonically_increasing_id())
    groups = max(1, -(-probes.count() // PROBES))
    asked = keyed.select("__id", F.col(x).cast("double").alias("__px"), F.col(y).cast("double").alias("__py")).filter("__px is not null and __py is not null")
    asked = asked.withColumn("__block", F.explode(blocks("__px", "__py"))).withColumn("__group", F.pmod(F.xxhash64("__id"), F.lit(groups)))
    dealt = points.withColumn("__group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(*(right[c].to_numpy() for c in ("pos", "x", "y")))
        best, pos = tree.search(left["__px"].to_numpy(float), left["__py"].to_numpy(float))
        return pd.DataFrame({"__id": left["__id"], "dist_m": best, "pos": pos})[pos >= 0]

    met = asked.groupBy("__block", "__group").cogroup(dealt.groupBy("__block", "__group")).applyInPandas(search, f"__id long, {FOUND}")
    best = met.groupBy("__id").agg(F.min(F.struct("dist_m", "pos")).alias("__found"))
    return keyed.join(best, "__id", "left").select(*probes.columns, "__found.dist_m", "__found.pos")
