"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors is joined to its nearest neighbours; the graph is cut into balanced partitions by
recursive bisection; a small classifier learns, for each vector of the sample, how its neighbours spread over the
partitions. Every vector is indexed in its most probable partition. A query goes to its several most probable
partitions, as many as held-out queries of the sample need for the target recall, and all vectors there are ranked by
exact distance. A query that finds fewer than k rows there searches all partitions.

A model has MAX_PARTITIONS partitions at most. While those would hold over 2 * ROWS_A_PARTITION vectors, each is cut again
by a model of its own, fitted on a bounded sample of its vectors, so that a partition's size does not grow with the
table. The root's model is broadcast; the others are a table, which vectors and queries meet by partition.

Equal vectors are one vector of the index with their k + 1 smallest ids, which is all that k neighbours can need, and
equal queries are searched once, so that a vector that a third of all rows share is no crowded partition. A partition is
searched in blocks of at most BLOCK vectors: a block is held and its queries stream by, so no vector is sent twice.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stored, table

#: Vectors that a graph and a classifier are fitted on; a bounded sample by design.
SAMPLE = 6144
HELD_OUT = 512
#: Vectors that a partition has on average; small tables have partitions of LEAF times the square root of their size.
ROWS_A_PARTITION, LEAF = 2048, 8
MAX_PARTITIONS = 64
BLOCK = 8192
#: Vectors that a task takes through one model.
ROUTED = 65536


def neighbours(x: np.ndarray, of: np.ndarray, k: int, same: bool) -> np.ndarray:
    """The k nearest rows of x to each row of `of`, in blocks; with same, a row is not its own neighbour."""
    out = np.empty((len(of), k), np.int64)
    norm = (x * x).sum(axis=1)
    for at in range(0, len(of), 1024):
        d = norm[None, :] - 2 * of[at : at + 1024] @ x.T
        if same:
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[at : at + 1024] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1), 1)
    return out


def balanced_partition(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Partition number of each node of a neighbour graph; parts is a power of two and sizes differ by one a level.

    Each bisection splits a smoothed random vector (power iteration on the graph, which approaches its second
    eigenvector) at the median and then swaps the nodes that gain most by it.
    """
    n = len(near)
    source, target = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    ends = np.concatenate([source, target]), np.concatenate([target, source])
    label = np.zeros(n, np.int64)
    for _ in range(parts.bit_length() - 1):
        after = label * 2
        inside = label[ends[0]] == label[ends[1]]
        a, b = ends[0][inside], ends[1][inside]
        degree = np.bincount(a, minlength=n) + 1e-9
        x = rng.standard_normal(n)
        sizes = np.bincount(label)
        for _ in range(80):
            x -= (np.bincount(label, weights=x * degree) / np.bincount(label, weights=degree))[label]
            x = 0.5 * x + 0.5 * np.bincount(a, weights=x[b], minlength=n) / degree
            x /= np.sqrt(np.bincount(label, weights=x * x) / sizes)[label] + 1e-12
        for p in range(len(sizes)):
            own = np.flatnonzero(label == p)
            after[own[np.argsort(x[own], kind="stable")[len(own) // 2 :]]] += 1
        for _ in range(12):
            same = np.bincount(a, weights=after[a] == after[b], minlength=n)
            gain = (np.bincount(a, minlength=n) - same) - same
            moved = False
            for p in range(len(sizes)):
                low, high = (np.flatnonzero(after == 2 * p + s) for s in (0, 1))
                low, high = low[np.argsort(-gain[low])], high[np.argsort(-gain[high])]
                m = min(len(low), len(high))
                count = int((gain[low[:m]] + gain[high[:m]] > 0).sum()) // 2
                if count:
                    after[low[:count]], after[high[:count]] = 2 * p + 1, 2 * p
                    moved = True
            if not moved:
                break
        label = after
    return label


class Classifier:
    """A network with one hidden layer, from a standardised vector to partition probabilities."""

    def __init__(self, x: np.ndarray, goal: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 40):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        sizes = [(x.shape[1], hidden), (hidden, goal.shape[1])]
        self.layers = [(rng.standard_normal(s) * np.sqrt(2 / s[0]), np.zeros(s[1])) for s in sizes]
        moments = [[np.zeros_like(v), np.zeros_like(v)] for layer in self.layers for v in layer]
        z, step = (x - self.mean) / self.scale, 0
        for epoch in range(epochs):
            rate = 3e-3 * (1 - epoch / epochs)
            for own in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
                step += 1
                (w1, b1), (w2, b2) = self.layers
                h = np.maximum(z[own] @ w1 + b1, 0)
                e = h @ w2 + b2
                p = np.exp(e - e.max(axis=1, keepdims=True))
                d = (p / p.sum(axis=1, keepdims=True) - goal[own]) / len(own)
                back = (d @ w2.T) * (h > 0)
                for value, grad, m in zip((w1, b1, w2, b2), (z[own].T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ d + 1e-4 * w2, d.sum(axis=0)), moments, strict=True):
                    m[0] = 0.9 * m[0] + 0.1 * grad
                    m[1] = 0.999 * m[1] + 0.001 * grad * grad
                    value -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        (w1, b1), (w2, b2) = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2


@dataclass
class Model:
    parts: int
    probes: int
    classifier: Classifier | None

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """All partitions of each vector, the most probable first."""
        if self.classifier is None or not len(x):
            return np.zeros((len(x), 1), np.int64)
        return np.argsort(-self.classifier.scores(x), axis=1, kind="stable")


def levels_of(rows: int) -> int:
    """How many models lead from the root to a partition."""
    n, left = 1, rows / MAX_PARTITIONS
    while left > 2 * ROWS_A_PARTITION:
        n, left = n + 1, left / MAX_PARTITIONS
    return n


def fit(sample: np.ndarray, rows: int, k: int = 10, recall: float = 0.97, seed: int = 7) -> Model:
    """The model of a sample, for an index of so many vectors. Equal vectors count once. A handful of vectors gets a
    single partition, which is exact search."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0) if len(sample) else sample
    leaf = min(ROWS_A_PARTITION, LEAF * max(rows, 1) ** 0.5)
    parts = 1 << int(np.clip(np.round(np.log2(max(1.0, rows / leaf))), 0, MAX_PARTITIONS.bit_length() - 1))
    while parts > 1 and len(sample) < 32 * parts:
        parts //= 2
    if parts == 1:
        return Model(1, 1, None)
    sample = sample[rng.permutation(len(sample))]
    held, x = sample[: min(HELD_OUT, len(sample) // 8)], sample[min(HELD_OUT, len(sample) // 8) :]
    near = neighbours(x, x, k, True)
    label = balanced_partition(near, parts, rng)
    goal = np.zeros((len(x), parts))
    for j in range(k):
        np.add.at(goal, (np.arange(len(x)), label[near[:, j]]), 1 / (k + 1))
    goal[np.arange(len(x)), label] += 1 / (k + 1)
    classifier = Classifier(x, goal, rng)
    # vectors are indexed where the classifier puts them, so recall is measured there
    own = np.argmax(classifier.scores(x), axis=1)
    want = own[neighbours(x, held, k, False)]
    order = np.argsort(-classifier.scores(held), axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    depth = np.take_along_axis(place, want, 1)
    found = [(depth < t).mean() for t in range(1, parts + 1)]
    return Model(parts, 1 + int(np.argmax(np.array(found) >= recall)), classifier)


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v): rows with an id and a vector that is not null, empty, zero or holding null or non-finite components.
    Vectors of another length than most are no neighbours of those and take no part."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(finite & F.exists("v", lambda x: x != 0))
    sizes = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return clean.filter(F.size("v") == (sizes[0].n if sizes else 0))


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def _deeper(index: DataFrame, k: int, recall: float) -> DataFrame:
    """(part, model): a model for each partition that is to be cut again, fitted on a sample of its vectors."""
    sizes = index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * ROWS_A_PARTITION)
    share = F.lit(float(1 << 52)) * F.lit(SAMPLE) / F.col("n")
    sample = index.join(F.broadcast(sizes), "part").filter(F.shiftrightunsigned(F.xxhash64(F.lit(1), "v"), 12) < share)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = fit(np.stack(pdf["v"].to_numpy()), int(pdf["n"].iloc[0]), k, recall)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "model": [pickle.dumps(model)]})

    return stored(sample.groupBy("part").applyInPandas(lambda pdf: run(pdf), "part long, model binary"))


def _through(rows: DataFrame, models: DataFrame, every: bool) -> DataFrame:
    """rows (part, v, ..) with part at the next level: the most probable one, or with `every` a row for each that a query
    searches. Rows of large partitions are dealt out."""
    deals = models.join(rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / ROUTED).cast("int").alias("deals")), "part").select("part", "deals")
    dealt = rows.join(F.broadcast(deals), "part", "left").withColumn("deal", F.pmod(F.xxhash64("v"), F.coalesce("deals", F.lit(1))).cast("int")).drop("deals")
    copies = models.join(F.broadcast(deals), "part").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.drop(columns="deal")
        if not len(left) or not len(right):
            return left.assign(part=left["part"] * MAX_PARTITIONS)
        model = pickle.loads(right["model"].iloc[0])
        ranked = model.ranked(np.stack(left["v"].to_numpy()))[:, : model.probes if every else 1]
        out = left.loc[left.index.repeat(ranked.shape[1])]
        return out.assign(part=out["part"].to_numpy() * MAX_PARTITIONS + ranked.ravel())

    return dealt.groupBy("part", "deal").cogroup(copies.groupBy("part", "deal")).applyInPandas(run, rows.schema)


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 10, id_column: str = "vec_id", column: str = "embedding", recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that is_query (over `id`) selects, by
    Euclidean distance in double precision, ties to the smaller id. Rows with the query's own id are no candidates.

    A query finds all candidates if they are fewer than k. Ids should be unique; rows that share one are one candidate
    at their smallest distance. An empty table gives an empty table.
    """
    clean = usable(vectors, id_column, column)
    # Spark keeps the k + 1 first rows of a group before it shuffles
    first = clean.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    classes = stored(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    rows = classes.count()
    picked = classes.orderBy(F.xxhash64("v"), "v").select("v").limit(SAMPLE).collect()
    levels = levels_of(rows)
    each = recall ** (1 / levels)
    model = fit(np.array([r[0] for r in picked], float), rows, k, each)
    shared = clean.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<long>")
    def ranked(v: pa.Array) -> pa.Array:
        found = shared.value.ranked(_matrix(v, len(v)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel().astype(np.int64)))

    index = stored(classes.withColumn("part", ranked("v")[0]))
    goals = stored(clean.filter(is_query).select("v").distinct().withColumn("ranked", ranked("v")).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")}))
    asked = goals.select("h", "g", "v", F.explode(F.slice("ranked", 1, model.probes)).alias("part"))
    whole = model.probes == model.parts
    for _ in range(levels - 1):
        models = _deeper(index, k, each)
        index, asked, whole = stored(_through(index, models, False)), _through(asked, models, True), False
    found = stored(_search(index, asked, k))
    if not whole:
        enough = found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k).select("h", "g")
        short = stored(goals.join(enough, ["h", "g"], "left_anti").select("h", "g", "v"))
        if not short.isEmpty():
            every = index.select("part").distinct()  # few queries, each to every partition by design
            again = _search(index, short.crossJoin(every), k)
            found = found.join(short.select("h", "g"), ["h", "g"], "left_anti").unionByName(again)
    own = clean.filter(is_query).select(F.col("id").alias("query_id"), F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    near = own.join(found, ["h", "g"]).filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(h, g, vec_id, score): the k + 1 nearest ids to each query vector (h, g, v, part) among those of its partitions."""
    blocks = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    none = F.lit(None).cast("array<long>")
    held = index.join(blocks, "part").select("part", F.pmod(F.xxhash64(F.lit(2), "v"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("g"), "v", "ids")
    goals = asked.join(blocks, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "h", "g", "v", none.alias("ids"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of part, block and kind: a block's vectors and then its queries."""
        now, x, ids, owner = None, [], [], []
        ready = False
        for batch in batches:
            part, block, kind, h, g = (batch.column(i).to_numpy() for i in range(5))
            vectors = _matrix(batch.column(5), batch.num_rows)
            out: list[list] = [[], [], [], []]
            edges = np.flatnonzero(np.concatenate([[True], (np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0), [True]])[: batch.num_rows + 1])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if (part[a], block[a]) != now:
                    now, x, ids, owner, ready = (part[a], block[a]), [], [], [], False
                if kind[a] == 0:
                    lists = batch.column(6).slice(a, b - a)
                    base = sum(map(len, x))
                    x.append(vectors[a:b])
                    ids.append(lists.flatten().to_numpy())
                    owner.append(base + np.repeat(np.arange(b - a), lists.value_lengths().to_numpy()))
                    continue
                if not x:
                    continue
                if not ready:
                    x, ids, owner, ready = [np.concatenate(x)], [np.concatenate(ids)], [np.concatenate(owner)], True
                m = min(k + 1, len(x[0]))
                for q in range(a, b):
                    d = np.sqrt(((x[0] - vectors[q]) ** 2).sum(axis=1))
                    edge = np.partition(d, m - 1)[m - 1]
                    own = np.flatnonzero(d[owner[0]] <= edge)
                    own = own[np.lexsort((ids[0][own], d[owner[0][own]]))][: k + 1]
                    for column, values in zip(out, (np.full(len(own), h[q]), np.full(len(own), g[q]), ids[0][own], d[owner[0][own]]), strict=True):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["h", "g", "vec_id", "score"])

    dealt = held.unionByName(goals).repartition(partitions(index.sparkSession), "part", "block").sortWithinPartitions("part", "block", "kind")
    near = dealt.mapInArrow(rank, "h long, g long, vec_id long, score double").groupBy("h", "g", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("h", "g").orderBy("score", "vec_id")
    return near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)
