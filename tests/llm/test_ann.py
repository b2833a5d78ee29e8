import numpy as np
import pytest
from pyspark.sql import functions as F

from fiberlake.llm import ann


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        v = x[ids.index(q)]
        d = sorted((float(np.sqrt(((y - v) ** 2).sum())), i) for i, y in zip(ids, x, strict=True) if i != q)[:k]
        out[q] = d
    return out


def frame(spark, ids, x):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    data = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    assert ann.fit(np.array(list(data.values())), len(data)).parts > 1
    assert recall(data, ann.nearest(df, F.col("id") % 20 == 0).collect(), 20) >= 0.9


def recall(data, got, step):
    """Of the ten nearest; scores, ranks and their order must be exact."""
    want = brute(list(data), list(data.values()), [i for i in data if i % step == 0])
    hits = total = 0
    for q, near in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - np.sqrt(((data[r.vec_id] - data[q]) ** 2).sum())) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & {i for _, i in near})
        total += 10
    return hits / total


def test_partitions_are_cut_again(spark, monkeypatch):
    for name, value in (("ROWS_A_PARTITION", 64), ("MAX_PARTITIONS", 8), ("ROUTED", 100)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((60, 16)) * 3)[rng.integers(60, size=4000)] + rng.standard_normal((4000, 16))
    x[1000:2200] = x[7]  # a third of all rows are one vector
    assert ann.levels_of(2800) == 2
    data = dict(enumerate(x.astype(np.float32).astype(float)))
    df = frame(spark, list(data), list(data.values())).repartition(5)
    assert recall(data, ann.nearest(df, F.col("id") % 40 == 0).collect(), 40) >= 0.9


def test_model_uses_few_of_many_partitions():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((64, 16)) * 4
    x = centres[rng.integers(64, size=6000)] + rng.standard_normal((6000, 16))
    model = ann.fit(x, 16 * ann.ROWS_A_PARTITION)
    assert model.parts == 16 and model.probes <= 8
    sizes = np.bincount(model.ranked(x)[:, 0], minlength=16)
    assert sizes.min() > 100


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 100, None, 8, 9]
    x = [[1, 0], [1, 0], [1, 0], None, [0, 0], [nan, 1], [inf, 1], [None, 1], [2, 0], [1, 1], [], [1, 2, 3]]
    df = frame(spark, ids, x).withColumn("id", F.lit("clash")).withColumn("part", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("id") % 100 == 0).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 1.0), (100, 1, 0, 1.0), (100, 2, 1, 1.0), (100, 3, 2, 1.0)]
    assert ann.nearest(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(1)
    x = [np.float32(v) for v in np.vstack([np.repeat(rng.standard_normal((1, 4)), 300, 0), rng.standard_normal((200, 4))]).astype(np.float32)]
    ids = list(range(500))
    want = brute(ids, [v.astype(float) for v in x], [0, 100, 200, 300, 400])
    got = ann.nearest(frame(spark, ids, x), F.col("id") % 100 == 0).collect()
    for q, near in want.items():
        assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == near
