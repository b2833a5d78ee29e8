import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fiberlake.llm import quality as q

from .helpers import documents


def brute(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def corpus(rng, n):
    word = lambda: "".join(rng.choice(["the", "re", "ion", "an", "é", "st"]) for _ in range(rng.randrange(1, 4)))
    out = []
    for i in range(n):
        words = [word() + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(rng.randrange(60, 300))]
        if i % 6 == 1:
            words = [w + rng.choice(["%%%", "***", "|"]) for w in words]
        if i % 6 == 2:
            words = words[:8] * 20
        out.append("".join(w + rng.choice([" ", " ", " ", "\n", "\t"]) for w in words))
    return out


def test_features_and_verdicts(spark):
    texts = corpus(random.Random(2), 240) + [None, "", "  ", "a b c a b c a b c", "x " * 60_000, "é\u2003é \x1c z"]
    rows = {r.doc_id: r for r in q.score(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = rows[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        if i < 240:
            assert r.kept == (i % 6 not in (1, 2)), (i, r)
    kept = {r.doc_id for r in q.filter_documents(documents(spark, texts)).collect()}
    assert kept == {i for i, r in rows.items() if r.kept}


def test_fit_recovers_planted_accuracies():
    rng = np.random.default_rng(0)
    families = (0, 0, 0, 1, 1, 1)
    kind = rng.choice(3, 60_000, p=[0.8, 0.12, 0.08])
    chance = np.array([[[0.7, 0.2, 0.1] if c == f + 1 else [0.03, 0.17, 0.8] for c in range(3)] for f in families])
    u = rng.random((60_000, 6))
    edges = chance.cumsum(axis=2)
    votes = np.stack([np.where(u[:, r] < edges[r][kind, 0], -1, np.where(u[:, r] < edges[r][kind, 1], 0, 1)) for r in range(6)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = q.fit(patterns, counts.astype(float), families, (0.03,) * 6)
    assert np.abs(model.prior - [0.8, 0.12, 0.08]).max() < 0.02
    assert np.abs(model.likelihood - chance).max() < 0.06
    best = q.Model(np.array([0.8, 0.12, 0.08]), chance)  # no model can do better than the one that drew the votes
    right, most = (((m.posterior(votes) > 0.5) == (kind == 0)).mean() for m in (model, best))
    assert right > most - 0.003 and most > 0.96


def test_held_out_labels(spark):
    """The model never sees labels; it agrees with them on documents that pass the base rules."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    scored = q.score(spark.read.parquet(f"{sf}/documents.parquet")).filter("not base_failed").collect()
    right = [r.kept == bool(labels[r.doc_id]) for r in scored if r.doc_id in labels]
    assert len(right) > 200 and sum(right) / len(right) > 0.98


def test_odd_tables(spark):
    docs = documents(spark, ["a b"] * 3, ids=[1, 1, None]).withColumn("pattern", F.lit("clash")).withColumn("n_words", F.lit("x"))
    assert [r.base_failed for r in q.score(docs).collect()] == [True] * 3
    assert q.score(docs.limit(0)).count() == 0 and q.filter_documents(docs.limit(0)).count() == 0
    assert q.filter_documents(docs).columns == docs.columns
