import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fiberlake.llm import substring_dedup as sd

from .helpers import documents


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    times = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if times[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def corpus(rng, words=4000):
    word = lambda: f"w{rng.randrange(words)}é"
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 90, 200)]
    texts = []
    for i in range(120):
        body = [word() for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) - 34)) if rng.random() < 0.5 else 0
            at = rng.randrange(len(body) + 1)
            body[at:at] = p[a : a + rng.randrange(30, 200)]
            if rng.random() < 0.3:
                body[rng.randrange(len(body))] = word()
        texts.append(rng.choice([" ", "\n", "\t \r"]).join(body))
    texts += [None, "", " \n", "the " * 34, "the " * 35, "so on " * 300, "so on " * 40, texts[0], texts[0], texts[1] + " more", "a b c d e f g " * 9]
    return texts


@pytest.mark.parametrize("group, filter_bits", [(1000, 1 << 29), (3, 1 << 29), (0, 1 << 29), (1000, 0)])
def test_against_brute_force(spark, monkeypatch, group, filter_bits):
    monkeypatch.setattr(sd, "GROUP", group)
    texts = corpus(random.Random(group))
    rows = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in sd.dedup_substrings(documents(spark, texts), max_filter_bits=filter_bits).collect()}
    want = brute(texts, 35)
    assert [rows[i] for i in range(len(texts))] == want
    assert sum(r for _, r, _ in want) > 1000


def test_both_extensions_agree():
    rng = random.Random(8)
    for _ in range(200):
        classes = []
        for _ in range(rng.randrange(1, 30)):
            p = rng.randrange(5)
            n = rng.randrange(1, p + 2)
            words = [rng.choice([b"a", b"b"]) for _ in range(p)] + [b"s", b"s"] + [rng.choice([b"a", b"b"]) for _ in range(n + 6 - 1 - p - 2)]
            classes.append((words, p, n, rng.choice([1, 1, 1, 2])))
        assert sd.extend_pairs(classes, 6, 2) == sd.extend_all(classes, 6, 2)


def test_odd_tables(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = documents(spark, [passage, passage, "x " + passage, "other text", None], ids=[3, 3, None, 4, None])
    docs = docs.withColumn("found", F.lit("clash")).withColumn("n_words", F.lit("x")).withColumn("key", F.lit(1))
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in sd.dedup_substrings(docs).collect()), key=str)
    assert got == sorted([(3, "", 40), (3, "", 40), (None, "x", 40), (4, "other text", 0), (None, "", 0)], key=str)
    assert sd.dedup_substrings(docs.limit(0)).count() == 0


def test_long_text(spark):
    rng = random.Random(1)
    long = " ".join(f"v{rng.randrange(10**9)}" for _ in range(120_000))
    rows = {r.doc_id: r for r in sd.dedup_substrings(documents(spark, [long, long + " end", "q"])).collect()}
    assert (rows[0].n_removed, rows[1].n_removed, rows[1].text, rows[1].removed_spans) == (120_000, 120_000, "end", [[0, 120_000]])
