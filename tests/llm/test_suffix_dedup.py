import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fiberlake.llm import suffix_dedup as sd
from fiberlake.llm import twice

from .helpers import documents


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - window + 1):
            if times[d[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def corpus(rng, letters="abcdé fgh\n"):
    part = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [part(n) for n in (39, 40, 41, 60, 150, 400)]
    texts = []
    for _ in range(90):
        body = part(rng.randrange(200))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p)) if rng.random() < 0.4 else 0
            at = rng.randrange(len(body) + 1)
            body = body[:at] + p[a : a + rng.randrange(20, 400)] + body[at:]
            if rng.random() < 0.3:
                at = rng.randrange(len(body))
                body = body[:at] + "z" + body[at + 1 :]
        texts.append(body)
    texts += [None, "", "a" * 39, "a" * 40, "a" * 300, "ab" * 200, texts[0], texts[0], texts[1] + "more", "é" * 60, "é" * 90]
    return texts


@pytest.mark.parametrize("shard_bytes, memory, group, filter_bits", [(1 << 20, 1 << 20, 1000, 1 << 29), (2000, 1 << 20, 1000, 1 << 29), (1 << 20, 500, 1000, 1 << 29), (2000, 1 << 20, 3, 1 << 29), (2000, 1 << 20, 0, 0)])
def test_against_brute_force(spark, monkeypatch, shard_bytes, memory, group, filter_bits):
    monkeypatch.setattr(sd, "GROUP", group)
    texts = corpus(random.Random(shard_bytes + memory + group))
    got = sd.dedup_bytes(documents(spark, texts), window=40, gram=8, shard_bytes=shard_bytes, memory=memory, max_filter_bits=filter_bits).collect()
    rows = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed_spans), bytes(r.kept)) for r in got}
    assert [rows[i] for i in range(len(texts))] == brute(texts, 40)


def test_production_window(spark):
    rng = random.Random(4)
    texts = corpus(rng, "abcdefgh ")
    long = "".join(rng.choice("abcdefghij") for _ in range(60_000))
    texts += [long[:20_000], "x" + long[10_000:11_000] + "y" + long[500:899] + long[899:1300], long[:399] + "q", long[30_000:], long[30_000:]]
    got = sd.dedup_bytes(documents(spark, texts)).collect()
    rows = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed_spans), bytes(r.kept)) for r in got}
    assert [rows[i] for i in range(len(texts))] == brute(texts, 400)


def test_odd_tables(spark):
    passage = "".join(random.Random(2).choice("abcdefg") for _ in range(50))
    docs = documents(spark, [passage, passage, "x" + passage, "other", None], ids=[3, 3, None, 4, None])
    docs = docs.withColumn("found", F.lit("clash")).withColumn("kept", F.lit("x")).withColumn("spans", F.lit(1))
    got = sorted(((r.doc_id, bytes(r.kept), r.n_removed) for r in sd.dedup_bytes(docs, window=40, gram=8).collect()), key=str)
    assert got == sorted([(3, b"", 50), (3, b"", 50), (None, b"x", 50), (4, b"other", 0), (None, b"", 0)], key=str)
    assert sd.dedup_bytes(docs.limit(0)).count() == 0


def test_only_classes_that_may_share_a_string_are_sorted(spark):
    """A short passage that all texts hold gives them one anchor, but no string of `window` bytes."""
    rng = random.Random(8)
    part = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, shared = part(30), part(30)
    texts = [part(60) + passage + part(60) for _ in range(60)]
    texts += [part(60) + shared + passage + part(60) for _ in range(3)] + [part(30) + passage + shared[:20]] * 2
    runs = []
    for t in texts[:63]:
        at = t.index(passage)
        run = t[at - 10 : at + 40].encode()
        runs.append((run[:16], run, 10, 11, 1))
    assert sd._meeting(runs, 40, 30) == {60, 61, 62}
    got = sd.dedup_bytes(documents(spark, texts), window=40, gram=30).collect()
    rows = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed_spans), bytes(r.kept)) for r in got}
    assert [rows[i] for i in range(len(texts))] == brute(texts, 40)


def test_full_filter_serves_on(spark):
    """A filter of the largest size is used down to 4 bits a hash; beyond that hashes are counted."""
    rows = documents(spark, [f"text {i // 2}" for i in range(1000)])
    hashes = lambda batch: sd.np.array([sd.xxhash.xxh3_64_intdigest(t.as_py()) for t in batch.column(0)], sd.np.uint64)
    for expected, filtered in ((twice.MIN_FILTER_BITS // 8, True), (twice.MIN_FILTER_BITS // 4, True), (twice.MIN_FILTER_BITS // 2, False)):
        found = twice.suspects(rows.select("doc_id", "text"), ["doc_id"], "text", hashes, F.lit(expected) / 1000, twice.MIN_FILTER_BITS)
        assert (twice.SUSPECTS not in found.rows.columns) == filtered
