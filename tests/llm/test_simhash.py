import random

import pytest
import xxhash
from pyspark.sql import functions as F

from fiberlake.llm import simhash
from fiberlake.llm.components import connected_components

from .helpers import documents


def brute_fingerprint(text, n=3):
    words = [w for w in __import__("re").split(r"[ \t-\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=3):
    """fps: id to fingerprint; the smallest id that links reach."""
    comp = {}
    for root in sorted(fps):
        if root in comp:
            continue
        queue = [root]
        comp[root] = root
        while queue:
            a = queue.pop()
            for b in fps:
                if b not in comp and (fps[a] ^ fps[b]).bit_count() <= bits:
                    comp[b] = root
                    queue.append(b)
    return comp


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"W{i}é" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randrange(40, 400))] for _ in range(25)]
    texts = [None, "", "  \n", "one", "ONE", "one two", "one two three", "x " * 30_000]
    for b in base:
        for _ in range(4):
            v = list(b)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = rng.choice(words)
            texts.append(" ".join(v))
    texts += texts[10:20]
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(fps)
    got = simhash.near_duplicates(documents(spark, texts)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(set(want.values())) < len(want) - 20


@pytest.mark.parametrize("block", [7, 4096])
def test_links_of_random_fingerprints(spark, block, monkeypatch):
    rng = random.Random(block)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(400):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randrange(1, 5)):
            x ^= 1 << b
        fps.append(x)
    fps = dict(enumerate(sorted(set(fps))))
    monkeypatch.setattr(simhash, "BLOCK", block)
    classes = spark.createDataFrame([(i, f - (f >> 63 << 64)) for i, f in fps.items()], "id long, fp long")
    reach = {r.node: r.component for r in connected_components(simhash.links(classes)).collect()}
    want = brute_components(fps)
    assert {i: reach.get(i, i) for i in fps} == want


def test_odd_tables(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "q", None], ids=[4, None, None, None]).withColumn("fp", F.lit("clash"))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(4, 4), (None, 4), (None, None), (None, None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.dedup(docs).collect()
    assert {r.doc_id for r in kept} >= {4} and simhash.dedup(docs).columns == docs.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7), (300, 150), (150, 299)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 150: 150, 299: 150, 300: 150}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(3000)}"
    texts, group = [], []
    for g in range(60):
        base = [word() for _ in range(rng.randrange(200, 700))]
        for c in range(g % 4 + 1):
            v = list(base)
            for _ in range(c and len(v) // 250 + 1):
                v[rng.randrange(len(v))] = word()
            texts.append(" ".join(v))
            group.append(g)
    shingles = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    like = [len(shingles[i] & shingles[group.index(g)]) / len(shingles[i] | shingles[group.index(g)]) for i, g in enumerate(group)]
    assert min(like) > 0.85
    kept = {r.doc_id for r in simhash.dedup(documents(spark, texts)).collect()}
    assert kept == {group.index(g) for g in set(group)}


def test_wide_links_in_blocks(spark, monkeypatch):
    """A dense group is linked as a whole when it is dealt out in blocks."""
    rng = random.Random(2)
    base = rng.getrandbits(512)
    fps = {base ^ sum(1 << b for b in rng.sample(range(512), rng.randrange(20))) for _ in range(120)} | {rng.getrandbits(512) for _ in range(40)}
    rows = [(i, f.to_bytes(64, "little")) for i, f in enumerate(sorted(fps))]
    want = brute_components({i: int.from_bytes(f, "little") for i, f in rows}, 81)
    classes = spark.createDataFrame(rows, "id long, fp binary")
    for block in (4096, 30):
        monkeypatch.setattr(simhash, "BLOCK", block)
        reach = {r.node: r.component for r in connected_components(simhash.wide_links(classes, 81)).collect()}
        assert {i: reach.get(i, i) for i, _ in rows} == want
