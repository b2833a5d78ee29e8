import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiberlake.llm import near_copies, simhash

from .helpers import documents


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(texts):
    """Positions of the first text of each group of links at 0.8 or more."""
    sets, seen, kept = [shingles(t) for t in texts], set(), set()
    for root in range(len(texts)):
        if root in seen:
            continue
        kept.add(root)
        seen.add(root)
        queue = [root]
        while queue:
            at = queue.pop()
            for j in range(len(texts)):
                if j not in seen and similar(sets[at], sets[j]):
                    seen.add(j)
                    queue.append(j)
    return kept


def kept(docs):
    return sorted((r.doc_id, r.text) for r in simhash.dedup(docs).collect())


def pairs_around(rng, count):
    """Texts and edited copies of them, with similarities on both sides of 0.8."""
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for _ in range(count):
        base = [word() for _ in range(rng.randrange(60, 500))]
        copy = list(base)
        for at in rng.sample(range(len(copy)), max(1, int(len(copy) * rng.uniform(0.01, 0.04)))):
            copy[at] = word()
        texts += [" ".join(base), " ".join(copy)]
    return texts


def test_limit_is_exact(spark):
    rng = random.Random(3)
    texts = pairs_around(rng, 150)
    at = [f"x{i}" for i in range(14)]
    texts += [" ".join(at[:13]), " ".join(at[1:])]  # 8 of 10 shingles: just 0.8
    at = [f"y{i}" for i in range(13)]
    texts += [" ".join(at[:12]), " ".join(at[1:])]  # 7 of 9
    sets = [shingles(t) for t in texts]
    like = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(0.7 < x < 0.8 for x in like) > 15 and sum(0.8 <= x < 0.9 for x in like) > 15
    got = {r.doc_id for r in simhash.dedup(documents(spark, texts)).collect()}
    assert got == brute_kept(texts)


@pytest.mark.parametrize("block", [11, 4096])
def test_hubs_passages_and_chains(spark, block, monkeypatch):
    """A large group of copies, a passage that many hold, and chains, in one block a group and in many."""
    rng = random.Random(block)
    word = lambda: f"w{rng.randrange(4000)}"
    hub, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    texts = ["", None, "  ", "one", "ONE", "one two three four", "x " * 3000]
    for _ in range(60):
        copy = list(hub)
        for at in rng.sample(range(150), rng.randrange(1, 8)):
            copy[at] = word()
        texts.append(" ".join(copy))
    texts += [" ".join([*passage, *(word() for _ in range(rng.randrange(2, 120)))]) for _ in range(60)]
    chain = [word() for _ in range(220)]
    texts += [" ".join(chain[i : i + 100]) for i in range(0, 120, 9)]
    texts += pairs_around(rng, 20) + texts[8:12]
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(near_copies, "PAIRS", block)
    assert {r.doc_id for r in simhash.dedup(documents(spark, texts)).collect()} == brute_kept(texts)


def test_rows_without_own_ids(spark):
    """A row goes for its own text alone, whatever other rows share its id."""
    long = " ".join(f"w{i}" for i in range(200))
    near = [long + " a", long + " b", long + " c"]
    docs = documents(spark, [near[0], near[1], "only one", "this alone", near[2], "q", "q r s"], ids=[4, None, None, 6, 6, None, 7])
    assert kept(docs.filter(F.col("doc_id").isNotNull())) == [(4, near[0]), (6, "this alone"), (7, "q r s")]
    got = simhash.dedup(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(4, near[0]), (None, "only one"), (6, "this alone"), (None, "q"), (7, "q r s")], key=str)


def test_null_ids_do_not_join_components(spark):
    """Two texts without ids, each close to another document, do not join the two."""
    rng = random.Random(5)
    texts = [" ".join(f"{c}{rng.randrange(3000)}" for _ in range(900)) for c in "ab"]
    fps = lambda t: int(simhash.fingerprint(t.encode())[0])

    def beside(t):
        while True:
            w = t.split()
            w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
            if 0 < (fps(t) ^ fps(" ".join(w))).bit_count() <= 3:
                return " ".join(w)

    docs = documents(spark, [texts[0], texts[1], beside(texts[0]), beside(texts[1])], ids=[5, 9, None, None])
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(5, 5), (9, 9), (None, 5), (None, 9)]


def test_fingerprints_link_before_the_exact_check(spark, monkeypatch):
    """Copies within three bits of a fingerprint are linked by SimHash alone, and only if their shingles are alike."""
    rng = random.Random(9)
    bits = lambda t: near_copies.fingerprint_of(near_copies.shingle_hashes(t.encode(), 5, 42))
    base = [f"w{rng.randrange(4000)}" for _ in range(900)]
    texts = [" ".join(base)]
    while len(texts) < 4:
        copy = list(base)
        copy[rng.randrange(900)] = f"z{len(texts)}"
        if ((bits(texts[0]) ^ bits(" ".join(copy))) & (1 << 64) - 1).bit_count() <= 3:
            texts.append(" ".join(copy))
    texts += ["alone and short", " ".join(f"v{rng.randrange(4000)}" for _ in range(300))]
    # the exact check finds nothing
    monkeypatch.setattr(near_copies, "_near", lambda ids, held, similarity: lambda i, others: np.zeros(len(others), bool))
    assert [i for i, _ in kept(documents(spark, texts))] == [0, 4, 5]
    # fingerprints alone do not link
    monkeypatch.setattr(near_copies, "fingerprint_of", lambda found: 0)
    assert [i for i, _ in kept(documents(spark, [texts[0], *texts[4:]]))] == [0, 1, 2]
