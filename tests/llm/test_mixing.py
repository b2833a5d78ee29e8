import base64
import math
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fiberlake.llm import mixing

from .helpers import documents


def corpus(rng, sizes):
    texts, sources = [], []
    for s, n in sizes.items():
        for _ in range(n):
            texts.append(" ".join(["w"] * rng.randrange(1, 60)) + f" {rng.random()}")
            sources.append(s)
    return texts, sources


def brute_exponent(p, good):
    """The least exponent on a fine grid that is good, by plain bisection."""
    low, high = 0.0, 1.0
    if good(0.0):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def weights(p, a):
    total = sum(x**a for x in p.values())
    return {s: x**a / total for s, x in p.items()}


SIZES = {"hot": 400, "b": 80, "c": 40, None: 20, "": 7}


@pytest.mark.parametrize("target", [{"repeats": 2.0}, {"repeats": 3.0, "budget": 9000.0}, {"entropy": 0.9, "budget": 20_000.0}, {"entropy": 0.99, "repeats": 2.5, "budget": 15_000.0}])
def test_weights_and_copies(spark, target):
    texts, sources = corpus(random.Random(1), SIZES)
    rows = mixing.mix(documents(spark, texts, sources), key=3, **target).collect()
    assert len(rows) == len(texts)
    tokens = Counter()
    for r in rows:
        assert r.n_tokens == len(texts[r.doc_id].split())
        tokens[r.source] += r.n_tokens
    whole = sum(tokens.values())
    p = {s: n / whole for s, n in tokens.items()}
    budget = target.get("budget")

    def budget_of(a):
        w = weights(p, a)
        return budget or max(tokens[s] / w[s] for s in p)

    def within(a):
        w = weights(p, a)
        return all(w[s] * budget_of(a) / tokens[s] <= target["repeats"] * (1 + 1e-9) for s in p)

    a = brute_exponent(p, within) if "repeats" in target else 0.0
    if "entropy" in target:
        entropy = lambda x: -sum(v * math.log(v) for v in weights(p, x).values()) / math.log(len(p))
        if entropy(1.0) < target["entropy"]:
            a = max(a, brute_exponent(p, lambda x: entropy(x) <= target["entropy"]))
        else:
            a = 1.0
    want = weights(p, a)
    held = defaultdict(int)
    for r in rows:
        assert abs(r.weight - want[r.source]) < 1e-7
        held[r.source] += r.copies * r.n_tokens
    for s in p:
        due = want[s] * budget_of(a)
        longest = max(r.n_tokens for r in rows if r.source == s)
        assert due - longest - 1 <= held[s] <= due + 1, (s, due, held[s])
        each = {r.copies for r in rows if r.source == s}
        assert max(each) - min(each) <= 1
    if not budget:
        assert min(r.copies for r in rows) == 1
    again = mixing.mix(documents(spark, texts, sources).repartition(7), key=3, **target).collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in rows}
    other = mixing.mix(documents(spark, texts, sources), key=4, **target).collect()
    assert {r.doc_id: r.copies for r in other} != {r.doc_id: r.copies for r in rows}


def test_partial_pass_follows_the_keyed_order(spark):
    """Who is taken is a prefix of the source in the order of the keyed hash."""
    texts, sources = corpus(random.Random(2), {"a": 3000, "b": 50})
    docs = documents(spark, texts, sources)
    rows = mixing.row_key(mixing.mix(docs, repeats=2.0, budget=30_000.0, key=5)).withColumn("h", mixing._hash(5)).collect()
    for s in ("a", "b"):
        order = [r.copies for r in sorted((r for r in rows if r.source == s), key=lambda r: r.h)]
        assert order == sorted(order, reverse=True)


@pytest.mark.parametrize("target", [{"repeats": 2.5}, {"entropy": 0.97, "repeats": 4.0, "budget_share": 1.0}])
def test_mixture_is_a_permutation_of_blocks(spark, monkeypatch, target):
    """Every copy once; every block holds the sources by their weights; a pass ends before the next begins."""
    monkeypatch.setattr(mixing, "BLOCKS", 8)
    texts, sources = corpus(random.Random(7), {"hot": 4000, "b": 900, "c": 500})
    docs = documents(spark, texts, sources)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plan = {r.doc_id: r for r in mixing.mix(docs, key=2, vocabulary=path, **target).collect()}
    rows = mixing.ordered(docs, key=2, vocabulary=path, **target).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r.n_tokens == len(library.encode_ordinary(texts[r.doc_id])) for r in rows)
    assert Counter(r.doc_id for r in rows) == {i: r.copies for i, r in plan.items() if r.copies}
    assert len({(r.block, r.place) for r in rows}) == len(rows)
    whole, held = sum(r.n_tokens for r in rows), defaultdict(Counter)
    for r in rows:
        held[r.block][r.source] += r.n_tokens
    assert sorted(held) == list(range(8))
    for block in held.values():
        for s, n in block.items():
            due = plan[sources.index(s)].weight * whole / 8
            assert abs(n - due) < 0.25 * due + 100
    for s in SIZES:
        blocks = defaultdict(set)
        for r in rows:
            if r.source == s:
                blocks[r.copy].add(r.block)
        for copy in blocks:
            assert copy + 1 not in blocks or max(blocks[copy]) <= min(blocks[copy + 1])
    again = mixing.ordered(docs.repartition(5), key=2, vocabulary=path, **target).collect()
    assert {(r.doc_id, r.copy, r.block, r.place) for r in again} == {(r.doc_id, r.copy, r.block, r.place) for r in rows}
    first = [r.place for r in rows if r.copy == 1 and r.source == "c"]
    assert first != sorted(first)


def test_many_sources_take_the_other_ways(spark, monkeypatch):
    texts, sources = corpus(random.Random(5), {"a": 300, "b": 60, "c": 20})
    docs = documents(spark, texts, sources)
    few = {r.doc_id: (round(r.weight, 9), r.copies) for r in mixing.mix(docs, repeats=2.0, key=1).collect()}
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    many = {r.doc_id: (round(r.weight, 9), r.copies) for r in mixing.mix(docs, repeats=2.0, key=1).collect()}
    assert few == many


def test_odd_tables(spark):
    docs = documents(spark, ["a b", "a b", None, ""], ["x", "x", None, "y"], ids=[1, 1, None, 2]).withColumn("copies", F.lit("clash")).withColumn("tokens", F.lit(1)).withColumn("h", F.lit(2))
    rows = mixing.mix(docs, repeats=2.0).collect()
    assert len(rows) == 4 and all(r.copies >= 1 for r in rows)
    assert mixing.mix(docs.limit(0), repeats=2.0).count() == 0
    whole = mixing.mixed(docs, repeats=2.0)
    assert whole.columns == docs.columns and whole.count() == sum(r.copies for r in rows)
    one = mixing.mix(documents(spark, ["a", "b"], ["x", "x"]), entropy=0.5, budget=4.0).collect()
    assert [r.copies for r in one] == [2, 2]
    with pytest.raises(ValueError):
        mixing.mix(docs, budget=3.0)
