"""Each stage of the pipeline on its own input, and all of them in a row."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from fiberlake.llm import bpe, quality
from fiberlake.llm.common import lean, table

from .test_line_dedup import brute as brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and returns, as rows by doc_id in order."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in cp.STAGES:
        got = stage(spark, docs, SF)
        got = spark.createDataFrame(got.collect(), got.schema)
        out.append((name, docs.collect(), got.collect(), got.columns))
        docs = got
    return {name: rest for name, *rest in out}


def test_shape(stages):
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "mixing", "encoding"]
    for name, (_, _, columns) in stages.items():
        assert tuple(columns) == (cp.OUTPUT if name == "encoding" else cp.COLUMNS)


def test_quality(stages, spark):
    docs, kept, _ = stages["quality_rules"]
    want = {r.doc_id for r in quality.score(table(spark, SF, "documents")).filter("kept").collect()}
    assert {r.doc_id for r in kept} == want and {tuple(r) for r in kept} <= {tuple(r) for r in docs}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    passed = {r.doc_id for r in quality.score(table(spark, SF, "documents")).filter("not base_failed").collect()}
    assert all(i in want for i in passed if i in labels and labels[i].quality == 1)


def test_lines(stages):
    docs, kept, _ = stages["line_dedup"]
    want = brute_lines([(r.doc_id, r.text) for r in docs])
    assert {r.doc_id: r.text for r in kept} == {i: t for i, (_, _, t) in want.items()}
    assert all(r.n_chars == len(r.text) for r in kept)


def test_near_dedup(stages):
    docs, kept, _ = stages["near_dedup"]
    words = {r.doc_id: r.text.lower().split() for r in docs}
    shingles = {i: {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    left = {r.doc_id for r in kept}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    # by definition: links of 0.8 and more, and the smallest id of what they reach
    group = {a: a for a in words}
    for a in sorted(words):
        for b in sorted(words):
            if b < a and group[a] != group[b] and like(shingles[a], shingles[b]) >= 0.8:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    assert left == {a for a in words if group[a] == a}


def test_mixing(stages):
    docs, mixed, _ = stages["mixing"]
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) == {r.doc_id for r in docs} and set(copies.values()) <= {1, 2}


def test_encoding(stages):
    docs, encoded, _ = stages["encoding"]
    t = bpe.Tokenizer.load(bpe.default_path())
    text = {r.doc_id: r.text for r in docs}
    assert Counter(r.doc_id for r in encoded) == Counter(r.doc_id for r in docs)
    assert all(r.input_ids == t.encode(text[r.doc_id]).tolist() and r.n_tokens == len(r.input_ids) for r in encoded)


def test_run(spark, stages):
    got = sorted((r.doc_id, tuple(r.input_ids)) for r in cp.run(spark, SF).collect())
    assert got == sorted((r.doc_id, tuple(r.input_ids)) for r in stages["encoding"][1])


def test_workers_do_not_keep_other_stages_vocabulary():
    bpe._compiled["other"] = None
    assert list(lean(iter)([1, 2])) == [1, 2] and "other" not in bpe._compiled
