"""Every pipeline stage on odd documents: nulls everywhere, empty and long texts, repeated rows, clashing names, no rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

from .helpers import DOCS


def odd(spark):
    rng = random.Random(1)
    prose = [" ".join(rng.choice(["the", "sea", "and", "fibre", "of", "light", "é"]) + str(rng.randrange(900)) for _ in range(120)) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)]
    rows += [rows[0], rows[0], (None, prose[1], None, None, None), (None, None, None, None, None), (40, "", "en", "", 0), (41, None, "en", None, 3)]
    rows += [(42, "word " * 50_000, "en", "s0", 250_000), (43, prose[3] + "\n" + prose[4], None, "s1", 5)]
    rows += [(44, " ".join(prose) + " " + " ".join(str(i) for i in range(60_000)), "en", "s2", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stage(spark, name, stage):
    docs = odd(spark)
    rows = stage(spark, docs, "").collect()
    assert rows or name == "none"
    if name in ("line_dedup", "encoding"):
        assert len(rows) == docs.count()
    if name == "mixing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} and len(rows) >= docs.count()
    if name == "quality_rules":
        assert not {40, 41, 42} & {r.doc_id for r in rows} and set(range(12)) <= {r.doc_id for r in rows}
    if name == "near_dedup":
        ids = [r.doc_id for r in rows]
        assert set(range(12)) <= set(ids) and ids.count(0) == 3
    empty = stage(spark, docs.limit(0), "")
    assert empty.count() == 0 and empty.columns == stage(spark, docs, "").columns


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_clashing_names(spark, name, stage):
    names = ["__id", "__text_key", "__drop", "__found", "__source", "__tokens", "__copies", "__ID2", "own__id", "id", "fp", "key", "digest", "count", "copies", "weight", "n_words", "n_lines", "input_ids", "pattern", "drop", "seed", "component", "label", "h", "tokens"]
    docs = odd(spark).filter("doc_id < 12")
    more = docs.withColumns({n: F.lit(f"own {n}") for n in names})
    plain, clashing = (sorted((r.doc_id, str(r["source"])) for r in stage(spark, d, "").collect()) for d in (docs, more))
    assert plain == clashing
