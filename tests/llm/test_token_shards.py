import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fiberlake.llm import bpe
from fiberlake.llm import token_shards as ts

from .helpers import documents


@pytest.mark.parametrize("n", [1, 2, 3, 10, 255, 256, 257, 5000])
def test_feistel_is_a_permutation(n):
    p = ts.Feistel(n, 5)
    slots = p.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert p.sequence(slots).tolist() == list(range(n))
    if n > 200:
        assert (slots == np.arange(n)).mean() < 0.1 and ts.Feistel(n, 6).slot(np.arange(n)).tolist() != slots.tolist()


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.tiktoken"])
def test_round_trip_and_resume(spark, tmp_path, vocabulary, monkeypatch):
    monkeypatch.setattr(ts, "RANGE_BYTES", 3 * 50 * 33)
    monkeypatch.setattr(ts, "GATHERED", 5000)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "train", "tokenization", "été", "7!"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [None, "", "long " * 5000, texts[0]]
    docs = documents(spark, texts).withColumn("at", F.lit("clash")).withColumn("n", F.lit(1))
    path = str(tmp_path / "out")
    layout = ts.write_shards(docs, path, length=16, per_shard=50, key=9, vocabulary=public_tokenizers.path(vocabulary))
    places = sorted((r.first, r.n_tokens, r.doc_id) for r in spark.read.parquet(f"{path}/documents").collect())
    assert sorted(i for _, _, i in places) == list(range(len(texts)))
    if vocabulary.endswith("json"):
        encode = bpe.Tokenizer.load(bpe.default_path()).encode
    else:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(vocabulary), "rb"))}
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = lambda x: np.array(library.encode_ordinary(x), int)
    stream = []
    for first, n, i in places:
        ids = [*encode(texts[i] or "").tolist(), layout.end_id]
        assert (first, n) == (len(stream), len(ids))
        stream += ids
    assert layout.tokens == len(stream) and layout.sequences == -(-len(stream) // 16)
    stream += [layout.end_id] * (-len(stream) % 16)
    want = [stream[i : i + 16] for i in range(0, len(stream), 16)]
    order = ts.Feistel(layout.sequences, 9).sequence(np.arange(layout.sequences))
    rows = sorted((r.slot, r.shard, np.frombuffer(r.ids, "<u2").tolist()) for r in ts.read_shards(spark, path).collect())
    assert rows == [(s, s // 50, want[q]) for s, q in enumerate(order)]
    named = ts.read_shards(spark, path).select("slot", ts.sequence_of(F.col("slot"), layout).alias("s"))
    assert sorted((r.slot, r.s) for r in named.collect()) == [*enumerate(order.tolist())]
    later = sorted((r.slot, r.shard) for r in ts.read_shards(spark, path, first_slot=777).collect())
    assert later == [(s, s // 50) for s in range(777, layout.sequences)]
    # a plain reader seeks by stride
    for slot in (0, 49, 50, 777, layout.sequences - 1):
        (file,) = (tmp_path / "out/shards" / f"shard={slot // 50}").glob("part-*")
        with file.open("rb") as f:
            f.seek(slot % 50 * layout.stride)
            assert np.frombuffer(f.read(32), "<u2").tolist() == want[order[slot]]
    assert ts.read_layout(spark, path) == layout


def test_odd_tables(spark, tmp_path):
    docs = documents(spark, ["a", "a", "b"], ids=[None, None, 3])
    layout = ts.write_shards(docs, str(tmp_path / "a"), length=4, per_shard=2)
    places = spark.read.parquet(str(tmp_path / "a/documents")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in places) == [("3", 2), ("None", 2), ("None", 2)] and sorted(r.first for r in places) == [0, 2, 4]
    assert layout.tokens == 6 and ts.read_shards(spark, str(tmp_path / "a")).count() == 2
    empty = ts.write_shards(docs.limit(0), str(tmp_path / "b"))
    assert empty.sequences == 0 and ts.read_shards(spark, str(tmp_path / "b")).count() == 0
