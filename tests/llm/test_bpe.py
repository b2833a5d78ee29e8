import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from fiberlake.llm import bpe

from .helpers import documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ours():
    return bpe.Tokenizer.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def odd_texts():
    rng = random.Random(4)
    pools = ["abcdefghijklmnopqrstuvwxyz", "aab", "tion here's we'll I'd  ", "ABCÄÖÜßéèñ", "0123456789½²Ⅷ", " \t\n\x0b\x0c\r\x1c\x85 ​", "ΣσςİıǅﬁÅȩ́", "日本語한국어العربية🙂👩‍👩", "<|>endoftext'"]
    out = ["", " ", "ΑΣ ΑΣ", "<|endoftext|>", "a<|startoftext|>B <|endoftext|><|endoftext|>x<|ENDOFTEXT|>", "<|endoftext|", "é<|endoftext|>́", "'s'S 'LL don't"]
    for _ in range(3000):
        out.append("".join(rng.choice(rng.choice(pools) if rng.random() < 0.3 else pools[rng.randrange(3)]) for _ in range(rng.randrange(1, 40))))
    return out


def test_matches_the_library(ours, library):
    for text in [*odd_texts(), "ab" * 20_000, "a" * 5_000, "aA1!" * 3_000]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert ours.encode(text).tolist() == ids, text[:80]
        assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("seed, states", [(9, 100_000), (10, 100_000), (11, 20)])
def test_automaton_is_bpe(monkeypatch, seed, states):
    """Against merging by rank, on a small random merge list."""
    monkeypatch.setattr(bpe, "MOST_STATES", states)
    rng = random.Random(seed)
    merges, pairs = [], set()
    spelling = [(s,) for s in range(3)]
    while len(merges) < 60:
        a, b = rng.randrange(len(spelling)), rng.randrange(len(spelling))
        if (a, b) not in pairs and spelling[a] + spelling[b] not in spelling and len(spelling[a] + spelling[b]) < 12:
            pairs.add((a, b))
            merges.append((a, b))
            spelling.append(spelling[a] + spelling[b])
    automaton = bpe.Automaton(3, merges)
    for _ in range(3000):
        word = [rng.randrange(3) for _ in range(rng.randrange(1, 25))]
        want = list(word)
        for r, (a, b) in enumerate(merges):
            i = 0
            while i < len(want) - 1:
                if (want[i], want[i + 1]) == (a, b):
                    want[i : i + 2] = [3 + r]
                i += 1
        assert automaton.path(word) == want
        assert automaton.path(word) == want  # now from the table alone
    assert all(0 <= symbol < 3 for state in automaton.states.values() for symbol in state)


def test_tables(spark, ours, library):
    texts = [None, "", "One two  THREE", "One two  THREE", "word " * 20_000, *odd_texts()[:60]]
    docs = documents(spark, texts).withColumn("input_ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    digests = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i].input_ids == ids and rows[i].decoded == library.decode(ids, skip_special_tokens=False)
        want = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), rows[i].decoded)))
        assert (digests[i].n_tokens, digests[i].ids_sha256, digests[i].decoded_sha256) == want
    assert bpe.round_trip(docs.limit(0)).count() == 0 and bpe.encode(docs.limit(0)).count() == 0
    assert bpe.round_trip(documents(spark, ["a", "a"], ids=[None, None])).count() == 2
