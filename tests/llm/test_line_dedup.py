import hashlib
import random

from pyspark.sql import functions as F

from fiberlake.llm.line_dedup import dedup_lines

from .helpers import documents

SPACES = " \t\n\x0b\x0c\r"


def brute(rows):
    key = lambda line: line.strip(SPACES).translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"Line number {k} ÄÖ {'x' * rng.randrange(20)}" for k in range(30)] + ["short", "", "   ", "exactly10!", "ÄÖÜäöüßß!!", "éééé"]
    texts = ["\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str.lower, str])(rng.choice(pool)) for _ in range(rng.randrange(9))) for _ in range(80)]
    texts += [None, "", "A" * 300_000 + "\nline number 1 äö", texts[0]]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in dedup_lines(documents(spark, texts)).collect()}
    assert got == brute(rows)


def test_counted_hashes_change_nothing(spark):
    docs = documents(spark, [f"common line of all\nline {i} by itself {i * i}\n" for i in range(300)])
    want = sorted((r.doc_id, r.text) for r in dedup_lines(docs).collect())
    assert sorted((r.doc_id, r.text) for r in dedup_lines(docs, max_filter_bits=1 << 10).collect()) == want
    assert sum("common" in t for _, t in want) == 1


def test_odd_tables(spark):
    docs = documents(spark, ["one line of text\nx", "one line of text", "one line of text", "one line of text"], ids=[5, 5, None, 7])
    docs = docs.withColumn("n_lines", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("drop", F.lit(2)).withColumn("key", F.lit(3))
    got = {(r.doc_id, r.text, r.n_dropped) for r in dedup_lines(docs).collect()}
    assert got == {(5, "one line of text\nx", 0), (5, "one line of text", 0), (None, "", 1), (7, "", 1)}
    assert dedup_lines(docs.limit(0)).count() == 0


def test_digest_of_kept_text(spark):
    assert hashlib.sha256(b"").hexdigest() == documents(spark, [""]).select(F.sha2(F.col("text").cast("binary"), 256)).first()[0]
