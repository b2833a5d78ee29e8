"""Mixing sources to target weights by temperature.

The share p of each source's tokens is raised to an exponent and normalised: weight ~ p ** a. The exponent, from 0 (equal
weights) to 1 (weights as found), is cut down to an interval until the weights meet a target entropy or a limit on
repetition. Tokens are those of a vocabulary. Weights are realised as budgeted block permutations: a source's budget
holds some whole passes over its documents and a part of one. For the part, documents are dealt to blocks by a keyed hash
and the blocks are taken in keyed order until the budget is used; the block it ends in is split into blocks again, and at
last by document. No step sorts a source or holds more of it than block totals.

The mixture's order is a block permutation as well. Each pass of a source has its own keyed order, and a copy stands at
(passes before + place in its pass) / (passes due to the source), from 0 to 1. The mixture is cut into BLOCKS blocks of
that line, so every block holds all sources by their weights, and each pass of a source is over before its next begins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, own_names, row_key, stored, table, texts
from .token_shards import Vocabulary

#: Exponents tried at once, and times the interval is cut: 64 ** 6 steps, a width of 1.5e-11.
SECTIONS, ROUNDS = 64, 6
#: Bits of the keyed hash that number the blocks of one level; two levels and then single documents.
BLOCK_BITS, LEVELS, HASH_BITS = 10, 2, 60
#: Blocks of the mixture.
BLOCKS = 1024
#: Tables of one row a source are broadcast up to so many rows (a few MB); more sources are joined by a shuffle.
MOST_BROADCAST = 50_000


def _by_source(table: DataFrame) -> DataFrame:
    """A stored table of a row a source, broadcast if it is counted to be small, so that a source that holds a third of
    all rows is not gathered for its one row."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


Moments = Callable[[list[float]], list[tuple[float, float]]]


def _moments(shares: DataFrame, n: int) -> Moments:
    """For each of some exponents a: the sums of p ** a and of p ** a * ln p. n shares are summed on the driver if they
    are few, else each call is a job that returns a row an exponent."""
    if n <= MOST_BROADCAST:
        p = np.sort(np.array([r.p for r in shares.select("p").collect()], float))
        return lambda exponents: [(float((p**a).sum()), float((p**a * np.log(p)).sum())) for a in exponents]

    def run(exponents: list[float]) -> list[tuple[float, float]]:
        a = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("a")) for i, x in enumerate(exponents)]))
        power = F.exp(F.col("e.a") * F.log("p"))
        rows = shares.withColumn("e", a).groupBy("e.i").agg(F.sum(power).alias("s"), F.sum(power * F.log("p")).alias("l")).collect()
        by = {r.i: (r.s, r.l) for r in rows}
        return [by[i] for i in range(len(exponents))]

    return run


def bisect_exponent(shares: DataFrame, entropy: float | None, repeats: float | None, budget_share: float | None) -> float:
    """The exponent that meets the targets, over a table of shares p.

    entropy: the weights' entropy as a part of that of equal weights; the largest exponent with at least that much.
    repeats: no source is repeated more often; the smallest exponent that keeps to it. With both, the limit on
    repetition comes first. budget_share is the budget by all tokens, None for the smallest that keeps every document.
    """
    if (entropy is None) == (repeats is None) and entropy is None:
        raise ValueError("a target entropy or a limit on repetition is needed")
    n, least, most = shares.agg(F.count(F.lit(1)), F.min("p"), F.max("p")).first()
    if n < 2 or least == most:
        return 1.0
    moments = _moments(shares, n)

    def too_flat(a: float, s: float, _: float) -> bool:
        scale = most ** (a - 1) if budget_share is None else s / budget_share
        return least ** (a - 1) / scale > repeats * (1 + 1e-12)

    def too_steep(a: float, s: float, log: float) -> bool:
        return (math.log(s) - a * log / s) / math.log(n) < entropy

    def cut(goes_up) -> float:
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            under = [goes_up(a, *m) for a, m in zip(grid, moments(grid), strict=True)]
            first = next((i for i, x in enumerate(under) if not x), SECTIONS)
            low, high = grid[max(0, first - 1)], grid[first]
        return high

    flattest = cut(too_flat) if repeats is not None else 0.0
    if entropy is None:
        return flattest
    return max(flattest, 1.0 if not too_steep(1.0, *moments([1.0])[0]) else cut(lambda a, s, log: not too_steep(a, s, log)))


def token_counts(docs: DataFrame, source: str = "source", vocabulary: str | None = None) -> DataFrame:
    """docs, with __source (never null) and __tokens: tokens of the text in a vocabulary (see token_shards), 1 at least;
    words where there is none."""
    fields = [f for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField("__tokens", T.LongType())])
    shared = None if vocabulary is None else Vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if shared is None else shared.get()
        for batch in batches:
            if held is None:
                counts = [len(t.split()) for t in texts(batch.column("text"))]
            else:
                counts = [len(held.encode_bytes(t.decode("utf-8", "replace"))) // held.dtype.itemsize for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.maximum(np.array(counts, np.int64), 1))], names=schema.names)

    return docs.mapInArrow(run, schema).withColumn("__source", _source(source))


def _source(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit(""))


def _hash(key: int, *further: Column) -> Column:
    """Place in the keyed order, 0 .. 2 ** HASH_BITS - 1; rows equal in id and text share it."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(key), *further, F.col("__id"), F.col("__text_key")), 64 - HASH_BITS)


def plan(rows: DataFrame, entropy: float | None, repeats: float | None, budget: float | None, budget_share: float | None = None) -> DataFrame:
    """(source, weight, due, passes, last): of the passes due to it, each source takes the whole ones and of a further one
    what is placed at last or before (-1: nothing). rows: (source, tokens, h); read several times, so they should be stored."""
    totals = rows.groupBy("source").agg(F.sum("tokens").alias("n"))
    whole = totals.agg(F.sum("n")).first()[0] or 0
    shares = checkpointed(totals.withColumn("p", F.col("n") / F.lit(float(max(whole, 1)))))
    if not whole:
        return shares.select("source", F.lit(0.0).alias("weight"), F.lit(0.0).alias("due"), F.lit(0).cast("long").alias("passes"), F.lit(-1).cast("long").alias("last"))
    budget = whole * budget_share if budget_share is not None else budget
    a = bisect_exponent(shares, entropy, repeats, None if budget is None else budget / whole)
    n, most = shares.agg(F.count(F.lit(1)), F.max("p")).first()
    s, _ = _moments(shares, n)([a])[0]
    tokens = whole * s * most ** (1 - a) if budget is None else budget
    weight = F.exp(F.lit(a) * F.log("p")) / F.lit(s)
    due = weight * F.lit(float(tokens)) / F.col("n")
    # a share that rounding leaves a hair under a whole pass is the whole pass
    passes = F.floor(due + 1e-9)
    cut = shares.select("source", weight.alias("weight"), due.alias("due"), passes.alias("passes"), F.greatest(F.lit(0), F.round((due - passes) * F.col("n"))).cast("long").alias("left"))
    cut = cut.withColumns({"low": F.lit(0).cast("long")})
    cut = checkpointed(cut)
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - BLOCK_BITS * level
        inside = rows.join(_by_source(cut), "source")
        if level > 1:
            inside = inside.filter(F.shiftright("h", shift + BLOCK_BITS) == F.shiftright("low", shift + BLOCK_BITS))
        blocks = inside.groupBy("source", F.shiftright("h", shift).alias("block")).agg(F.sum("tokens").alias("t"))
        # 2 ** BLOCK_BITS rows a source at most
        order = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        fits = blocks.withColumn("upto", F.sum("t").over(order)).join(cut.select("source", "left"), "source").filter("upto <= left")
        used = fits.groupBy("source").agg(F.max("upto").alias("used"))
        over = blocks.withColumn("upto", F.sum("t").over(order)).join(cut.select("source", "left"), "source").filter("upto > left").groupBy("source").agg(F.min("block").alias("block"))
        beyond = F.lit(1 << HASH_BITS).cast("long")
        cut = cut.join(used, "source", "left").join(over, "source", "left").select(
            "source", "weight", "due", "passes", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
            F.coalesce(F.shiftleft("block", shift), F.when(F.lit(level > 1), F.col("low") + F.lit(1 << shift + BLOCK_BITS if level > 1 else 0)).otherwise(beyond)).alias("low"),
        )
        cut = checkpointed(cut)
    shift = HASH_BITS - BLOCK_BITS * LEVELS
    last = rows.join(_by_source(cut), "source").filter(F.shiftright("h", shift) == F.shiftright("low", shift)).groupBy("source", "h").agg(F.sum("tokens").alias("t"))
    order = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("upto", F.sum("t").over(order)).join(cut.select("source", "left"), "source").filter("upto <= left").groupBy("source").agg(F.max("h").alias("h"))
    return cut.join(last, "source", "left").select("source", "weight", "due", "passes", F.coalesce(F.col("h"), F.col("low") - 1).alias("last"))


@own_names
def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None, key: int = 0, source: str = "source", budget_share: float | None = None, vocabulary: str | None = None) -> DataFrame:
    """docs with n_tokens, weight (of the row's source) and copies (how often the mixture holds the row), replacing
    columns of these names.

    budget: tokens of the mixture, or budget_share as a part of those of docs; with neither, the smallest in which every
    document is held once at least. A source takes
    no more than its share of the budget, and less only by less than one document. A null source is a source of its own;
    null and empty texts count as one token, so that they can be placed. Rows equal in doc_id and text are taken
    together. An empty table gives an empty table.

    Tokens are those of the vocabulary (words without one), which are counted once for the plan and once for n_tokens.
    """
    added = {"n_tokens": F.col("__tokens"), "weight": F.col("__weight"), "copies": F.col("__copies")}
    chosen = _chosen(docs, entropy, repeats, budget, key, source, budget_share, vocabulary)
    rows = _copied(row_key(token_counts(docs, source, vocabulary)), chosen, key)
    return rows.select(*[c for c in docs.columns if c not in added], *[v.alias(n) for n, v in added.items()])


@own_names
def mixed(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None, key: int = 0, source: str = "source", budget_share: float | None = None, vocabulary: str | None = None) -> DataFrame:
    """The mixture itself: the rows of docs, with their own columns, each as often as mix() has copies of it."""
    chosen = _chosen(docs, entropy, repeats, budget, key, source, budget_share, vocabulary)
    rows = _copied(row_key(docs).withColumn("__source", _source(source)), chosen, key)
    return _unrolled(rows, key).select(*docs.columns)


@own_names
def ordered(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None, key: int = 0, source: str = "source", budget_share: float | None = None, vocabulary: str | None = None) -> DataFrame:
    """A row for each copy of the mixture without its text: the other columns of docs with n_tokens, weight, copy (from
    1), block and place, replacing columns of these names. Sorted by block and place the copies are in the mixture's
    order. Tokens are counted once."""
    added = {"n_tokens": F.col("__tokens"), "weight": F.col("__weight"), "copy": F.col("__copy"), "block": F.col("__block"), "place": F.col("__place")}
    thin = stored(row_key(token_counts(docs, source, vocabulary)).drop("text"))
    chosen = _chosen_of(thin, entropy, repeats, budget, key, budget_share)
    rows = _unrolled(_copied(thin, chosen, key), key)
    return rows.select(*[c for c in docs.columns if c != "text" and c not in added], *[v.alias(n) for n, v in added.items()])


def _chosen(docs: DataFrame, entropy: float | None, repeats: float | None, budget: float | None, key: int, source: str, budget_share: float | None, vocabulary: str | None) -> DataFrame:
    return _chosen_of(row_key(token_counts(docs, source, vocabulary)), entropy, repeats, budget, key, budget_share)


def _chosen_of(counted: DataFrame, entropy: float | None, repeats: float | None, budget: float | None, key: int, budget_share: float | None) -> DataFrame:
    """The stored plan by __source, of rows (__id, __text_key, __source, __tokens)."""
    rows = checkpointed(counted.select(F.col("__source").alias("source"), F.col("__tokens").alias("tokens"), _hash(key).alias("h")))
    chosen = plan(rows, entropy, repeats, budget, budget_share)
    return checkpointed(chosen.select(*[F.col(c).alias(f"__{c}") for c in ("source", "weight", "due", "passes", "last")]))


def _copied(rows: DataFrame, chosen: DataFrame, key: int) -> DataFrame:
    """rows (__id, __text_key, __source, ..) with their plan and __copies."""
    return rows.join(_by_source(chosen), "__source").withColumn("__copies", F.col("__passes") + (_hash(key) <= F.col("__last")).cast("long"))


def _unrolled(rows: DataFrame, key: int) -> DataFrame:
    """A row for each copy, with __copy, __block and __place."""
    copies = rows.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    # the last pass takes what the plan's own order puts first, and is a part of a pass long
    own = _hash(key, F.when(F.col("__copy") <= F.col("__passes"), F.col("__copy")).otherwise(0))
    end = F.greatest(F.col("__last") + 1, F.lit(1))
    inside = F.when(F.col("__copy") <= F.col("__passes"), own / float(1 << HASH_BITS)).otherwise((_hash(key) / end) * (F.col("__due") - F.col("__passes")))
    at = F.least((F.col("__copy") - 1 + inside) / F.greatest("__due", "__passes"), F.lit(1 - 1e-12))
    return copies.withColumns({"__block": F.floor(at * BLOCKS).cast("int"), "__place": _hash(key, F.lit(-1), F.col("__copy"))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each copy that the mixture holds, with its block and place."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = ordered(docs, entropy=0.97, repeats=4.0, budget_share=1.0, key=11, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return rows.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "copy", "block", "place")
