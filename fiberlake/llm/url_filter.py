"""URL filters by a Bloom filter cascade.

A rule is a (host, path) key: it fits its host and all subdomains, where the path starts with the rule's path. Every url
has a few candidate keys, its host suffixes joined with its path prefixes of the shapes that rules have. The cascade
answers exactly, for every key of the corpus, whether the key is listed: level 1 holds the listed keys, level 2 the
corpus keys that pass level 1 by mistake, level 3 the listed keys that pass level 2, and so on until nobody passes by
mistake. The first level that rejects a key decides. Judging needs no join; the universe is all candidate keys of all
urls that are judged.

Sizes follow the list, not the corpus: the first level's error rate is the ratio of listed keys to corpus keys, so that
about as many keys are in level 2 as are listed. A list too long for one broadcast is split by key hash into shards, each
with a cascade of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, record_batches, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bits of all cascades that are broadcast at once (32 MB).
MAX_BROADCAST_BITS = 1 << 28
#: The error rate of every level but the first.
INNER_RATE = 0.5
SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def key_hashes(keys: Iterable[str]) -> np.ndarray:
    """Two 64-bit hashes a key, (n, 2)."""
    import xxhash

    data = [k.encode("utf-8", "surrogatepass") for k in keys]
    return np.array([[xxhash.xxh3_64_intdigest(k, s) for s in SEEDS] for k in data], np.uint64).reshape(-1, 2)


@dataclass
class Bloom:
    """A Bloom filter of a given number of keys, of which about `rate` of the others pass; salt sets levels apart."""

    bits: int
    hashes: int
    salt: int
    words: np.ndarray

    @classmethod
    def sized(cls, n: int, rate: float, salt: int) -> Bloom:
        rate = min(max(rate, 1e-12), 0.5)
        bits = max(64, math.ceil(max(n, 1) * -math.log(rate) / math.log(2) ** 2))
        return cls(bits, max(1, round(bits / max(n, 1) * math.log(2)) if n else 1), salt, np.zeros(-(-bits // 8), np.uint8))

    def at(self, h: np.ndarray) -> np.ndarray:
        """Bit positions, (n, hashes)."""
        with np.errstate(over="ignore"):
            a = h[:, :1] * np.uint64(2 * self.salt + 0x9E3779B97F4A7C15)
            step = h[:, 1:] | np.uint64(1)
            mixed = a + np.arange(1, self.hashes + 1, dtype=np.uint64)[None, :] * step
            mixed ^= mixed >> np.uint64(32)
            return (mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(11)) % np.uint64(self.bits)

    def add(self, h: np.ndarray) -> None:
        at = self.at(h).ravel()
        np.bitwise_or.at(self.words, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))

    def passes(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(0, bool)
        at = self.at(h)
        return (self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)


@dataclass
class Cascade:
    """Levels for the shards [first, last) of `shards`."""

    shards: int
    first: int
    levels: list[list[Bloom]]

    def shard(self, h: np.ndarray) -> np.ndarray:
        return (h[:, 0] % np.uint64(self.shards)).astype(np.int64)

    def bits(self) -> int:
        return sum(level.bits for shard in self.levels for level in shard)

    def member(self, h: np.ndarray) -> np.ndarray:
        """Whether each key is listed; keys of other shards are not."""
        found = np.zeros(len(h), bool)
        own = self.shard(h)
        for k, levels in enumerate(self.levels):
            here = np.flatnonzero(own == self.first + k)
            for depth, level in enumerate(levels):
                if not len(here):
                    break
                ok = level.passes(h[here])
                if depth % 2:
                    found[here[~ok]] = True
                here = here[ok]
            if len(levels) % 2:  # who passes an odd last level is listed
                found[here] = True
        return found


def _hashed(keys: DataFrame) -> DataFrame:
    """(key, a, b): the distinct keys with their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = key_hashes(batch.column(0).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["key", "a", "b"])

    return keys.filter("key is not null").select("key").distinct().mapInArrow(run, "key string, a long, b long")


def _passing(hashed: DataFrame, cascade: Cascade, depth: int) -> DataFrame:
    """The keys of the cascade's shards that level `depth` lets through."""
    shared = hashed.sparkSession.sparkContext.broadcast(cascade)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            h = np.stack([batch.column(i).to_numpy() for i in (1, 2)], axis=1).view(np.uint64)
            own, ok = held.shard(h), np.zeros(len(h), bool)
            for k, levels in enumerate(held.levels):
                if depth < len(levels):
                    here = np.flatnonzero(own == held.first + k)
                    ok[here] = levels[depth].passes(h[here])
            yield batch.filter(pa.array(ok))

    return hashed.mapInArrow(run, hashed.schema)


def _add(keys: DataFrame, cascade: Cascade, depth: int) -> None:
    """Set the bits of the keys at level `depth`. Each task sends the bytes it sets, which are merged by place, so the
    driver receives no more than the filters hold."""
    shapes = [(x[depth].bits, x[depth].hashes, x[depth].salt) if depth < len(x) else None for x in cascade.levels]
    shards, first = cascade.shards, cascade.first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("at", pa.int64()), ("byte", pa.int32())])
        for batch in batches:
            h = np.stack([batch.column(i).to_numpy() for i in (1, 2)], axis=1).view(np.uint64)
            own = (h[:, 0] % np.uint64(shards)).astype(np.int64) - first
            for k, shape in enumerate(shapes):
                here = h[own == k]
                if shape and len(here):
                    at = np.unique(Bloom(*shape, np.zeros(0, np.uint8)).at(here)).astype(np.int64)
                    yield from record_batches(zip([k] * len(at), (at >> 3).tolist(), np.left_shift(1, at & 7).tolist(), strict=True), schema, 65536)

    merged = keys.mapInArrow(run, "shard int, at long, byte int").groupBy("shard", "at").agg(F.bit_or("byte").alias("byte"))
    for row in merged.toLocalIterator():  # MAX_BROADCAST_BITS / 8 rows at most, a partition at a time
        cascade.levels[row.shard][depth].words[row.at] |= row.byte


def build(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BROADCAST_BITS) -> list[Cascade]:
    """Cascades over `listed`, exact for every key in `universe` (each a table with a `key` column; nulls do not count).

    One cascade unless the list is too long for max_bits; then several, each for some of the shards.
    """
    listed, universe = checkpointed(_hashed(listed)), checkpointed(_hashed(universe))
    n, whole = listed.count(), universe.count()
    if not n:
        return []
    rate = min(0.5, n / max(whole, 1))
    needed = Bloom.sized(n, rate, 0).bits * 2 + n * 8
    groups = math.ceil(needed / max_bits)
    made = []
    for g in range(groups):
        cascade = Cascade(groups, g, [[]])
        inside = F.pmod(F.conv(F.lower(F.hex("a")), 16, 10).cast("decimal(20,0)"), F.lit(groups)) == g
        members, others = (x.filter(inside) if groups > 1 else x for x in (listed, universe))
        keep, depth, missed = members, 0, None
        while True:
            count = keep.count()
            if not count:
                break
            cascade.levels[0].append(Bloom.sized(count, rate if depth == 0 else INNER_RATE, 7919 * depth + 1))
            _add(keep, cascade, depth)
            against = others if depth == 0 else missed
            passed = _passing(against, cascade, depth)
            wrong = passed.join(listed.select("key"), "key", "left_anti") if depth == 0 else passed
            wrong = checkpointed(wrong)  # about as many as are listed, by the first level's rate
            missed, keep, depth = keep, wrong, depth + 1
        made.append(cascade)
    return made


def _member_udf(spark: SparkSession, cascade: Cascade):
    shared = spark.sparkContext.broadcast(cascade)

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def member(keys: pa.Array) -> pa.Array:
        flat = keys.flatten()
        codes = flat.dictionary_encode()
        found = shared.value.member(key_hashes(codes.dictionary.to_pylist()))
        found = found[codes.indices.to_numpy(zero_copy_only=False)] if len(flat) else found
        ends = np.cumsum(keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(found, pa.bool_()))

    return member


def contains(spark: SparkSession, cascades: list[Cascade], keys: F.Column) -> F.Column:
    """Whether each key of an array column, without null elements, is listed."""
    result = F.transform(keys, lambda _: F.lit(False))
    for k, cascade in enumerate(cascades):
        now = _member_udf(spark, cascade)(keys)
        result = F.zip_with(result, now, lambda x, y: x | y) if k else now
    return result


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path of a url; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"(?s)\A([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: F.Column, path: F.Column, shapes: list[tuple[int, int]]) -> F.Column:
    """The keys of a url that rules of these shapes, (labels of the host, characters of the path), could be; a key is
    host and path with a line end between, which neither separates otherwise."""
    labels = F.split(host, r"\.", -1)
    keys = [
        F.when((F.size(labels) >= n) & (F.length(path) >= m), F.concat(F.array_join(F.slice(labels, -n, n), "."), F.lit("\n"), F.substring(path, 1, m)))
        for n, m in shapes
    ]
    return F.filter(F.array(*keys), lambda k: k.isNotNull()) if keys else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (columns of these names are replaced).

    rules: (verdict, host, path); the longest fitting one wins, by the characters of host and path together, and of two
    equally long ones the later in the order of host and then path. A later rule for the same host and path replaces an
    earlier one. A second cascade tells which listed keys allow. Rules are the operator's own parameters; their keys may
    be as many as the driver can hold. A url that no rule fits, one without `://` and a null url have a null rule and
    the default verdict. Rows are judged each by itself, so repeated rows stay; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    by_key = {f"{host.translate(str.maketrans(UPPER, LOWER))}\n{path}": verdict for verdict, host, path in rules}
    shapes = sorted({(k.split("\n", 1)[0].count(".") + 1, len(k.split("\n", 1)[1])) for k in by_key}, key=lambda s: (-s[0], -s[1]))
    host, path = split_url(F.col(url))
    base = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    keys = candidate_keys(F.col("host"), F.col("path"), shapes)
    listed = spark.createDataFrame([(k,) for k in by_key], "key string")
    universe = base.select(F.explode(keys).alias("key"))
    with_keys = base.withColumn("__keys", keys)
    flagged = with_keys.withColumn("__listed", contains(spark, build(listed, universe), F.col("__keys")))
    held = F.transform(F.filter(F.arrays_zip(F.col("__keys").alias("k"), F.col("__listed").alias("l")), lambda x: x["l"]), lambda x: x["k"])
    best = F.array_max(F.transform(held, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    allowed = spark.createDataFrame([(k,) for k, v in by_key.items() if v == "allow"], "key string")
    chosen = flagged.withColumn("__best", best)
    allows = contains(spark, build(allowed, listed), F.array(F.coalesce("__best", F.lit(""))))[0]
    verdict = F.when(F.col("__best").isNull(), F.lit(default)).when(allows, F.lit("allow")).otherwise(F.lit("block"))
    return chosen.withColumns({"rule": F.replace(F.col("__best"), F.lit("\n"), F.lit("")), "verdict": verdict}).drop("__keys", "__listed", "__best")


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "/es/"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
hosts AS (SELECT page_id, r, regexp_extract(r, '^([^/?#]*)', 1) AS h FROM rest),
parts AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(h) + 1), '^([^?#]*)', 1) AS path FROM hosts),
rules(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'org', '/es/'),
         ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8')),
fits AS (
  SELECT parts.page_id, rules.h || rules.p AS rule, rules.verdict,
         row_number() OVER (PARTITION BY parts.page_id ORDER BY length(rules.h || rules.p) DESC) AS n
  FROM parts JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND n = 1
"""
