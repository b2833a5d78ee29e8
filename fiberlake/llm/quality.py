"""Quality rules under weak supervision.

Rules vote good (1), bad (-1) or abstain (0) on each document. Expectation-maximisation estimates, for each rule and
each latent class, how likely each vote is, and a document's posterior probability of being good replaces the filter in
which every rule must pass. One class is good; each family of rules, which look at the same kind of defect, has a bad
class of its own, since rules of one family are wrong or right together. The corpus enters the fit as counts of vote patterns, 3 ** rules rows at most, so the fit
covers every document and its size never depends on the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, code_points, lean, table, texts

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (*BASE, "n_lines", "n_distinct_words")


def features(text: bytes) -> tuple[int, ...]:
    """FEATURES of one text; n_lines counts lines with a word."""
    words = text.split()
    n = len(words)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0
        for i, window in enumerate(windows):
            if times[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (
        n,
        code_points(text) - (len(text) - len(text.translate(None, SPACES))),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(set(words)),
    )


@dataclass(frozen=True)
class Rule:
    """Votes good where value / of is within `good`, bad where it is outside `fair`, and abstains otherwise or if `of` is 0."""

    name: str
    family: int
    value: str
    of: str
    good: tuple[float, float]
    fair: tuple[float, float]
    #: belief in how often it votes bad on a good document
    false_alarm: float = 0.02

    def votes(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        by = columns[self.of].astype(float) if self.of else np.ones(len(columns[self.value]))
        share = np.divide(columns[self.value], by, out=np.full(len(by), np.nan), where=by > 0)
        good = (share >= self.good[0]) & (share <= self.good[1])
        bad = (share < self.fair[0]) | (share > self.fair[1])
        return np.where(good, 1, np.where(bad, -1, 0)).astype(np.int8)


INF = float("inf")
RULES = (
    Rule("symbols", 0, "n_symbols", "word_chars", (0, 0.01), (0, 0.04), 0.002),
    Rule("repeats", 1, "n_repeat_words", "n_words", (0, 0.35), (0, 0.5)),
    Rule("duplicate_lines", 1, "n_dup_lines", "n_lines", (0, 0.35), (0, 0.5)),
    Rule("distinct_words", 1, "n_distinct_words", "n_words", (0.4, 1), (0.15, 1)),
    Rule("word_length", 2, "word_chars", "n_words", (3.5, 7), (2.5, 9)),
    Rule("length", 2, "n_words", "", (100, INF), (20, INF)),
)


#: Belief in the votes (-1, 0, 1) of a rule on documents with its own family's defect, and in 0 votes on others.
DEFECT_VOTES, ABSTAINS = (0.60, 0.20, 0.20), 0.18


@dataclass(frozen=True)
class Model:
    #: by class; the first is good, the others are the families' defects
    prior: np.ndarray
    #: rule, class, vote (-1, 0, 1)
    likelihood: np.ndarray

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """Posterior of each class, for rows of votes."""
        log = np.repeat(np.log(self.prior)[None, :], len(votes), 0)
        for r in range(votes.shape[1]):
            log += np.log(self.likelihood[r])[:, votes[:, r].astype(int) + 1].T
        odds = np.exp(log - log.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of being good."""
        return self.classes(votes)[:, 0]


def fit(patterns: np.ndarray, counts: np.ndarray, families: tuple[int, ...], false_alarms: tuple[float, ...], rounds: int = 200, strength: float = 0.05) -> Model:
    """EM over vote patterns. It starts from the labels of the all-must-pass filter; the belief counts as `strength` of
    the documents (10 at least), which keeps every vote possible and keeps the classes from trading places. With no
    documents the belief is the model."""
    rules, k = len(families), max(families) + 2
    good = [(a, ABSTAINS, 1 - ABSTAINS - a) for a in false_alarms]
    belief = np.array([[DEFECT_VOTES if c - 1 == f else g for c in range(k)] for f, g in zip(families, good, strict=True)])
    start = np.array([0.85] + [0.15 / (k - 1)] * (k - 1))
    model = Model(start, belief)
    if not len(patterns):
        return model
    bad = np.stack([(patterns[:, np.array(families) == f] < 0).any(axis=1) for f in range(k - 1)], axis=1)
    share = np.concatenate([np.where(bad.any(axis=1), 0.05, 1.0)[:, None], bad * 0.95 / np.maximum(bad.sum(axis=1, keepdims=True), 1)], axis=1)
    pseudo = max(10.0, strength * counts.sum())
    for _ in range(rounds):
        weight = share * counts[:, None]
        votes = np.array([[weight[patterns[:, r] == v].sum(axis=0) for v in (-1, 0, 1)] for r in range(rules)])
        likelihood = votes.transpose(0, 2, 1) + pseudo * start[None, :, None] * belief
        likelihood /= likelihood.sum(axis=2, keepdims=True)
        prior = weight.sum(axis=0) + pseudo * start
        model = Model(prior / prior.sum(), likelihood)
        now = model.classes(patterns)
        done = np.abs(now - share).max() < 1e-9
        share = now
        if done:
            break
    return model


def votes_of(columns: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([rule.votes(columns) for rule in RULES], axis=1)


def feature_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """FEATURES and the vote pattern of every document, beside the columns to keep."""
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField(n, T.LongType()) for n in FEATURES] + [T.StructField("pattern", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t) for t in texts(batch.column("text"))], np.int64).reshape(-1, len(FEATURES))
            votes = votes_of(dict(zip(FEATURES, rows.T, strict=True)))
            pattern = ["".join("-0+"[v + 1] for v in row) for row in votes]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(c) for c in rows.T), pa.array(pattern, pa.string())], names=schema.names)

    return docs.select(*keep, F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), schema)


def fit_patterns(patterns: DataFrame) -> Model:
    """The model of a table with a `pattern` column."""
    rows = patterns.groupBy("pattern").count().orderBy("pattern").collect()  # 3 ** len(RULES) rows at most
    patterns = np.array([["-0+".index(c) - 1 for c in r[0]] for r in rows], int).reshape(-1, len(RULES))
    return fit(patterns, np.array([r[1] for r in rows], float), tuple(rule.family for rule in RULES), tuple(rule.false_alarm for rule in RULES))


def posterior_column(model: Model, column: str = "pattern") -> F.Column:
    """The posterior of a vote pattern, as an expression over the pattern's characters."""
    odds = []
    for c in range(len(model.prior)):
        log = F.lit(float(np.log(model.prior[c])))
        for r in range(len(RULES)):
            chance = np.log(model.likelihood[r, c])
            vote = F.substring(column, r + 1, 1)
            log = log + F.when(vote == "-", float(chance[0])).when(vote == "0", float(chance[1])).otherwise(float(chance[2]))
        odds.append(F.exp(log))
    return odds[0] / sum(odds[1:], odds[0])


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def score(docs: DataFrame, threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """FEATURES, quality (posterior probability), base_failed and kept of every document.

    Null or empty text has no words and so fails the base rules. Repeated rows are scored each by itself. An empty
    table gives an empty table.
    """
    rows = checkpointed(feature_rows(docs, *keep))
    model = fit_patterns(rows)
    scored = rows.withColumn("quality", posterior_column(model)).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop("pattern")


def filter_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score() keeps, with their own columns. The votes are taken again rather than joined, so
    that no text is shuffled."""
    model = fit_patterns(feature_rows(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t) for t in texts(batch.column("text"))], np.int64).reshape(-1, len(FEATURES))
            columns = dict(zip(FEATURES, rows.T, strict=True))
            failed = (columns["n_words"] < 50) | (100 * columns["n_repeat_words"] > 50 * columns["n_words"])
            yield batch.filter(pa.array(~failed & (model.posterior(votes_of(columns)) >= threshold)))

    return docs.mapInArrow(lean(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", *BASE, "base_failed", "kept", "quality")
