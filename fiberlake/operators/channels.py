"""Correlation of the channels of an image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zscore(image: DataFrame, *by: str) -> DataFrame:
    """image with value replaced by its z-score within its group (population deviation, 0 where that is 0)."""
    stats = image.groupBy(*by).agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"))
    z = (F.col("value") - F.col("__m")) / F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))
    return image.join(stats, [*by]).withColumn("value", z).select(image.columns)


def neighbor_correlation(image: DataFrame, max_lag: int = 10) -> DataFrame:
    """(lag, rho) for lags 1 .. max_lag: the mean product of z-scores of channels so far apart, over all time bins and
    channels; null where no two channels are so far apart. One shuffle by time bin serves all lags; channels that a time
    bin lacks have no pairs there."""
    across = Window.partitionBy("t").orderBy("channel")
    z = zscore(image, "channel")
    pairs = z.select("value", *[_at_lag(k, across).alias(f"next_{k}") for k in range(1, max_lag + 1)])
    means = pairs.agg(*[F.avg(F.col("value") * F.col(f"next_{k}")).alias(f"r{k}") for k in range(1, max_lag + 1)])
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("rho")) for k in range(1, max_lag + 1)])).alias("x")).select("x.lag", "x.rho")


def _at_lag(k: int, across) -> F.Column:
    """The value k channels further, null if that channel is missing."""
    return F.max("value").over(across.rangeBetween(k, k))


#: Rows of the matrix of sums that travel as one.
GRAM_ROWS = 64


def correlation_matrix(image: DataFrame, channels: list[int] | None = None) -> DataFrame:
    """(i, j, rho): Pearson's correlation of all pairs; a constant channel has 0 everywhere, with itself too. The image is
    dense: each time bin has all channels.

    Time bins become vectors, and each task adds up their products (a matrix product a batch). Only the tasks' sums are
    shuffled, GRAM_ROWS rows of the matrix at a time, so neither the pairs of a time bin nor the image travel twice.
    """
    rows = image if channels is None else image.filter(F.col("channel").isin([int(c) for c in channels]))
    stats = rows.groupBy("channel").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    names = [(r.channel, r.m, r.s) for r in stats.orderBy("channel").collect()]  # a row a channel
    if not names:
        return rows.sparkSession.createDataFrame([], "i int, j int, rho double")
    ids = np.array([c for c, _, _ in names])
    mean, scale = np.array([m for _, m, _ in names]), np.array([s or 1.0 for _, _, s in names])
    vectors = rows.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda x: x["value"]).alias("v"))
    parts = pa.schema([("block", pa.int32()), ("n", pa.int64()), ("sums", pa.binary())])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((len(ids), len(ids)))
        for batch in batches:
            if batch.num_rows and set(batch.column(0).value_lengths().to_pylist()) != {len(ids)}:
                raise ValueError("a time bin lacks channels; the correlation of all pairs needs a dense image")
            z = (batch.column(0).flatten().to_numpy().reshape(-1, len(ids)) - mean) / scale
            total += z.T @ z
            n += len(z)
        if n:
            blocks = range(0, len(ids), GRAM_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array([b // GRAM_ROWS for b in blocks], pa.int32()), pa.array([n] * len(blocks)), pa.array([total[b : b + GRAM_ROWS].tobytes() for b in blocks], pa.binary())], schema=parts)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for block, n, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entry = held.setdefault(block, [0, 0.0])
                entry[0] += n
                entry[1] = entry[1] + np.frombuffer(sums).reshape(-1, len(ids))
        for block, (n, sums) in held.items():
            i = np.repeat(ids[block * GRAM_ROWS : (block + 1) * GRAM_ROWS], len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(np.tile(ids, len(sums)), pa.int32()), pa.array((sums / n).ravel())], names=["i", "j", "rho"])

    sums = vectors.select("v").mapInArrow(products, "block int, n long, sums binary")
    return sums.repartition("block").mapInArrow(added, "i int, j int, rho double")


def pair_correlation(image: DataFrame, i: int, j: int) -> DataFrame:
    """One row (rho): the correlation of two channels, 0 if one is constant; only their rows are read."""
    x, y = (F.max(F.when(F.col("channel") == c, F.col("value"))) for c in (i, j))
    both = image.filter(F.col("channel").isin(i, j)).groupBy("t").agg(x.alias("x"), y.alias("y"))
    rho = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return both.agg(F.coalesce(rho, F.lit(0.0)).alias("rho"))


def sliding_neighbor_correlation(image: DataFrame, window: int, lag: int = 1, step: int | None = None) -> DataFrame:
    """(center, rho): neighbor correlation at one lag within windows of time bins, z-scored inside each window.

    Windows start every `step` (default: window) bins while they fit. Rows are dealt to the windows they lie in, so
    windows are independent groups.
    """
    if window < 2:
        raise ValueError("a window needs 2 time bins at least")
    step = step or window
    last = image.agg(((F.max("t") + 1 - window) / step).alias("n"))
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("t") - window + 1) / step)), F.floor(F.col("t") / step))
    rows = image.withColumn("w", F.explode(F.when(F.col("t") >= 0, starts))).crossJoin(F.broadcast(last)).filter(F.col("w") <= F.col("n")).drop("n")
    z = zscore(rows.select("w", "t", "channel", "value"), "w", "channel")
    pairs = z.withColumn("other", _at_lag(lag, Window.partitionBy("w", "t").orderBy("channel")))
    return pairs.groupBy("w").agg(F.avg(F.col("value") * F.col("other")).alias("rho")).select((F.col("w") * step + window // 2).alias("center"), "rho")


def low_correlation_intervals(series: DataFrame, max_corr: float, min_length: int = 1) -> DataFrame:
    """(start, end, length, mean_corr): the longest runs of consecutive windows with rho at most max_corr; a null breaks
    a run. The series has a row a window, so it is small beside the image and is numbered in one task."""
    order = Window.orderBy("center")
    low = F.coalesce(F.col("rho") <= max_corr, F.lit(False))
    flagged = series.withColumn("low", low).withColumn("n", F.row_number().over(order))
    runs = flagged.filter("low").withColumn("run", F.col("n") - F.row_number().over(order))
    found = runs.groupBy("run").agg(F.min("center").alias("start"), F.max("center").alias("end"), F.count(F.lit(1)).alias("length"), F.avg("rho").alias("mean_corr"))
    return found.filter(F.col("length") >= min_length).drop("run")
