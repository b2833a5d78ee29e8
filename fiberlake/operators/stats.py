"""Statistics of the channels of an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..schema import MAD_SCALE


def with_median(image: DataFrame, *by: str) -> DataFrame:
    return image.join(image.groupBy(*by).agg(F.median("value").alias("median")), [*by])


def mad(image: DataFrame, *by: str) -> DataFrame:
    """(by, median, mad): the median and the scaled median absolute deviation of each group."""
    rows = with_median(image, *by)
    return rows.groupBy(*by).agg(F.first("median").alias("median"), (F.median(F.abs(F.col("value") - F.col("median"))) * F.lit(MAD_SCALE)).alias("mad"))


def channel_stats(image: DataFrame, int16_bits: int | None = None) -> DataFrame:
    """A row for each channel: median, mean, std, mad, p01, p99, dynamic_range, dropout_frac, saturation_frac.

    A value below a hundredth of the median of medians counts as dropout (below 0 if that is not positive). A value over
    the ceiling counts as saturated: full scale at int16_bits, or else the image's own 99.9th percentile, over which the
    channel with the largest value practically always is.
    """
    base = image.groupBy("channel").agg(
        F.median("value").alias("median"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.percentile("value", F.lit(0.01)).alias("p01"), F.percentile("value", F.lit(0.99)).alias("p99"),
    )
    floor = base.agg(F.median("median").alias("middle")).select(F.when(F.col("middle") > 0, 0.01 * F.col("middle")).otherwise(0.0).alias("floor"))
    ceiling = image.agg(F.percentile("value", F.lit(0.999)).alias("ceiling")) if int16_bits is None else image.sparkSession.createDataFrame([(float(2 ** (int16_bits - 1) - 1),)], "ceiling double")
    limits = F.broadcast(floor.crossJoin(ceiling))  # one row
    rows = image.join(base.select("channel", "median"), "channel").crossJoin(limits)
    share = lambda c: F.avg(c.cast("double"))
    more = rows.groupBy("channel").agg(
        (F.median(F.abs(F.col("value") - F.col("median"))) * F.lit(MAD_SCALE)).alias("mad"),
        share(F.col("value") < F.col("floor")).alias("dropout_frac"), share(F.col("value") > F.col("ceiling")).alias("saturation_frac"),
    )
    dynamic: Column = F.col("p99") / F.greatest(F.col("p01"), F.lit(EPSILON))
    return base.join(more, "channel").select("channel", "median", "mean", "std", "mad", "p01", "p99", dynamic.alias("dynamic_range"), "dropout_frac", "saturation_frac")


#: The spacing of doubles at 1, which keeps the dynamic range finite.
EPSILON = 2.220446049250313e-16


def temporal_profile(image: DataFrame) -> DataFrame:
    """(t, value): the mean over channels."""
    return image.groupBy("t").agg(F.avg("value").alias("value"))


def channel_baseline(image: DataFrame) -> DataFrame:
    """(channel, floor, scale): a robust level and spread; the spread is no less than a millionth of the level (or of 1)."""
    floor = F.col("median")
    return mad(image, "channel").select("channel", floor.alias("floor"), F.greatest(F.col("mad"), F.lit(1e-6) * F.greatest(floor, F.lit(1.0))).alias("scale"))


def describe_shares(rows: DataFrame, by: str, flag: str) -> DataFrame:
    """(by, n, share): how many rows each group has and the share that is flagged."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), ratio(F.sum(F.col(flag).cast("int")), F.count(F.lit(1))).alias("share"))


def describe(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """(by, count, mean, std, min, p25, p50, p75, max) of a column: the sample deviation, quartiles by interpolation;
    nulls do not count."""
    q = F.percentile(column, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    found = rows.groupBy(*by).agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), q.alias("__q"), F.max(column).alias("max"))
    return found.select(*by, "count", "mean", "std", "min", *[F.col("__q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "max")
