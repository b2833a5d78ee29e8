"""Deterministic transforms of an image. axis 0 is time, axis 1 the channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .channels import zscore
from .stats import mad


def _other(axis: int) -> str:
    """The column that stays fixed along an axis."""
    return "channel" if axis == 0 else "t"


def normalize(image: DataFrame, how: str = "zscore", axis: int = 0) -> DataFrame:
    """zscore, robust (median and scaled MAD) or minmax along an axis; a spread of 0 counts as 1."""
    by = _other(axis)
    if how == "zscore":
        return zscore(image, by)
    if how == "robust":
        level, spread, stats = "median", "mad", mad(image, by)
    elif how == "minmax":
        level, spread = "low", "spread"
        stats = image.groupBy(by).agg(F.min("value").alias(level), (F.max("value") - F.min("value")).alias(spread))
    else:
        raise ValueError(f"unknown normalisation {how!r}")
    scale = F.when(F.col(spread) == 0, 1.0).otherwise(F.col(spread))
    return image.join(stats, by).withColumn("value", (F.col("value") - F.col(level)) / scale).select(image.columns)


def detrend(image: DataFrame, axis: int = 0) -> DataFrame:
    """image without the least-squares line of each channel (axis 0) or time bin (axis 1)."""
    by, along = _other(axis), "t" if axis == 0 else "channel"
    x = F.col(along).cast("double")
    stats = image.groupBy(by).agg(F.coalesce(F.try_divide(F.covar_pop(x, "value"), F.var_pop(x)), F.lit(0.0)).alias("__slope"), F.avg(x).alias("__x"), F.avg("value").alias("__y"))
    return image.join(stats, by).withColumn("value", F.col("value") - F.col("__y") - F.col("__slope") * (x - F.col("__x"))).select(image.columns)


def taper(image: DataFrame, fraction: float = 0.1, axis: int = 0) -> DataFrame:
    """image times a Tukey window whose cosine ends take `fraction` of the axis in all."""
    along = "t" if axis == 0 else "channel"
    size = F.broadcast(image.agg((F.max(along) + 1).cast("double").alias("__n")))
    n = F.col("__n")
    from_edge = F.least(F.col(along), n - 1 - F.col(along))
    width = F.lit(fraction / 2) * (n - 1)
    weight = F.when((n <= 1) | (F.lit(fraction) <= 0) | (from_edge >= width), 1.0).otherwise(0.5 * (1 - F.cos(F.pi() * F.try_divide(from_edge.cast("double"), width))))
    return image.crossJoin(size).withColumn("value", F.col("value") * weight).select(image.columns)


def _smooth(image: DataFrame, k: int, by: str, along: str) -> DataFrame:
    if k < 1:
        return image
    return image.withColumn("value", F.avg("value").over(Window.partitionBy(by).orderBy(along).rowsBetween(-k, k)))


def smooth_temporal(image: DataFrame, k: int = 3) -> DataFrame:
    """A centred mean of 2 k + 1 time bins, fewer at the edges."""
    return _smooth(image, k, "channel", "t")


def smooth_spatial(image: DataFrame, k: int = 3) -> DataFrame:
    """A centred mean of 2 k + 1 channels, fewer at the edges."""
    return _smooth(image, k, "t", "channel")


def decimate(image: DataFrame, factor: int, axis: int = 0) -> DataFrame:
    """Means of blocks of `factor`; an incomplete last block is dropped; a factor under 2 changes nothing."""
    if factor < 2:
        return image
    along, by = ("t", "channel") if axis == 0 else ("channel", "t")
    size = F.broadcast(image.agg((F.floor((F.max(along) + 1) / factor) * factor).alias("__n")))
    rows = image.crossJoin(size).filter(F.col(along) < F.col("__n"))
    kind = image.schema[along].dataType
    out = rows.groupBy(F.floor(F.col(along) / factor).cast(kind).alias("__block"), by).agg(F.avg("value").alias("value"))
    return out.withColumnRenamed("__block", along).select(image.columns)


def time_shift(image: DataFrame, shift: int, axis: int = 0) -> DataFrame:
    """image moved forward by shift (modulo the axis' size, so a negative shift moves forward too), filled with 0."""
    along = "t" if axis == 0 else "channel"
    size = F.broadcast(image.agg((F.max(along) + 1).alias("__n")))
    by: Column = F.pmod(F.lit(shift), F.col("__n"))
    kind = image.schema[along].dataType
    moved = image.crossJoin(size).withColumn("__to", F.col(along) + by)
    keep = F.col("__to") < F.col("__n")
    place = F.when(keep, F.col("__to")).otherwise(F.col("__to") - F.col("__n")).cast(kind)
    return moved.withColumns({"value": F.when(keep, F.col("value")).otherwise(0.0), along: place}).select(image.columns)


