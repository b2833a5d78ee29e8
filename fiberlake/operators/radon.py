"""Slant stacks (Radon) of energy patches, which find sources that move along the fibre."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import bandpass_kernel, on_rows
from ..schema import DEFAULT_BANDPASS_HZ, MAD_SCALE
from .detect import _trimmed, step_channels


def linear_radon_stack(patches: DataFrame, slownesses: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, si, t0, value): the mean along each line t0 + round(k * slowness) over the patch's channels k.

    patches: (by, t, k, value), dense in t and k from 0. Only lines that lie within the patch are there. Each cell adds
    to one line of every slowness, so lines are gathered by an aggregate and nothing is joined.
    """
    lines = F.explode(F.array(*[F.struct(F.lit(i).alias("si"), F.lit(float(s)).alias("s")) for i, s in enumerate(slownesses)])).alias("line")
    size = patches.groupBy(*by).agg((F.max("t") + 1).alias("__t"), (F.max("k") + 1).alias("__k"))
    cells = patches.select(*by, "t", "k", "value", lines)
    stacked = cells.groupBy(*by, F.col("line.si").alias("si"), (F.col("t") - F.rint(F.col("k") * F.col("line.s"))).cast("long").alias("t0")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("__n"))
    sized = stacked.join(F.broadcast(size), [*by]) if by else stacked.crossJoin(F.broadcast(size))
    # a line is whole if every channel gave a cell to it
    return sized.filter((F.col("__n") == F.col("__k")) & (F.col("t0") >= 0) & (F.col("t0") < F.col("__t"))).select(*by, "si", "t0", "value")


def radon_score(stack: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, score, si, t0): the best line; of equals the one with the smallest slowness number and then start."""
    best = F.max(F.struct("value", (-F.col("si")).alias("a"), (-F.col("t0")).alias("b"))).alias("best")
    found = stack.groupBy(*by).agg(best)
    return found.select(*by, F.col("best.value").alias("score"), (-F.col("best.a")).alias("si"), (-F.col("best.b")).alias("t0"))


def radon_ratio(stack: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, ratio): the best line against the stack's own median and scaled MAD."""
    level = stack.groupBy(*by).agg(F.median("value").alias("m"), F.max("value").alias("best"))
    spread = stack.join(level, [*by]).groupBy(*by).agg((F.median(F.abs(F.col("value") - F.col("m"))) * F.lit(MAD_SCALE)).alias("mad"))
    return level.join(spread, [*by]).select(*by, ((F.col("best") - F.col("m")) / F.greatest("mad", F.lit(1e-12))).alias("ratio"))


def patches_around(power: DataFrame, targets: DataFrame, radius: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, target, t, k, value): the channels within radius of each target; k counts from the patch's left edge, also
    where the fibre's end cuts the patch. Patches of under 3 channels are left out."""
    near = F.explode(F.sequence(F.greatest(F.lit(0), F.col("target") - radius), F.col("target") + radius))
    wanted = targets.select(F.col("channel").alias("target")).select("target", F.greatest(F.lit(0), F.col("target") - radius).alias("__lo"), near.alias("channel"))
    last = F.broadcast(power.agg(F.max("channel").alias("__last")))
    wanted = wanted.crossJoin(last).filter((F.col("channel") <= F.col("__last")) & (F.least(F.col("__last"), F.col("target") + radius) - F.col("__lo") >= 2))
    return power.join(F.broadcast(wanted.drop("__last")), "channel").select(*by, "target", "t", (F.col("channel") - F.col("__lo")).cast("int").alias("k"), "value")


def radon_detect_stream(waveform: DataFrame, fs: float, step: int, radius: int, slownesses: list[float], bin_s: float = 0.25, band: tuple[float, float] = DEFAULT_BANDPASS_HZ, threshold: float = 6.0) -> DataFrame:
    """(file, timestamp, time_s, channel, score, triggered): a row for each file and stepped channel with a patch of 3
    channels at least and a line within it."""
    kernel, size = bandpass_kernel(fs, *band), max(1, round(bin_s * fs))

    def power(x):
        y = _trimmed(kernel(x), fs)
        n = y.shape[1] // size
        return (y[:, : n * size] ** 2).reshape(len(y), n, size).mean(axis=2)

    bins = waveform.withColumn("samples", on_rows(power, F.col("samples"))).select("file", "file_ts", "channel", F.posexplode("samples").alias("t", "value"))
    by = ("file", "file_ts", "target")
    stack = linear_radon_stack(patches_around(bins, step_channels(waveform, step), radius, ("file", "file_ts")), slownesses, by)
    found = radon_ratio(stack, by)
    return found.select("file", F.col("file_ts").alias("timestamp"), F.lit(0.0).alias("time_s"), F.col("target").alias("channel"), F.col("ratio").alias("score"), (F.col("ratio") >= threshold).alias("triggered"))
