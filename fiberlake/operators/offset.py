"""The geographic offset of a cable, from ships that pass it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import distance, epoch_seconds, offset_m
from .geo import nearest_position
from .nearest import nearest


def closest_approach_offsets(candidates: DataFrame, image: DataFrame, positions: DataFrame, channel_spacing_m: float, margins_m: list[float] = (1500.0,)) -> DataFrame:
    """(candidate columns, margin_m, dlat_m, dlon_m, dist_m): where each candidate (cand_id, Latitude, Longitude,
    Timestamp) is, seen from the loudest channel within each margin of its nearest one, at the time bin nearest to it.

    image: (bin_time, t, channel, value). The margin is [nearest - m, nearest + m), m rounded half to even; a margin
    without channels gives no row. Only the candidates' bins of the image are read past the join, once for all margins.
    """
    size = F.broadcast(image.agg(F.max("channel").alias("__last")))
    bins = image.select(F.col("t").cast("long").alias("pos"), epoch_seconds(F.col("bin_time")).alias("x"), F.lit(0.0).alias("y")).distinct()
    timed = nearest(candidates.withColumns({"__t": epoch_seconds(F.col("Timestamp")), "__zero": F.lit(0.0)}), bins, "__t", "__zero")
    timed = timed.select(*candidates.columns, F.col("pos").alias("__bin"))  # the smallest t of equally near bins
    seen = nearest_position(timed, positions, "Latitude", "Longitude").crossJoin(size)
    margins = F.explode(F.array(*[F.struct(F.lit(float(m)).alias("margin_m"), F.lit(round(m / channel_spacing_m)).alias("m")) for m in margins_m]))
    asked = seen.select(*candidates.columns, F.col("__bin").alias("t"), F.least(F.col("pos"), F.col("__last")).alias("near"), margins.alias("x"))
    cells = image.select("t", "channel", "value").join(F.broadcast(asked.select("t").distinct()), "t", "left_semi")
    met = asked.join(cells, (asked.t == cells.t) & (F.col("channel") >= F.col("near") - F.col("x.m")) & (F.col("channel") < F.col("near") + F.col("x.m")))
    loud = met.groupBy(*candidates.columns, F.col("x.margin_m").alias("margin_m")).agg(F.max(F.struct("value", (-F.col("channel")).alias("c"))).alias("best"))
    at = loud.withColumn("pos", -F.col("best.c")).drop("best").join(F.broadcast(positions.select("pos", "lat", "lon")), "pos")
    dlat, dlon = offset_m(F.col("Latitude"), F.col("Longitude"), F.col("lat"), F.col("lon"))
    return at.withColumns({"dlat_m": dlat, "dlon_m": dlon}).withColumn("dist_m", distance(F.col("dlat_m"), F.col("dlon_m"))).drop("lat", "lon").withColumnRenamed("pos", "channel")


def estimate_translation(offsets: DataFrame) -> DataFrame:
    """(margin_m, dlat_m, dlon_m, dist_m): the medians of the candidates' offsets for each margin."""
    medians = offsets.groupBy("margin_m").agg(F.median("dlat_m").alias("dlat_m"), F.median("dlon_m").alias("dlon_m"))
    return medians.withColumn("dist_m", distance(F.col("dlat_m"), F.col("dlon_m")))


def margin_sensitivity(candidates: DataFrame, image: DataFrame, positions: DataFrame, channel_spacing_m: float, margins_m: list[float]) -> DataFrame:
    return estimate_translation(closest_approach_offsets(candidates, image, positions, channel_spacing_m, margins_m))


def offset_winner(sweeps: DataFrame, last_margins: list[float], expected: tuple[float, float] = (1200.0, 1500.0)) -> DataFrame:
    """The sweep (label, margin_m, dlat_m, dlon_m, dist_m) whose two last margins agree best, one in the expected range
    before all others: (label, dlat_m, dlon_m, dist_m, plateau_spread, in_range)."""
    rows = sweeps.filter(F.col("margin_m").isin([float(m) for m in last_margins]))
    last = float(last_margins[-1])
    ends = rows.groupBy("label").agg((F.max("dist_m") - F.min("dist_m")).alias("plateau_spread"), *[F.max(F.when(F.col("margin_m") == last, F.col(c))).alias(c) for c in ("dlat_m", "dlon_m", "dist_m")])
    return ends.withColumn("in_range", F.col("dist_m").between(*expected)).orderBy(F.desc("in_range"), "plateau_spread", "label").limit(1)
