"""Events against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import epoch_seconds
from .ais import closest_reports
from .annotate import with_scores
from .geo import nearest_position, on_plane, reference_point
from .nearest import nearest


def ground_truth_crossings(ais: DataFrame, positions: DataFrame, order: str) -> DataFrame:
    """(MMSI, timestamp, channel, Latitude, Longitude, DistToRoute_m): each vessel's closest report and its channel."""
    found = nearest_position(closest_reports(ais, order), positions, "Latitude", "Longitude")
    return found.select("MMSI", F.col("Timestamp").alias("timestamp"), F.col("pos").alias("channel"), "Latitude", "Longitude", "DistToRoute_m")


def _nearest_truth(detections: DataFrame, truth: DataFrame, positions: DataFrame) -> DataFrame:
    """detections (det_id, channel, timestamp) with the nearest truth (gt_id, smallest of equals) and dist_m, dt.

    Distances depend on channels alone, so the nearest crossing is searched once a channel; detections meet a table of
    the cable's channels.
    """
    places = on_plane(positions.select(F.col("pos").alias("channel"), "lat", "lon"), reference_point(positions)).select("channel", "__x", "__y")
    # ranked by gt_id, one crossing a vessel; the rank decides between equals
    ranked = truth.select("gt_id", F.col("channel").alias("gt_channel"), epoch_seconds(F.col("timestamp")).alias("gt_t")).withColumn("__rank", F.row_number().over(Window.orderBy("gt_id", "gt_t", "gt_channel")) - 1)
    points = ranked.join(places, F.col("gt_channel") == F.col("channel")).select(F.col("__rank").alias("pos"), F.col("__x").alias("x"), F.col("__y").alias("y"))
    best = nearest(places, points, "__x", "__y").select("channel", "dist_m", F.col("pos").cast("int").alias("__rank")).join(ranked, "__rank").drop("__rank")
    return detections.join(best, "channel").select(*detections.columns, "dist_m", "gt_id", "gt_channel", F.abs(epoch_seconds(F.col("timestamp")) - F.col("gt_t")).alias("dt"))


def match_detections(detections: DataFrame, truth: DataFrame, positions: DataFrame, max_range_m: float, max_time_s: float = 300.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched, false positives, false negatives), one to one.

    detections need det_id and truth gt_id besides channel and timestamp. Each detection may match only the crossing
    nearest in space (closer than max_range_m), and is lost if that one is over max_time_s away; each crossing takes its
    closest detection, the smallest det_id of equals.
    """
    near = _nearest_truth(detections, truth, positions).filter((F.col("dist_m") < max_range_m) & (F.col("dt") <= max_time_s))
    first = F.row_number().over(Window.partitionBy("gt_id").orderBy("dist_m", "det_id"))
    matched = near.withColumn("n", first).filter("n = 1").drop("n", "dt")
    return matched, detections.join(matched.select("det_id"), "det_id", "left_anti"), truth.join(matched.select("gt_id"), "gt_id", "left_anti")


def compute_metrics(tp: int, fp: int, fn: int, spark) -> DataFrame:
    """One row of tp, fp, fn, accuracy (without true negatives), precision, recall and f1."""
    counts = spark.createDataFrame([(tp, fp, fn)], "tp long, fp long, fn long")
    return with_scores(counts, F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))


def evaluate_at_ranges(detections: DataFrame, truth: DataFrame, positions: DataFrame, ranges_m: list[float] = (250.0, 500.0, 1000.0), max_time_s: float = 300.0) -> DataFrame:
    """A row of metrics for each range. Nearest crossings do not depend on the range and are searched once."""
    near = _nearest_truth(detections, truth, positions).filter(F.col("dt") <= max_time_s)
    best = near.groupBy("gt_id").agg(F.min("dist_m").alias("dist_m"))
    hits = best.agg(*[F.count_if(F.col("dist_m") < float(r)).alias(f"tp{i}") for i, r in enumerate(ranges_m)])
    sizes = detections.agg(F.count(F.lit(1)).alias("nd")).crossJoin(truth.agg(F.count(F.lit(1)).alias("ng")))
    each = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("range_m"), F.col(f"tp{i}").alias("tp")) for i, r in enumerate(ranges_m)]))
    rows = hits.crossJoin(sizes).select(each.alias("x"), "nd", "ng").select("x.range_m", "x.tp", (F.col("nd") - F.col("x.tp")).alias("fp"), (F.col("ng") - F.col("x.tp")).alias("fn"))
    return with_scores(rows, F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))
