"""Ship position reports (AIS)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import VESSEL_CLASSES
from .geo import nearest_position


def time_window(ais: DataFrame, start, end, time: str = "Timestamp") -> DataFrame:
    """Reports in [start, end). Every report in the window is kept, also in hours the window only touches."""
    return ais.filter((F.col(time) >= start) & (F.col(time) < end))


def vessels(ais: DataFrame, classes: tuple[str, ...] = VESSEL_CLASSES, kind: str = "Type of mobile") -> DataFrame:
    return ais.filter(F.col(f"`{kind}`").isin(*classes))


def first_reports(ais: DataFrame, order: str, mmsi: str = "MMSI", time: str = "Timestamp") -> DataFrame:
    """The first report, by `order`, of each vessel and time."""
    rows = ais.withColumn("__n", F.row_number().over(Window.partitionBy(mmsi, time).orderBy(order)))
    return rows.filter("__n = 1").drop("__n")


def near_route(ais: DataFrame, positions: DataFrame, order: str, max_dist_m: float = 2000.0, classes: tuple[str, ...] = VESSEL_CLASSES) -> DataFrame:
    """Vessels' first reports within max_dist_m of the cable, with DistToRoute_m and NearestId (a channel_id)."""
    reports = nearest_position(first_reports(vessels(ais, classes), order), positions, "Latitude", "Longitude")
    near = reports.filter(F.col("dist_m") <= max_dist_m).withColumnRenamed("dist_m", "DistToRoute_m")
    ids = positions.select("pos", F.col("channel_id").alias("NearestId"))
    return near.join(ids, "pos").drop("pos")


def transiting(ais: DataFrame, least_knots: float = 1.0) -> DataFrame:
    return ais.filter(F.col("SOG") > least_knots)


def closest_reports(ais: DataFrame, order: str, mmsi: str = "MMSI", dist: str = "DistToRoute_m") -> DataFrame:
    """Each vessel's report closest to the cable, the first of equals."""
    best = F.row_number().over(Window.partitionBy(mmsi).orderBy(dist, order))
    return ais.withColumn("__n", best).filter("__n = 1").drop("__n")
