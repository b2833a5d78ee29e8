"""Positions, distances and nearest channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import local_xy
from ..schema import METERS_PER_DEGREE_LAT
from .nearest import nearest

def positions_sorted(positions: DataFrame) -> DataFrame:
    """positions with `pos`, the 0-based place in the order of channel_id. A cable's table is small and is ranked in one
    task."""
    return positions.withColumn("pos", (F.row_number().over(Window.orderBy("channel_id")) - 1).cast("int"))


def reference_point(positions: DataFrame) -> DataFrame:
    """One row (ref_lat, ref_lon): the mean position."""
    return positions.agg(F.avg("lat").alias("ref_lat"), F.avg("lon").alias("ref_lon"))


def on_plane(rows: DataFrame, ref: DataFrame, lat: str = "lat", lon: str = "lon", x: str = "__x", y: str = "__y") -> DataFrame:
    """rows with metres east and north (x, y) of the reference point, a table of one row."""
    east, north = local_xy(F.col(lat), F.col(lon), F.col("ref_lat"), F.col("ref_lon"))
    return rows.crossJoin(F.broadcast(ref)).withColumns({x: east, y: north}).drop("ref_lat", "ref_lon")


def nearest_position(probes: DataFrame, positions: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """probes with dist_m and pos of the nearest position (the smallest pos of equals), null for probes without a place;
    distances are taken on the plane at the mean position. See nearest.py for the index."""
    ref = reference_point(positions)
    points = on_plane(positions.select("pos", "lat", "lon"), ref).select("pos", F.col("__x").alias("x"), F.col("__y").alias("y"))
    found = nearest(on_plane(probes, ref, lat, lon), points, "__x", "__y")
    return found.select(*probes.columns, "dist_m", F.col("pos").cast("int").alias("pos"))


def apply_translation(positions: DataFrame, dlat_m: float, dlon_m: float) -> DataFrame:
    """positions moved by metres north and east; a degree of longitude is taken at each point's own latitude."""
    lon = F.col("lon") + F.lit(dlon_m) / (F.lit(METERS_PER_DEGREE_LAT) * F.cos(F.radians("lat")))
    return positions.withColumns({"lat": F.col("lat") + F.lit(dlat_m) / F.lit(METERS_PER_DEGREE_LAT), "lon": lon})


def geojson_linestring(positions: DataFrame, name: str = "cable", properties: dict[str, object] | None = None) -> DataFrame:
    """One row (geojson): a feature collection with the cable as one line, in the order of channel_id. `properties` are
    added to the feature's own, which has the name."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("channel_id", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*[F.lit(v).alias(k) for k, v in {"name": name, **(properties or {})}.items()]).alias("properties"),
        F.struct(F.lit("LineString").alias("type"), points.alias("coordinates")).alias("geometry"),
    )
    return positions.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("geojson"))
