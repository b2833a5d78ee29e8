"""Positions, ship reports, annotations and offsets as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geo import positions_sorted

CABLE = "positions map<string, struct<lat double, lon double, depth double>>, metadata map<string, double>"
REPORTS = "`# Timestamp` string, `Type of mobile` string, MMSI long, Latitude double, Longitude double, SOG double, Name string"


def read_cable(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(positions, metadata) of a cable's JSON: a row for each position with pos, and (name, value) of the metadata."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", CABLE).alias("c"))
    rows = doc.select(F.explode("c.positions").alias("id", "p")).select(F.col("id").cast("int").alias("channel_id"), "p.lat", "p.lon", "p.depth")
    return positions_sorted(rows), doc.select(F.explode_outer("c.metadata").alias("name", "value"))


def read_reports(spark: SparkSession, path: str, time_format: str = "dd/MM/yyyy HH:mm:ss") -> DataFrame:
    """Ship reports of CSV files with a header; column names lose the `# ` they begin with. `ord` is their order: the
    file and the place in it."""
    names = spark.read.option("header", True).csv(path).columns
    known = dict(c.strip().rsplit(" ", 1) for c in REPORTS.replace("`", "").split(","))
    raw = spark.read.option("header", True).schema(", ".join(f"`{n}` {known.get(n, 'string')}" for n in names)).csv(path)
    rows = raw.withColumnsRenamed({n: n.lstrip("# ") for n in names})
    return rows.withColumn("Timestamp", F.to_timestamp_ntz("Timestamp", F.lit(time_format))).withColumn("ord", F.monotonically_increasing_id())


def write_reports_by_hour(reports: DataFrame, path: str) -> None:
    """Reports as Parquet in a folder for each date and hour, so that a time window reads its own hours alone."""
    rows = reports.withColumns({"date": F.to_date("Timestamp"), "hour": F.hour("Timestamp")})
    rows.repartition("date", "hour").write.mode("overwrite").partitionBy("date", "hour").parquet(path)


def annotations_to_json(annotations: DataFrame) -> DataFrame:
    """(json): a row for each file, {"file", "timestamp", "channel_ids", "distances_m"}, lists in the order of channels.

    A row a file instead of one document of all files, so that any number of files can be written and read. annotations:
    (file, center_time, channel, distance_m), or a row for each file as annotate_files gives it, which is not shuffled.
    """
    if "distances_m" in annotations.columns:
        n = F.size("distances_m")
        # without positions build_annotations has no row
        rows = annotations.filter(n > 0).withColumn("l", F.struct(F.sequence(F.lit(0), n - 1).alias("channel"), F.col("distances_m").alias("distance_m")))
    else:
        lists = F.array_sort(F.collect_list(F.struct("channel", "distance_m")))
        rows = annotations.groupBy("file", "center_time").agg(lists.alias("l"))
    doc = F.struct("file", F.date_format("center_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("l.channel").alias("channel_ids"), F.col("l.distance_m").alias("distances_m"))
    return rows.select(F.to_json(doc).alias("json"))


def annotations_from_json(documents: DataFrame) -> DataFrame:
    """annotations_to_json() back."""
    parsed = F.from_json("json", "file string, timestamp string, channel_ids array<int>, distances_m array<double>")
    rows = documents.select(parsed.alias("d")).select("d.file", F.to_timestamp_ntz("d.timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("center_time"), F.explode(F.arrays_zip("d.channel_ids", "d.distances_m")).alias("x"))
    return rows.select("file", "center_time", F.col("x.channel_ids").alias("channel"), F.col("x.distances_m").alias("distance_m"))


def save_annotations(annotations: DataFrame, path: str) -> None:
    annotations_to_json(annotations).write.mode("overwrite").text(path)


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    return annotations_from_json(spark.read.text(path).withColumnRenamed("value", "json"))


def write_table(rows: DataFrame, path: str) -> None:
    """A result table as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


OFFSET = "dlat_m double, dlon_m double, label string, dist_m double, n_candidates long"


def write_offset(offset: DataFrame, path: str) -> None:
    offset.coalesce(1).write.mode("overwrite").json(path)


def read_offset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OFFSET).json(path)


