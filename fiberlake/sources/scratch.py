"""A folder for tables that are written and read again by one application."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that spark.checkpoint.dir names, removed when the application ends; without one, and
    on a local master alone, in the machine's own temporary folder."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="fiberlake-scratch-")
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
