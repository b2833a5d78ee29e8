"""Images: one value for each time bin and channel, in long form (t, channel, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ARRAY_REDUCERS, ROW_REDUCERS, reducer
from ..functions.kernels import bandpass_kernel, on_rows
from ..schema import DEFAULT_BANDPASS_HZ


def from_vectors(rows: DataFrame, t: str, vector: str) -> DataFrame:
    """An image from rows that hold all channels of a time bin."""
    return rows.select(F.col(t).cast("long").alias("t"), F.posexplode(vector).alias("channel", "value")).withColumn("value", F.col("value").cast("double"))


def to_rows(image: DataFrame) -> DataFrame:
    """(t, row): the channels of each time bin in order."""
    return image.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda x: x["value"]).alias("row"))


def to_series(image: DataFrame) -> DataFrame:
    """(channel, series): the time bins of each channel in order."""
    return image.groupBy("channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("series"))


def reduce_rows(image: DataFrame, name: str, *by: str) -> DataFrame:
    """A reducer over the values of each group."""
    return image.groupBy(*by).agg(reducer(name, ROW_REDUCERS)(F.col("value")).alias("value"))


def filtered(waveform: DataFrame, fs: float, band: tuple[float, float]) -> DataFrame:
    """waveform with band-passed samples. Each channel is filtered where its row is; nothing is shuffled."""
    return waveform.withColumn("samples", on_rows(bandpass_kernel(fs, *band), F.col("samples")))


def build_image(waveform: DataFrame, name: str = "rms", fs: float | None = None, band: tuple[float, float] | None = None) -> DataFrame:
    """(file, file_ts, channel, value): a reducer over each file and channel, at single precision, after a band-pass if
    one is given."""
    reduce = reducer(name, ARRAY_REDUCERS)
    rows = waveform if band is None else filtered(waveform, fs, band)
    return rows.select("file", "file_ts", "channel", reduce(F.col("samples")).cast("float").cast("double").alias("value"))


def bandpass_energy_image(waveform: DataFrame, fs: float, band: tuple[float, float] = DEFAULT_BANDPASS_HZ) -> DataFrame:
    """The mean square of each band-passed file and channel (no root, double precision)."""
    return filtered(waveform, fs, band).select("file", "file_ts", "channel", ARRAY_REDUCERS["mean_square"](F.col("samples")).alias("value"))


def crop(image: DataFrame, t0: int | None = None, t1: int | None = None, c0: int | None = None, c1: int | None = None) -> DataFrame:
    """The part [t0, t1) x [c0, c1), counted from 0 again; negative bounds count from the end, None is the end."""
    needs_size = any(v is not None and v < 0 for v in (t0, t1, c0, c1))
    size = image.agg(F.max("t") + 1, F.max("channel") + 1).first() if needs_size else (None, None)

    def bound(v: int | None, n: int | None) -> int | None:
        return v if v is None or v >= 0 else max(0, v + (n or 0))

    (t0, t1), (c0, c1) = (bound(t0, size[0]), bound(t1, size[0])), (bound(c0, size[1]), bound(c1, size[1]))
    rows = image
    for column, low, high in (("t", t0, t1), ("channel", c0, c1)):
        if low is not None:
            rows = rows.filter(F.col(column) >= low)
        if high is not None:
            rows = rows.filter(F.col(column) < high)
    return rows.withColumns({"t": F.col("t") - F.lit(t0 or 0), "channel": (F.col("channel") - F.lit(c0 or 0)).cast("int")})
