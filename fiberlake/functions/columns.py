"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import METERS_PER_DEGREE_LAT, MORLET_W0


def local_xy(lat: Column, lon: Column, ref_lat: Column, ref_lon: Column) -> tuple[Column, Column]:
    """Metres east and north of a reference point, on a plane that touches the earth there."""
    scale = F.lit(METERS_PER_DEGREE_LAT)
    return (lon - ref_lon) * scale * F.cos(F.radians(ref_lat)), (lat - ref_lat) * scale


def offset_m(lat: Column, lon: Column, ref_lat: Column, ref_lon: Column) -> tuple[Column, Column]:
    """(dlat_m, dlon_m): metres north and east of a reference point."""
    x, y = local_xy(lat, lon, ref_lat, ref_lon)
    return y, x


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as double, of a timestamp of either kind."""
    return epoch_micros(ts) / 1e6


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970, of a timestamp of either kind."""
    return F.unix_micros(ts.cast("timestamp"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def morlet_scale_for_freq(freq: Column | float, w0: float = MORLET_W0) -> Column:
    """The scale at which a Morlet wavelet is centred on a frequency."""
    freq = F.lit(freq) if isinstance(freq, (int, float)) else freq
    return F.lit(w0 + (2 + w0 * w0) ** 0.5) / (4 * F.pi() * freq)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _array_mean(values: Column) -> Column:
    return F.try_divide(_sum(values), F.size(values).cast("double"))


def _array_std(values: Column) -> Column:
    mean = _array_mean(values)
    return F.sqrt(_array_mean(F.transform(values, lambda x: (x - mean) * (x - mean))))


#: Reducers of an array of samples to one value.
ARRAY_REDUCERS: dict[str, Callable[[Column], Column]] = {
    "rms": lambda v: F.sqrt(_array_mean(F.transform(v, lambda x: x * x))),
    "std": _array_std,
    "mean": _array_mean,
    "abs_mean": lambda v: _array_mean(F.transform(v, F.abs)),
    "max": lambda v: F.array_max(F.transform(v, F.abs)),
    "mean_square": lambda v: _array_mean(F.transform(v, lambda x: x * x)),
}
#: The same as aggregates over rows.
ROW_REDUCERS: dict[str, Callable[[Column], Column]] = {
    "rms": lambda v: F.sqrt(F.avg(v * v)),
    "std": F.stddev_pop,
    "mean": F.avg,
    "abs_mean": lambda v: F.avg(F.abs(v)),
    "max": lambda v: F.max(F.abs(v)),
    "mean_square": lambda v: F.avg(v * v),
}


def reducer(name: str, of: dict[str, Callable[[Column], Column]]) -> Callable[[Column], Column]:
    if name not in of:
        raise ValueError(f"unknown reducer {name!r}; known: {sorted(of)}")
    return of[name]
