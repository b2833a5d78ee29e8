"""STA/LTA over a stream of energy bins, with the last bins of each channel as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "channel int, seq long, value double, ratio double"
STATE = "last long, history array<double>, late long"


def ratios(history: np.ndarray, values: np.ndarray, short: int, long: int) -> np.ndarray:
    """The ratio at each value, with the values before it in history; NaN while nothing precedes the short mean."""
    x = np.concatenate([history, values])
    total = np.concatenate([[0.0], np.cumsum(x)])
    i = np.arange(len(history), len(x))
    a, b = np.maximum(i - short + 1, 0), np.maximum(i - short + 1 - long, 0)
    sta = (total[i + 1] - total[a]) / (i + 1 - a)
    count = a - b
    lta = np.divide(total[a] - total[b], count, out=np.full(len(i), np.nan), where=count > 0)
    return sta / np.where(np.isnan(lta), np.nan, np.maximum(lta, 1e-12))


def sta_lta(bins: DataFrame, short: int, long: int) -> DataFrame:
    """bins (channel, seq, value), a stream in which seq rises with time, with ratio.

    Bins of a trigger are put in order; a bin no newer than the last one of an earlier trigger is late and gives no row,
    as its place in the averages has passed. The state of a channel is its last short + long bins.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, history, late = state.get if state.exists else (-(1 << 62), [], 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        fresh = rows[rows["seq"] > last].drop_duplicates("seq")
        held, values = np.array(history, float), fresh["value"].to_numpy(float)
        if len(values):
            found = ratios(held, values, short, long)
            yield pd.DataFrame({"channel": key[0], "seq": fresh["seq"].to_numpy(), "value": values, "ratio": [None if np.isnan(r) else r for r in found]})
            last = int(fresh["seq"].iloc[-1])
            held = np.concatenate([held, values])[-(short + long) :]
        state.update((last, held.tolist(), int(late) + len(rows) - len(fresh)))

    return bins.select("channel", "seq", "value").groupBy("channel").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with a time zone; ts is taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, length: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """(start, event_type, n, mean) of closed windows; events over `delay` late are left out."""
    w = _timed(events).withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def session_counts(events: DataFrame, gap: str = "4 hours", delay: str = "1 hour") -> DataFrame:
    """(user_id, start, n) of closed sessions."""
    w = _timed(events).withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n")
