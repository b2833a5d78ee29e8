"""Exact quantiles of groups of any size.

Spark's percentile keeps the distinct values of a group in one task, which suits images of a recording but not a channel
with billions of values. refine() finds the same values by counting: each pass deals the values around each wanted rank
to BINS bins, and goes on with the bin that holds the rank, until the bin is a single value. A pass keeps BINS rows a
group and rank, combined before they are shuffled, and never a group's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def percentiles(rows: DataFrame, by: list[str], probs: list[float], value: str = "value") -> DataFrame:
    """(by, q): an array of the quantiles, linear between ranks, by Spark's percentile."""
    return rows.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias("q"))


def refine(rows: DataFrame, by: list[str], probs: list[float], value: str = "value") -> DataFrame:
    """The same for groups of any size. Nulls do not count; groups without values are absent, as are those of a null key.

    The driver holds two rows for each group and quantile between passes, so groups should be channels and the like.
    """
    spark = rows.sparkSession
    data = rows.select(*by, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    span = data.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs) for s in (0, 1)]))
    place = F.col("__w.p") * (F.col("__n") - 1)
    targets = span.withColumn("__w", wanted).select(
        *by, F.col("__w.i").alias("__i"), F.col("__w.s").alias("__s"), (place - F.floor(place)).alias("__part"),
        F.least(F.floor(place) + F.col("__w.s"), F.col("__n") - 1).cast("long").alias("__rank"), "__lo", "__hi",
    )
    columns = targets.columns
    keys = [*by, "__i", "__s"]
    order = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        # a row a group and rank, small beside the data; written out, so that passes do not pile up
        held = spark.createDataFrame(targets.collect(), targets.schema)
        if held.filter("__lo < __hi").isEmpty():
            break
        width = F.col("__hi") - F.col("__lo")
        number = F.least(F.floor((F.col("__v") - F.col("__lo")) / width * BINS), F.lit(BINS - 1)).cast("int")
        near = data.join(F.broadcast(held.filter("__lo < __hi")), by) if by else data.crossJoin(F.broadcast(held.filter("__lo < __hi")))
        near = near.filter(F.col("__v").between(F.col("__lo"), F.col("__hi")))
        bins = near.groupBy(*keys, number.alias("__bin")).agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__a"), F.max("__v").alias("__b"), F.first("__rank").alias("__rank"), F.first("__part").alias("__part"))
        before = F.coalesce(F.sum("__c").over(order), F.lit(0))
        hit = bins.withColumn("__before", before).filter((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__c")))
        found = hit.select(*keys, "__part", (F.col("__rank") - F.col("__before")).alias("__rank"), F.col("__a").alias("__lo"), F.col("__b").alias("__hi"))
        targets = found.select(columns).unionByName(held.filter("__lo = __hi").select(columns))
    at = lambda s: F.max(F.when(F.col("__s") == s, F.col("__lo")))
    each = held.groupBy(*by, "__i").agg((at(0) + (at(1) - at(0)) * F.max("__part")).alias("__q"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__q"))), lambda x: x["__q"]).alias("q"))
