"""Exact order statistics of a column by refining histograms: no sort, and no task over a fixed number of bins.

The first pass counts values in bins of their sign and logarithm, with the least and greatest value of each. A bin that holds a
wanted place is then cut into BINS equal parts, again with counts and ends, and so on. A value's bin never falls as the
value grows, so the number of values before a bin is exact. A logarithmic bin spans a ninth of its start, which is fewer
than 2 ** 49 doubles; each pass divides that by BINS, so after REFINE passes a bin holds one value. All passes are one plan;
each reads the column and leaves at most BINS rows for each wanted place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1 << 16
REFINE = 4
STEPS = 8  # bins of a power of two
MIDDLE = 20_000  # over the largest number of a logarithmic bin, so that zero lies between
TOP = 1 << 20  # bins of infinity, and above it of NaN, as in Spark's order


def _first_bin(x: Column) -> Column:
    size = F.floor(F.log2(F.abs(x)) * STEPS) + MIDDLE
    bound = F.when(F.abs(x) == F.lit(float("inf")), F.lit(TOP)).otherwise(size).cast("long")
    return F.when(F.isnan(x), F.lit(2 * TOP)).when(x == 0, F.lit(0)).when(x > 0, bound).otherwise(-bound).cast("long")


def _chosen(bins: DataFrame) -> DataFrame:
    """From place, before (what lies before all bins), bin, n, low, high: the bin of each place."""
    order = Window.partitionBy("place").orderBy("bin")
    earlier = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    rows = bins.withColumn("before", earlier)
    return rows.where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n"))).select("place", "before", "low", "high")


def order_statistics(rows: DataFrame, column: str, places: DataFrame) -> DataFrame:
    """place, value: the values of ``column`` (double, nulls left out) at the wanted places, from 0, of their order. ``places``: place
    (long), a few distinct rows. Places at or over the number of values have no row."""
    x = F.col("x")
    values = rows.select(F.col(column).cast("double").alias("x")).where(x.isNotNull())
    ends = [F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")]
    bins = values.groupBy(_first_bin(x).alias("bin")).agg(*ends)
    found = _chosen(bins.join(F.broadcast(places.select("place")), F.lit(True)).withColumn("before", F.lit(0).cast("long")))
    for _ in range(REFINE):
        inside = values.join(F.broadcast(found), (x >= F.col("low")) & (x <= F.col("high")))
        part = F.when(F.col("low") == F.col("high"), F.lit(0)).otherwise(F.floor((x / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS))
        found = _chosen(inside.groupBy("place", "before", part.cast("long").alias("bin")).agg(*ends))
    return found.select("place", F.col("low").alias("value"))


def median(rows: DataFrame, column: str, name: str = "median") -> DataFrame:
    """One row: the mean of the two middle values, or the middle one; null without values."""
    n = rows.agg(F.count(column).alias("n"))
    places = n.where("n > 0").select(F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("place"))
    return order_statistics(rows, column, places).agg(F.avg("value").alias(name))
