"""Rolling statistics over the last N rows of a key, in order of arrival (``seq``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import volatility_multiple
from fathom.operators.tables import ranked

PRICE_WINDOW = 100
TRANSFER_WINDOW = 50
STRETCH = 1 << 16  # ticks of a key that one window works out
DEFAULT_VOLATILITY = 0.1
LEAST_VOLATILITY = 0.001
DEFAULT_PERCENTILE = 95.0
DEFAULT_TRANSFER_TIME = 60.0
MARKET = ["exchange", "coin"]
ROUTE = ["src_exchange", "src_coin", "dst_exchange", "dst_coin"]


def _volatility(rows: DataFrame, window: int, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("seq")
    before = F.lag("price").over(order)
    step = F.when(before > 0, F.col("price") / before - 1)
    # N prices have N - 1 returns; the frame is over price rows, so left-out returns keep their place.
    frame = order.rowsBetween(-(window - 2), 0)
    rows = rows.withColumn("__return", step)
    spread = F.when(F.count("__return").over(frame) < 2, F.lit(DEFAULT_VOLATILITY)).otherwise(F.greatest(F.stddev_pop("__return").over(frame), F.lit(LEAST_VOLATILITY)))
    return rows.withColumn("volatility", spread).drop("__return")


def rolling_volatility(ticks: DataFrame, window: int = PRICE_WINDOW, keys: list[str] | None = None, stretch: int = STRETCH) -> DataFrame:
    """Adds ``volatility`` after each tick: population deviation of the returns among the last ``window`` prices, at
    least 0.001; 0.1 with fewer than two returns. A return after a price <= 0 is left out, its price still counts.

    A key's ticks are cut into stretches of ``stretch`` rows by their ranks. Each stretch is worked out by itself, behind a
    copy of the ``window`` - 1 ticks before it, so a key of any size is many tasks."""
    keys = keys or MARKET
    halo, stretch = window - 1, max(stretch, window)
    place, own = F.col("__rank") % stretch, F.floor(F.col("__rank") / stretch)
    rows = ranked(ticks, keys, ["seq"], "__rank")
    rows = rows.withColumn("__stretch", F.explode(F.when(place >= stretch - halo, F.array(own, own + 1)).otherwise(F.array(own))))
    out = _volatility(rows, window, [*keys, "__stretch"])
    return out.where(F.col("__stretch") == own).select(*ticks.columns, "volatility")


def since_clear(rows: DataFrame, clears: DataFrame) -> DataFrame:
    """Rows after the last clearing of the history (the highest ``seq`` of ``clears``); all rows if there was none."""
    last = clears.agg(F.max("seq").alias("__cleared"))
    return rows.join(F.broadcast(last), F.col("__cleared").isNull() | (F.col("seq") > F.col("__cleared"))).drop("__cleared")


def last_rows(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("seq").desc()))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def latest_volatility(ticks: DataFrame, window: int = PRICE_WINDOW, keys: list[str] | None = None) -> DataFrame:
    """The volatility of each key now. Only the last ``window`` ticks of a key are looked at."""
    keys = keys or MARKET
    recent = _volatility(last_rows(ticks, keys, window), window, keys)
    return recent.groupBy(*keys).agg(F.max_by("volatility", "seq").alias("volatility"))


def volatility_factors(ticks: DataFrame, base: float = 0.1, window: int = PRICE_WINDOW, keys: list[str] | None = None) -> DataFrame:
    return latest_volatility(ticks, window, keys).withColumn("factor", volatility_multiple("volatility", base))


def transfer_estimates(transfers: DataFrame, routes: DataFrame | None = None, percentile: float = DEFAULT_PERCENTILE, window: int = TRANSFER_WINDOW, default: float = DEFAULT_TRANSFER_TIME, keys: list[str] | None = None) -> DataFrame:
    """estimated_time (linear percentile) and average_time of the last ``window`` transfers of each route; routes of
    ``routes`` without history get the default."""
    keys = keys or ROUTE
    known = last_rows(transfers, keys, window).groupBy(*keys).agg(F.percentile("actual_time", F.lit(percentile / 100.0)).alias("estimated_time"), F.avg("actual_time").alias("average_time"))
    if routes is None:
        return known
    filled = routes.join(known, keys, "left")
    return filled.withColumn("estimated_time", F.coalesce("estimated_time", F.lit(default))).withColumn("average_time", F.coalesce("average_time", F.lit(default)))
