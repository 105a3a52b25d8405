"""Balances, fee tiers and trade volumes. Paths are tables (path_id, path array<struct<exchange, coin>>)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import tier_rate

LEAST_TRADE = 100.0
STEPS = (1_000.0, 10_000.0, 100_000.0)
NO_FUNDS, FUNDS = "Insufficient funds", "Sufficient funds available"
KEY = ["exchange", "coin"]


def set_balances(balances: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite balances by key; the last update (by seq) wins, new keys are added."""
    last = updates.groupBy(*KEY).agg(F.max_by("balance", "seq").alias("new"))
    return balances.join(last, KEY, "full_outer").select(*KEY, F.coalesce("new", "balance").alias("balance"))


def balances_of(balances: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (exchange, coin) with its balance, 0 where there is none."""
    return wanted.join(balances.select(*KEY, "balance"), KEY, "left").withColumn("balance", F.coalesce("balance", F.lit(0.0)))


def effective_rates(requests: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """Adds ``rate`` to (exchange, volume): the exchange's own tiers (exchange, lower_bound, rate) where it has some,
    else the default tiers."""
    if tiers is None:
        return requests.withColumn("rate", tier_rate("volume"))
    own = tiers.groupBy("exchange").agg(F.array_sort(F.collect_list(F.struct("lower_bound", "rate"))).alias("__own"))
    reached = F.filter("__own", lambda t: t["lower_bound"] <= F.col("volume"))
    pick = F.when(F.size(reached) > 0, F.element_at(reached, -1)["rate"]).otherwise(F.element_at("__own", 1)["rate"])
    rate = F.when(F.col("__own").isNull(), tier_rate("volume")).otherwise(pick)
    return requests.join(own, "exchange", "left").withColumn("rate", rate).drop("__own")


def _stops(paths: DataFrame) -> DataFrame:
    return paths.select("path_id", F.explode_outer("path").alias("stop")).select("path_id", "stop.exchange", "stop.coin")


def executable_amounts(paths: DataFrame, balances: DataFrame) -> DataFrame:
    """path_id, max_amount: the smallest balance on the path, 0 for a missing one and for an empty path."""
    held = _stops(paths).join(balances, KEY, "left")
    return held.groupBy("path_id").agg(F.coalesce(F.min(F.when(F.col("exchange").isNotNull(), F.coalesce("balance", F.lit(0.0)))), F.lit(0.0)).alias("max_amount"))


def can_execute(paths: DataFrame, balances: DataFrame, amount: float) -> DataFrame:
    """path_id, executable: every stop holds the amount; true for an empty path."""
    held = _stops(paths).join(balances, KEY, "left")
    enough = F.when(F.col("exchange").isNotNull(), F.coalesce("balance", F.lit(0.0)) >= amount)
    return held.groupBy("path_id").agg(F.coalesce(F.bool_and(enough), F.lit(True)).alias("executable"))


def optimise_volumes(offers: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """``offers``: path_id, path, profit_rate, cost_rate, funds. Tries 0, the steps up to the funds and the funds; the
    best positive profit wins, ties the smaller volume; else volume and profit are 0. Fees count for every stop."""
    f = F.greatest(F.coalesce("funds", F.lit(0.0)), F.lit(0.0))
    tries = F.array_distinct(F.array(F.lit(0.0), *[F.least(F.lit(s), f) for s in STEPS], f))
    rows = offers.withColumn("volume", F.explode(tries))
    fees = effective_rates(rows.select("path_id", "volume", F.explode("path").alias("stop")).select("path_id", "volume", "stop.exchange"), tiers)
    fees = fees.groupBy("path_id", "volume").agg(F.sum("rate").alias("fee_rate"))
    net = (F.col("profit_rate") - F.col("cost_rate") - F.col("fee_rate")) * F.col("volume")
    judged = rows.select("path_id", "volume", "profit_rate", "cost_rate").join(fees, ["path_id", "volume"], "left").withColumn("net", F.when(F.col("fee_rate").isNotNull(), net))
    good = F.when(F.col("net") > 0, F.struct("net", -F.col("volume")))
    best = judged.groupBy("path_id").agg(F.max(good).alias("best"))
    return best.select("path_id", F.coalesce(-F.col("best")["col2"], F.lit(0.0)).alias("optimal_volume"), F.coalesce(F.col("best.net"), F.lit(0.0)).alias("optimal_profit"))


def verdicts(offers: DataFrame, balances: DataFrame, least: float = LEAST_TRADE, tiers: DataFrame | None = None) -> DataFrame:
    """``offers``: path_id, path, profit_rate, cost_rate. executable, max_amount, optimal_volume, optimal_profit, reason."""
    most = executable_amounts(offers, balances)
    best = optimise_volumes(offers.join(most, "path_id").withColumn("funds", F.col("max_amount")), tiers)
    enough = F.col("max_amount") >= least
    zero = lambda c: F.when(enough, F.col(c)).otherwise(0.0).alias(c)
    return most.join(best, "path_id").select("path_id", (enough & (F.col("optimal_profit") > 0)).alias("executable"), zero("max_amount"), zero("optimal_volume"), zero("optimal_profit"), F.when(enough, FUNDS).otherwise(NO_FUNDS).alias("reason"))


def summary(balances: DataFrame) -> DataFrame:
    """exchange, total, positions; the row with a null exchange is the whole wallet."""
    return balances.rollup("exchange").agg(F.sum("balance").alias("total"), F.count("*").alias("positions"))
