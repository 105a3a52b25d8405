"""Generated markets and panels. Numbers come from a hash of (seed, place), so they don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import edge_weight
from fathom.operators.build import COLUMNS, COSTS, node_pairs

COINS = ("USDT", "USDC", "DAI")


def uniform(low: float, high: float, seed: int, *place: Column) -> Column:
    """Uniform in [low, high), by hash."""
    unit = F.pmod(F.xxhash64(F.lit(seed), *place), F.lit(1 << 53)).cast("double") / float(1 << 53)
    return F.lit(low) + unit * (high - low)


def market_nodes(spark: SparkSession, exchanges: int, coins: int, base: float, spread: float, seed: int, snapshots: DataFrame | None = None, key: str = "sim_id") -> DataFrame:
    """Exchange1..n with the first coins (3 at most), price within base * (1 +- spread)."""
    k = min(coins, len(COINS))
    ids = F.sequence(F.lit(0), F.lit(exchanges * k - 1)) if exchanges * k else F.array().cast("array<int>")
    rows = (spark.range(1).select(F.lit(0).alias(key)) if snapshots is None else snapshots.select(key)).withColumn("node_id", F.explode(ids))
    names = F.array(*map(F.lit, COINS))
    price = uniform(base * (1 - spread), base * (1 + spread), seed, F.lit("price"), F.col(key), F.col("node_id"))
    out = rows.select(key, "node_id", F.concat(F.lit("Exchange"), (F.expr(f"node_id div {k}") + 1).cast("string")).alias("exchange"), names[F.col("node_id") % k].alias("coin"), price.alias("price"))
    return out.drop(key) if snapshots is None else out


def _edges(nodes: DataFrame, fee: Column, volatility: Column, time: Column, key: str | None = None) -> DataFrame:
    out = node_pairs(nodes, key).withColumn("fee", fee).withColumn("volatility_cost", volatility).withColumn("transfer_time", time).withColumn("weight", edge_weight())
    return out.select(*([key] if key else []), *COLUMNS, *COSTS)


def synthetic_market(spark: SparkSession, exchanges: int = 4, coins: int = 3, base: float = 1.0, spread: float = 0.01, fees=(0.001, 0.005), volatility=(0.0001, 0.001), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    nodes = market_nodes(spark, exchanges, coins, base, spread, seed)
    at = (F.col("src"), F.col("dst"))
    return nodes, _edges(nodes, uniform(*fees, seed, F.lit("fee"), *at), uniform(*volatility, seed, F.lit("vol"), *at), uniform(30, 300, seed, F.lit("time"), *at))


def adversarial_market(spark: SparkSession, exchanges: int = 4, coins: int = 3, high_volatility: bool = True, asymmetric_fees: bool = True, illiquid: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Wide prices, a share of dear edges, doubled costs where markets are illiquid."""
    nodes = market_nodes(spark, exchanges, coins, 1.0, 0.05 if high_volatility else 0.01, seed)
    at = (F.col("src"), F.col("dst"))
    u = lambda low, high, name: uniform(low, high, seed, F.lit(name), *at)
    fee = F.when(u(0, 1, "dear") < 0.3, u(0.01, 0.05, "fee")).otherwise(u(0.001, 0.003, "fee")) if asymmetric_fees else u(0.001, 0.005, "fee")
    volatility = u(0.001, 0.01, "vol") if high_volatility else u(0.0001, 0.001, "vol")
    double = 2.0 if illiquid else 1.0
    return nodes, _edges(nodes, fee * double, volatility * double, u(60, 600, "time"))


def random_markets(spark: SparkSession, simulations: int = 100, exchanges: int = 3, coins: int = 2, spread: float = 0.01, fees=(0.001, 0.005), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """All simulations at once, keyed by sim_id; volatility cost follows the price difference."""
    sims = spark.range(simulations).select(F.col("id").cast("int").alias("sim_id"))
    nodes = market_nodes(spark, exchanges, coins, 1.0, spread, seed, sims)
    at = (F.col("sim_id"), F.col("src"), F.col("dst"))
    volatility = F.abs(F.col("src_price") - F.col("dst_price")) * uniform(0.0001, 0.001, seed, F.lit("vol"), *at)
    return nodes, _edges(nodes, uniform(*fees, seed, F.lit("fee"), *at), volatility, uniform(30, 300, seed, F.lit("time"), *at), "sim_id")


def historical_panel(spark: SparkSession, days: int = 30, exchanges=("Kraken", "Coinbase"), coins=COINS, base: float = 1.0, volatility: float = 0.01, start: str = "2024-01-01", seed: int = 0) -> DataFrame:
    """(ts, exchange, coin, price): hourly, prices independent and uniform."""
    hours = spark.range(days * 24).select((F.lit(start).cast("timestamp_ntz") + F.make_interval(hours=F.col("id").cast("int"))).alias("ts"))
    rows = hours.withColumn("exchange", F.explode(F.array(*map(F.lit, exchanges)))).withColumn("coin", F.explode(F.array(*map(F.lit, coins))))
    return rows.withColumn("price", uniform(base * (1 - volatility), base * (1 + volatility), seed, F.col("ts").cast("string"), F.col("exchange"), F.col("coin")))
