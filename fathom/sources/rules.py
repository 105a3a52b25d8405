"""Venue rules as tables: symbols, fees and transfer times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Symbols and their pairs by venue; fee of a transfer between different coins; seconds of a transfer of
# the same coin and between coins.
SYMBOLS = {
    "Kraken": {"USDT": "USDTUSD", "USDC": "USDCUSD", "DAI": "DAIUSD", "BUSD": "BUSDUSD"},
    "Coinbase": {"USDT": "USDT-USD", "USDC": "USDC-USD", "DAI": "DAI-USD"},
}
RULES = [("Kraken", 0.002, 180.0, 60.0), ("Coinbase", 0.005, 120.0, 45.0)]
RULE_SCHEMA = "exchange string, cross_fee double, same_coin_time double, cross_time double"


def venue_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def symbols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v, c, p) for v, pairs in SYMBOLS.items() for c, p in pairs.items()], "exchange string, coin string, pair string")


def transfer_terms(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds fee and transfer_time to (exchange, src_coin, dst_coin, amount)."""
    same = F.col("src_coin") == F.col("dst_coin")
    out = requests.join(rules, "exchange", "left")
    fee = F.when(same, F.lit(0.0)).otherwise(F.col("amount") * F.col("cross_fee"))
    time = F.when(same, F.col("same_coin_time")).otherwise(F.col("cross_time"))
    return out.withColumn("fee", fee).withColumn("transfer_time", time).drop("cross_fee", "same_coin_time", "cross_time")
