"""The engine's tables, read off the test tables: a market of regions and segments, ticks, transfers, balances, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import edge_weight, volatility_cost
from fathom.operators.build import COLUMNS, COSTS, node_pairs
from fathom.operators.graph import upsert_nodes
from fathom.operators.rolling import volatility_factors

NODES = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", F.col("r_name").alias("exchange"), F.col("c_mktsegment").alias("coin"), F.col("c_acctbal").cast("decimal(18,2)").alias("amount"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.lit(1.0) + (F.sum("amount").cast("double") / F.count("*") - 4500.0) / 100000.0
    rows = customers(spark, sf_dir).groupBy("exchange", "coin").agg(price.alias("price"))
    return upsert_nodes(rows.withColumn("seq", F.struct("exchange", "coin")))


def rebate_fee(src: str = "src", dst: str = "dst"):
    """A fee from -0.003 to 0.007 by node numbers, so that cycles exist."""
    return ((F.col(src) * 7 + F.col(dst) * 13) % 11 - 3) * F.lit(0.001)


def edges(market: DataFrame, key: str | None = None) -> DataFrame:
    return costed(node_pairs(market, key), key)


def costed(pairs: DataFrame, key: str | None = None) -> DataFrame:
    out = pairs.withColumn("fee", rebate_fee()).withColumn("volatility_cost", volatility_cost("src_price", "dst_price"))
    out = out.withColumn("transfer_time", (F.lit(30) + (F.col("src") * 17 + F.col("dst") * 29) % 271).cast("double")).withColumn("weight", edge_weight())
    return out.select(*([key] if key else []), *COLUMNS, *COSTS)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq is (ts, event_id)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.struct("ts", "event_id").alias("seq"), "event_id", F.col("event_type").alias("exchange"), (F.col("user_id") % 5).cast("string").alias("coin"), F.col("value").alias("price"))


def node_factors(spark: SparkSession, sf_dir: str, market: DataFrame) -> DataFrame:
    """exchange, coin, factor: the n-th key of the ticks gives the risk factor of node n."""
    found = volatility_factors(ticks(spark, sf_dir)).select(F.struct("exchange", "coin").alias("seq"), "exchange", "coin", F.col("factor").alias("price"))
    keyed = upsert_nodes(found).select("node_id", F.col("price").alias("factor"))
    return market.join(keyed, "node_id").select("exchange", "coin", "factor")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).withColumnRenamed("price", "actual_time")


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir).groupBy("exchange", "coin").agg((F.sum("amount").cast("double") / 100.0).alias("balance"))
    return rows.join(nodes(spark, sf_dir).select("node_id", "exchange", "coin"), ["exchange", "coin"]).where("node_id % 6 <> 5").select("exchange", "coin", "balance")


def paths(market: DataFrame) -> DataFrame:
    """For each node a round trip over the node 7 places on."""
    a = market.select("node_id", F.struct("exchange", "coin").alias("a"))
    b = market.select(F.pmod(F.col("node_id") - 7, F.lit(NODES)).alias("node_id"), F.struct("exchange", "coin").alias("b"))
    return a.join(b, "node_id").select(F.col("node_id").alias("path_id"), F.array("a", "b", "a").alias("path"))


def offers(market: DataFrame) -> DataFrame:
    return paths(market).withColumn("profit_rate", F.col("path_id") * 0.0004).withColumn("cost_rate", F.lit(0.001))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunity rows from orders: a third of them not executed."""
    o = table(spark, sf_dir, "orders")
    profit, cost = F.col("o_totalprice") / 1000.0, (F.col("o_orderkey") % 7).cast("double")
    actual = F.when(F.col("o_orderstatus") != "O", profit - 150.0)
    step = lambda n: F.struct(F.concat(F.lit("E"), (F.col("o_custkey") % n).cast("string")).alias("exchange"), F.concat(F.lit("C"), (F.col("o_orderkey") % n).cast("string")).alias("coin"))
    return o.select("o_orderkey", F.array(step(3), step(4), step(3)).alias("path"), profit.alias("predicted_profit"), cost.alias("predicted_cost"), actual.alias("actual_profit"), F.col("o_orderpriority").alias("algorithm"), (F.col("o_orderkey") % 100).cast("int").alias("nodes_explored"), (F.col("o_custkey") % 25).cast("int").alias("graph_size"), (F.col("o_orderkey") % 5).cast("int").alias("opportunities_found"), ((F.col("o_orderkey") % 13) * 0.25).alias("search_time"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean prices by event type and user group."""
    e = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("exchange"), (F.col("user_id") % 5).cast("string").alias("coin"), F.col("value").cast("decimal(18,2)").alias("v"))
    return e.groupBy("ts", "exchange", "coin").agg((F.lit(1.0) + (F.sum("v").cast("double") / F.count("*") - 50.0) / 10000.0).alias("price"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw responses of both shapes, some of them errors or unreadable."""
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit(".5")))
    ticker = F.when(F.col("p_partkey") % 7 == 0, '{"error":["EGeneral"],"result":{}}').otherwise(F.concat(F.lit('{"error":[],"result":{"USDTUSD":{"c":["'), text, F.lit('","1"]}}}')))
    rates = F.when(F.col("p_partkey") % 7 == 0, '{"errors":[{"message":"no"}]}').when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"data":{"amount":"'), text, F.lit('"}}'))).otherwise(F.concat(F.lit('{"data":{"rates":{"USD":"'), text, F.lit('"}}}')))
    first = F.col("p_partkey") % 2 == 0
    return p.select(F.when(first, "Kraken").otherwise("Coinbase").alias("exchange"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("coin"), F.lit("USDTUSD").alias("pair"), F.when(first, ticker).otherwise(rates).alias("body"))
