"""Command line: python -m fathom.cli --synthetic | --live [--sparse] [--algorithm A] [--depth N] [--out DIR]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import VOLATILITY_FACTOR, ratio
from fathom.operators import build, exact, graph, metrics, rolling, search
from fathom.operators.simulate import opportunities
from fathom.operators.tables import stored
from fathom.sources import files, generate, quotes, rules

SEED = 42
TOP = 5


def volatility_of(spark: SparkSession, nodes: DataFrame, history: str | None) -> tuple[DataFrame, DataFrame]:
    """(nodes with their volatility, factors of exchange and coin). ``history``: a folder of ticks to which this run's prices are added, so
    that each run sees the last prices of the runs before; without it every node has the default."""
    now = nodes.select(F.unix_micros(F.current_timestamp()).alias("seq"), "exchange", "coin", "price")
    if not history:
        return nodes.withColumn("volatility", F.lit(rolling.DEFAULT_VOLATILITY)), nodes.select("exchange", "coin", F.lit(VOLATILITY_FACTOR).alias("factor"))
    now.write.mode("append").parquet(history)
    found = stored(rolling.volatility_factors(spark.read.schema("seq long, exchange string, coin string, price double").parquet(history)), "volatility")
    return nodes.join(found.select("exchange", "coin", "volatility"), ["exchange", "coin"], "left").select(*nodes.columns, "volatility"), found.select("exchange", "coin", "factor")


def report(nodes: DataFrame, edges: DataFrame, algorithm: str, depth: int) -> DataFrame:
    rows = opportunities(nodes, edges, algorithm, depth).withColumn("roi_percent", ratio("net_profit", "total_cost") * 100)
    return rows.orderBy(F.desc("net_profit"), "description", "path").limit(TOP)


def synthetic(spark: SparkSession, exchanges: int = 4, coins: int = 3, algorithm: str = "astar", depth: int = 5) -> DataFrame:
    return report(*generate.synthetic_market(spark, exchanges, coins, seed=SEED), algorithm, depth)


def live_market(spark: SparkSession, sparse: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from the venues' quotes; nodes are few and kept, so that venues are asked once."""
    spark.dataSource.register(quotes.QuoteSource)
    rows = quotes.parse_quotes(spark.read.format("venue_quotes").load()).collect()
    if not rows:
        raise RuntimeError("no venue gave a price")
    listed = spark.createDataFrame(rows, "exchange string, coin string, price double").withColumn("seq", F.struct("exchange", "coin"))
    nodes = graph.upsert_nodes(listed)
    own = rules.venue_rules(spark)
    return nodes, build.sparse_market(nodes, listings=nodes.select("exchange", "coin"), rules=own) if sparse else build.dense_edges(nodes, own)


def save(nodes: DataFrame, found: DataFrame, algorithm: str, out: str) -> list[str]:
    steps = search.named_paths(found, nodes, F.struct("exchange", "coin")).drop("path").withColumnRenamed("steps", "path")
    log = metrics.opportunity_log(steps.select(F.current_timestamp().alias("timestamp"), "path", F.col("net_profit").alias("predicted_profit"), F.col("total_cost").alias("predicted_cost"), F.lit(None).cast("double").alias("actual_profit"), F.lit(algorithm).alias("algorithm")))
    market = metrics.market_log(nodes.select(F.current_timestamp().alias("timestamp"), "exchange", "coin", "price", (F.col("volatility") if "volatility" in nodes.columns else F.lit(None).cast("double")).alias("volatility")))
    runs = log.groupBy("algorithm").agg(F.count("*").alias("opportunities_found"))
    return files.write_sheets(found.sparkSession, out, log, metrics.summary(log, extremes=True), runs, market)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    for flag in ("synthetic", "live", "sparse", "no-metrics"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--algorithm", choices=[*exact.ALGORITHMS, "layered"], default="astar")
    p.add_argument("--depth", type=int, default=5)
    p.add_argument("--exchanges", type=int, default=4)
    p.add_argument("--coins", type=int, default=3)
    p.add_argument("--out", default="market-report")
    p.add_argument("--history", help="folder of earlier prices, for the volatility of a live market")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("fathom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.live or not a.synthetic:
        try:
            nodes, edges = live_market(spark, a.sparse)
            nodes, factors = volatility_of(spark, nodes, a.history)
            edges = exact.edge_factors(edges, factors)
            report(nodes, edges, a.algorithm, a.depth).show(truncate=False)
            if not a.no_metrics:
                print("written:", save(nodes, opportunities(nodes, edges, a.algorithm, a.depth), a.algorithm, a.out))
        except Exception as e:  # without venues the synthetic market is shown instead
            print(f"live market failed ({e}); synthetic market:")
            synthetic(spark).show(truncate=False)
    if a.synthetic or not a.live:
        synthetic(spark, a.exchanges, a.coins, a.algorithm, a.depth).show(truncate=False)


if __name__ == "__main__":
    main()
