"""Whole runs: Monte Carlo and stress tests, comparison of algorithms, experiments and demonstrations."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import VOLATILITY_FACTOR
from fathom.operators import build, exact, search, simulate, wallet
from fathom.sources import generate

# Seed, volumes and risk factor of the published runs.
SEED = 42
ADVERSE_FACTOR = 0.2
VOLUMES = (500.0, 1_000.0, 5_000.0, 10_000.0, 50_000.0, 100_000.0, 200_000.0)


def monte_carlo(spark: SparkSession, simulations: int = 100, exchanges: int = 3, coins: int = 2, spread: float = 0.01, fees=(0.001, 0.005), algorithm: str = "astar", max_depth: int = 5, factor: float = VOLATILITY_FACTOR, seed: int = 0) -> DataFrame:
    """A row for each simulated market, all searched at once: sim_id, num_opportunities, total_profit, avg_profit,
    has_opportunities, graph_size."""
    nodes, edges = generate.random_markets(spark, simulations, exchanges, coins, spread, fees, seed)
    found = simulate.opportunities(nodes, edges, algorithm, max_depth, factor, "sim_id")
    every = spark.range(simulations).select(F.col("id").cast("int").alias("sim_id"))
    size = nodes.groupBy("sim_id").agg(F.count("*").alias("graph_size"))
    out = simulate.per_simulation(every, found).join(size, "sim_id", "left")
    return out.withColumn("graph_size", F.coalesce("graph_size", F.lit(0)).cast("long"))


def stress_test(spark: SparkSession, simulations: int = 50, high_volatility: bool = True, asymmetric_fees: bool = True, algorithm: str = "astar") -> DataFrame:
    """Statistics over adverse markets of 4 exchanges and 3 coins."""
    fees = (0.001, 0.01) if asymmetric_fees else (0.001, 0.005)
    return simulate.statistics(monte_carlo(spark, simulations, 4, 3, 0.05 if high_volatility else 0.01, fees, algorithm, seed=SEED))


def compare_algorithms(spark: SparkSession, exchanges: int = 4, coins: int = 3, max_depth: int = 5, runs: int = 5, algorithms=("dijkstra", "astar"), markets=generate.synthetic_market) -> DataFrame:
    """run, method, opportunities, profit, seconds: for each seed from SEED on, each algorithm from the first node and
    two-level from all nodes. ``markets``: (spark, exchanges, coins, seed=) -> nodes, edges."""
    rows = []
    for run in range(runs):
        nodes, edges = markets(spark, exchanges, coins, seed=SEED + run)
        for algorithm in algorithms:
            one = lambda a=algorithm: exact.exact_cycles(nodes, edges, a, max_depth, starts=[0])  # noqa: B023, E731
            every = lambda a=algorithm: simulate.opportunities(nodes, edges, a, max_depth)  # noqa: B023, E731
            for method, find in ((algorithm, one), (f"two_level_{algorithm}", every)):
                began = time.perf_counter()
                r = find().agg(F.count("*").alias("n"), F.coalesce(F.sum("net_profit"), F.lit(0.0)).alias("profit")).first()
                rows.append((run, method, r.n, r.profit, time.perf_counter() - began))
    return spark.createDataFrame(rows, "run int, method string, opportunities long, profit double, seconds double")


def comparison_summary(compared: DataFrame) -> DataFrame:
    mean = lambda c: F.avg(c).alias(f"avg_{c}")
    return compared.groupBy("method").agg(mean("opportunities"), mean("seconds"), mean("profit"))


def basic_experiment(spark: SparkSession, exchanges: int = 4, coins: int = 3, max_depth: int = 5, markets=generate.synthetic_market) -> DataFrame:
    """search, place, description, net_profit, total_cost, path_length: the best 3 cycles from the first node by dijkstra
    and astar, and the best 5 two-level ones."""
    nodes, edges = markets(spark, exchanges, coins, seed=SEED)

    def best(name: str, rows: DataFrame, text, k: int) -> DataFrame:
        top = rows.withColumn("description", text).orderBy(F.desc("net_profit"), "description", "path").limit(k)
        place = F.array(*[F.col(c) for c in ("net_profit", "total_cost")])
        told = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("net_profit")).alias("low"), "description", "path", place.alias("money")))).alias("all"))
        told = told.select(F.posexplode("all").alias("k", "r"))
        return told.select(F.lit(name).alias("search"), (F.col("k") + 1).alias("place"), "r.description", F.col("r.money")[0].alias("net_profit"), F.col("r.money")[1].alias("total_cost"), F.size("r.path").alias("path_length"))

    parts = []
    for algorithm in ("dijkstra", "astar"):
        found = exact.exact_cycles(nodes, edges, algorithm, max_depth, starts=[0])
        parts.append(best(algorithm, search.path_labels(found, nodes), F.col("path_labels"), 3))
    parts.append(best("two_level_astar", simulate.opportunities(nodes, edges, "astar", max_depth), F.col("description"), 5))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def adversarial_experiment(spark: SparkSession, exchanges: int = 4, coins: int = 3, max_depth: int = 5, factor: float = ADVERSE_FACTOR, top: int = 3, markets=generate.adversarial_market) -> DataFrame:
    """The best two-level opportunities of an adverse market by astar, with a higher price risk factor."""
    nodes, edges = markets(spark, exchanges, coins, seed=SEED)
    return simulate.opportunities(nodes, edges, "astar", max_depth, factor).orderBy(F.desc("net_profit"), "description", "path", "target").limit(top)


def fiat_market(nodes: DataFrame, supported: DataFrame | None = None, **costs) -> tuple[DataFrame, DataFrame]:
    """Nodes with fiat money, and their edges."""
    every = build.fiat_nodes(nodes, supported)
    return every, build.fiat_edges(every, **costs)


def fiat_demo(nodes: DataFrame, supported: DataFrame | None = None, algorithm: str = "layered", max_depth: int = 5) -> DataFrame:
    """with_fiat, num_nodes, num_edges, num_opportunities: the market without and with fiat nodes."""

    def counted(with_fiat: bool, n: DataFrame, e: DataFrame) -> DataFrame:
        count = lambda df, c: F.broadcast(df.agg(F.count("*").alias(c)))
        found = simulate.opportunities(n, e, algorithm, max_depth)
        out = n.agg(F.count("*").alias("num_nodes")).withColumn("with_fiat", F.lit(with_fiat))
        return out.join(count(e, "num_edges"), F.lit(True)).join(count(found, "num_opportunities"), F.lit(True)).select("with_fiat", "num_nodes", "num_edges", "num_opportunities")

    return counted(False, nodes, build.dense_edges(nodes)).unionByName(counted(True, *fiat_market(nodes, supported)))


def fee_savings(spark: SparkSession, exchange: str = "Kraken", volumes=VOLUMES, tiers: DataFrame | None = None) -> DataFrame:
    """exchange, volume, rate, fee, and how much less than the first volume's the fee is."""
    first = float(volumes[0])
    asked = spark.createDataFrame([(exchange, float(v)) for v in volumes], "exchange string, volume double")
    paid = wallet.effective_rates(asked, tiers).withColumn("fee", F.col("volume") * F.col("rate"))
    base = F.broadcast(paid.where(F.col("volume") == first).select(F.col("fee").alias("base")).limit(1))
    return paid.join(base, F.lit(True)).withColumn("savings", F.col("base") - F.col("fee")).drop("base")
