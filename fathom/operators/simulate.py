"""Backtests and Monte Carlo runs: all snapshots and simulations in one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import VOLATILITY_FACTOR
from fathom.operators.build import panel_edges
from fathom.operators.exact import exact_cycles
from fathom.operators.orderstats import order_statistics
from fathom.operators.search import cycles, two_level
from fathom.operators.tables import dense_numbers

RISK = 0.05
LEAST_RUNS = 20


def panel_nodes(panel: DataFrame, snapshot: str, spread: bool = False) -> DataFrame:
    """(snapshot, exchange, coin, price) with ids by (exchange, coin), equal across snapshots."""
    keys = dense_numbers(panel.select("exchange", "coin").distinct(), ["exchange", "coin"], "place", spread)
    ids = keys.select("exchange", "coin", F.col("place").cast("int").alias("node_id"))
    return panel.join(ids, ["exchange", "coin"]).select(snapshot, "node_id", "exchange", "coin", "price")


def opportunities(nodes: DataFrame, edges: DataFrame, algorithm: str = "layered", max_depth: int = 5, factor: float = VOLATILITY_FACTOR, snapshot: str | None = None) -> DataFrame:
    """All starts, two-level: layered for 'layered', else in the exact order of a best-first algorithm."""
    found = cycles(nodes, edges, max_depth, snapshot=snapshot) if algorithm == "layered" else exact_cycles(nodes, edges, algorithm, max_depth, factor, snapshot=snapshot)
    return two_level(found, nodes, snapshot)


def snapshot_statistics(nodes: DataFrame, edges: DataFrame, snapshot: str = "ts") -> DataFrame:
    """snapshot, num_nodes, num_edges, num_exchanges, num_coins, avg_price."""
    n = nodes.groupBy(snapshot).agg(F.count("*").alias("num_nodes"), F.count_distinct("exchange").alias("num_exchanges"), F.count_distinct("coin").alias("num_coins"), F.avg("price").alias("avg_price"))
    e = edges.groupBy(snapshot).agg(F.count("*").alias("num_edges"))
    return n.join(e, snapshot, "left").select(snapshot, "num_nodes", F.coalesce("num_edges", F.lit(0)).cast("long").alias("num_edges"), "num_exchanges", "num_coins", "avg_price")


def run_backtest(panel: DataFrame, snapshot: str = "ts", max_depth: int = 5, edges: DataFrame | None = None, algorithm: str = "layered", factor: float = VOLATILITY_FACTOR) -> DataFrame:
    """snapshot, num_opportunities, total_profit, num_nodes: every snapshot has a row, in their order. Opportunities are those of the
    two-level search. ``edges``: the snapshots' edges, if they are not the standard ones."""
    nodes = panel_nodes(panel, snapshot)
    found = opportunities(nodes, panel_edges(nodes, snapshot) if edges is None else edges, algorithm, max_depth, factor, snapshot)
    rows = found.groupBy(snapshot).agg(F.count("*").alias("num_opportunities"), F.sum("net_profit").alias("total_profit"))
    every = nodes.groupBy(snapshot).agg(F.count("*").alias("num_nodes"))
    return every.join(rows, snapshot, "left").select(snapshot, F.coalesce("num_opportunities", F.lit(0)).cast("long").alias("num_opportunities"), F.coalesce("total_profit", F.lit(0.0)).alias("total_profit"), "num_nodes").orderBy(snapshot)


def backtest_metrics(result: DataFrame) -> DataFrame:
    """One row, none without snapshots; empty snapshots count in the averages."""
    n, total = F.count("*"), F.sum("num_opportunities")
    out = result.agg(n.alias("timestamps"), F.count_if(F.col("num_opportunities") > 0).alias("timestamps_with_opportunities"), total.alias("total_opportunities"), F.sum("total_profit").alias("total_profit"))
    out = out.where("timestamps > 0")
    return out.withColumn("avg_opportunities", F.col("total_opportunities") / F.col("timestamps")).withColumn("avg_profit", F.when(F.col("total_opportunities") > 0, F.col("total_profit") / F.col("total_opportunities")).otherwise(0.0))


def per_simulation(simulations: DataFrame, found: DataFrame, key: str = "sim_id") -> DataFrame:
    """``simulations``: one row for each; ``found``: (key, net_profit). Simulations without an opportunity remain."""
    rows = found.groupBy(key).agg(F.count("*").alias("num_opportunities"), F.sum("net_profit").alias("total_profit"))
    out = simulations.select(key).join(rows, key, "left")
    n, total = F.coalesce("num_opportunities", F.lit(0)).cast("long"), F.coalesce("total_profit", F.lit(0.0))
    return out.select(key, n.alias("num_opportunities"), total.alias("total_profit"), F.when(n > 0, total / n).otherwise(0.0).alias("avg_profit"), (n > 0).alias("has_opportunities"))


def statistics(result: DataFrame) -> DataFrame:
    """One row over all simulations. Value at risk: the profit at place int(0.05 n) of the sorted ones, 0 unless n > 20;
    expected shortfall: the mean of the int(0.05 n) lowest, 0 if there are none. Both come from order statistics and sums
    over all rows: the lowest are those below the last of them, and as many equal to it as are left."""
    totals = result.agg(
        F.count("*").alias("simulations"),
        F.avg(F.col("has_opportunities").cast("double")).alias("success_rate"),
        F.avg("total_profit").alias("avg_profit"),
        F.avg("num_opportunities").alias("avg_opportunities"),
        F.sum("total_profit").alias("total_profit"),
        F.max("total_profit").alias("max_profit"),
        F.min("total_profit").alias("min_profit"),
    ).where("simulations > 0")
    tail = F.floor(F.col("n") * RISK)
    size = result.agg(F.count("total_profit").alias("n")).where("n > 0").select("n", tail.alias("tail"))
    places = size.select(F.explode(F.array_distinct(F.array("tail", F.greatest(F.col("tail") - 1, F.lit(0))))).alias("place"))
    values = order_statistics(result, "total_profit", places)
    edge = values.join(F.broadcast(size), F.lit(True)).agg(
        F.first("n").alias("n"),
        F.first("tail").alias("tail"),
        F.max(F.when(F.col("place") == F.col("tail"), F.col("value"))).alias("var_5"),
        F.max(F.when(F.col("place") == F.col("tail") - 1, F.col("value"))).alias("last"),
    )
    below = result.join(F.broadcast(edge.select("last")), F.col("total_profit") < F.col("last")).agg(F.coalesce(F.sum("total_profit"), F.lit(0.0)).alias("below"), F.count("*").alias("fewer"))
    risk = F.when(F.col("n") > LEAST_RUNS, F.col("var_5")).otherwise(0.0)
    shortfall = F.when(F.col("tail") > 0, (F.col("below") + F.col("last") * (F.col("tail") - F.col("fewer"))) / F.col("tail")).otherwise(0.0)
    edges = edge.join(F.broadcast(below), F.lit(True)).select(risk.alias("var_5"), shortfall.alias("expected_shortfall"))
    return totals.join(F.broadcast(edges), F.lit(True))
