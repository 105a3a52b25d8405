"""Nodes and edges as tables: upserts, checked inserts, price updates, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import edge_weight
from fathom.operators.tables import dense_numbers

KEY = ["exchange", "coin"]


def upsert_nodes(rows: DataFrame, spread: bool = False) -> DataFrame:
    """From (seq, exchange, coin, price): one node for each key, at the place of its first row, with the price of its
    last. Gives node_id (dense, from 0), exchange, coin, price. ``spread``: numbers by ranges, for very many nodes."""
    merged = rows.groupBy(*KEY).agg(F.max_by("price", "seq").alias("price"), F.min("seq").alias("first_seq"))
    return dense_numbers(merged, ["first_seq", *KEY], "place", spread).select(F.col("place").cast("int").alias("node_id"), *KEY, "price")


def find_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes of the keys (exchange, coin) in ``wanted``; no row for unknown ones."""
    return nodes.join(wanted.select(*KEY).distinct(), KEY, "left_semi")


def foreign_key_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an endpoint that is no node."""
    source = nodes.select(F.col("exchange").alias("src_exchange"), F.col("coin").alias("src_coin"))
    target = nodes.select(F.col("exchange").alias("dst_exchange"), F.col("coin").alias("dst_coin"))
    no_source = edges.join(source, ["src_exchange", "src_coin"], "left_anti")
    no_target = edges.join(source, ["src_exchange", "src_coin"], "left_semi").join(target, ["dst_exchange", "dst_coin"], "left_anti")
    return no_source.select(*edges.columns).unionByName(no_target.select(*edges.columns))


def insert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` and ``new``; raises ValueError where a new edge misses a node."""
    bad = foreign_key_violations(new, nodes).take(1)
    if bad:
        raise ValueError(f"edge without node: {bad[0].asDict()}")
    return edges.unionByName(new)


def update_prices(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """New prices by key; the last of repeated keys (by seq) wins, unknown keys are ignored, edges are not touched."""
    last = updates.groupBy(*KEY).agg(F.max_by("price", "seq").alias("new_price"))
    return nodes.join(last, KEY, "left").withColumn("price", F.coalesce("new_price", "price")).select(*nodes.columns)


def update_volatility_cost(edges: DataFrame, condition, cost) -> DataFrame:
    """Set the volatility cost of edges that meet a condition, and their weight."""
    cost = F.when(condition, F.lit(cost)).otherwise(F.col("volatility_cost"))
    return edges.withColumn("volatility_cost", cost).withColumn("weight", edge_weight()).select(*edges.columns)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of nodes, edges, exchanges and coins, their sorted lists, and the mean price (0 if none)."""
    n = nodes.agg(
        F.count("*").alias("num_nodes"),
        F.count_distinct("exchange").alias("num_exchanges"),
        F.count_distinct("coin").alias("num_coins"),
        F.array_join(F.array_sort(F.collect_set("exchange")), ",").alias("exchanges"),
        F.array_join(F.array_sort(F.collect_set("coin")), ",").alias("coins"),
        F.round(F.coalesce(F.avg("price"), F.lit(0.0)), 9).alias("avg_price"),
    )
    e = edges.agg(F.count("*").alias("num_edges"))
    return n.join(F.broadcast(e), F.lit(True)).select("num_nodes", "num_edges", "num_exchanges", "num_coins", "exchanges", "coins", "avg_price")
