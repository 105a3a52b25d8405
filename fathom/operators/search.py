"""Layered path search: one join and one aggregation for each step, all starts and snapshots at once.

Edges need src, dst, weight, src_price, dst_price; nodes node_id, price, exchange, coin. With ``snapshot`` the name of
a column of both, searches stay within a snapshot. Each layer keeps the cheapest path for each (snapshot, start, node),
ties to the smallest path, so a frontier has at most nodes^2 rows for each snapshot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import admissible, cycle_profit

CUT_EVERY = 4


def gate(edges: DataFrame) -> DataFrame:
    """Edges that cycle searches may follow."""
    return edges.where(admissible("src_price", "dst_price", "weight"))


def layers(starts: DataFrame, edges: DataFrame, max_depth: int, keys: list[str], is_end) -> DataFrame:
    """(keys.., start, target, node, cost, path, depth) of paths that end; ``is_end``: a condition on node, start and
    target. Paths that ended go no further."""
    step = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("next"), "weight")
    frontier = starts.select(*keys, "start", "target", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.array("start").alias("path"))
    found = []
    for depth in range(1, max_depth + 1):
        moved = frontier.join(step, [*keys, "node"]).select(*keys, "start", "target", F.col("next").alias("node"), F.struct((F.col("cost") + F.col("weight")).alias("cost"), F.concat("path", F.array("next")).alias("path")).alias("best"))
        best = moved.groupBy(*keys, "start", "target", "node").agg(F.min("best").alias("best")).select(*keys, "start", "target", "node", "best.cost", "best.path")
        if depth % CUT_EVERY == 0 and starts.sparkSession.sparkContext.getCheckpointDir():
            best = best.checkpoint()
        found.append(best.where(is_end).withColumn("depth", F.lit(depth)))
        frontier = best.where(~is_end)
    return reduce(DataFrame.unionByName, found)


def cycles(nodes: DataFrame, edges: DataFrame, max_depth: int = 10, starts: DataFrame | None = None, snapshot: str | None = None) -> DataFrame:
    """The cheapest profitable cycle for each start and depth: start, depth, total_cost, net_profit, path."""
    keys = [snapshot] if snapshot else []
    prices = nodes.select(*keys, F.col("node_id").alias("start"), F.col("price").alias("start_price"))
    first = prices if starts is None else prices.join(starts.select(*keys, "start"), [*keys, "start"], "left_semi")
    ended = layers(first.select(*keys, "start", F.col("start").alias("target")), gate(edges), max_depth, keys, F.col("node") == F.col("target"))
    out = ended.join(prices, [*keys, "start"]).withColumn("net_profit", cycle_profit("start_price", "cost"))
    return out.where("net_profit > 0").select(*keys, "start", "depth", F.col("cost").alias("total_cost"), "net_profit", "path")


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """The cheapest path of 1 to max_depth edges for each (start, target), without the gate; no row if there is none.
    Equal start and target mean the cheapest way back."""
    ended = layers(pairs.select("start", "target"), edges, max_depth, [], F.col("node") == F.col("target"))
    best = ended.groupBy("start", "target").agg(F.min(F.struct("cost", "depth", "path")).alias("best"))
    return best.select("start", "target", F.col("best.cost").alias("total_cost"), F.col("best.path").alias("path"), F.col("best.depth").alias("depth"))


def two_level(found: DataFrame, nodes: DataFrame, snapshot: str | None = None) -> DataFrame:
    """A row for each cycle and each node of another exchange on it, with a description."""
    keys = [snapshot] if snapshot else []
    side = lambda who: nodes.select(*keys, F.col("node_id").alias(who), F.format_string("%s(%s)", "exchange", "coin").alias(f"{who}_label"), F.col("exchange").alias(f"{who}_exchange"))
    rows = found.withColumn("target", F.explode(F.array_distinct("path")))
    rows = rows.join(side("start"), [*keys, "start"]).join(side("target"), [*keys, "target"]).where("start_exchange <> target_exchange")
    return rows.withColumn("description", F.format_string("%s -> %s", "start_label", "target_label")).select(*found.columns, "target", "description")


def compare_pairs(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cycles from the earlier node of each pair that pass the later one: first, second, then the cycle's columns."""
    later = nodes.select(F.col("node_id").alias("second"))
    rows = found.withColumn("second", F.explode(F.array_distinct("path"))).where("second > start")
    return rows.join(later, "second", "left_semi").select(F.col("start").alias("first"), "second", "depth", "total_cost", "net_profit", "path")


def named_paths(found: DataFrame, nodes: DataFrame, name, path: str = "path", out: str = "steps") -> DataFrame:
    """Adds an array with ``name`` (a column of ``nodes``) of each step. Steps are joined one by one, so neither the nodes nor a path
    have to be in one row of another table; steps that are no node are left out."""
    rows = found.withColumn("__row", F.monotonically_increasing_id())
    steps = rows.select("__row", F.posexplode(path).alias("__at", "node_id")).join(nodes.select("node_id", name.alias("__name")), "node_id")
    told = steps.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__at", "__name"))).alias("__steps"))
    empty = F.array().cast(told.select(F.transform("__steps", lambda s: s["__name"]).alias("x")).schema["x"].dataType)
    return rows.join(told, "__row", "left").withColumn(out, F.coalesce(F.transform("__steps", lambda s: s["__name"]), empty)).drop("__row", "__steps")


def path_labels(found: DataFrame, nodes: DataFrame, path: str = "path", out: str = "path_labels") -> DataFrame:
    """Adds the path as 'E1(C1) -> E2(C2) ...'."""
    named = named_paths(found, nodes, F.format_string("%s(%s)", F.col("exchange"), F.col("coin")), path, out)
    return named.withColumn(out, F.array_join(out, " -> "))
