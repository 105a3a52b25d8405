"""Evaluation of given paths against a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import label

SHORT = "Path too short"


def evaluate_paths(paths: DataFrame, nodes: DataFrame, edges: DataFrame, amount: float = 1.0) -> DataFrame:
    """``paths``: path_id, path (node ids). Price difference (start - end), cost of the edges (the first of parallel
    edges counts, a missing edge costs nothing), net profit, return in percent of the amount at the start price."""
    long = paths.where(F.size("path") >= 2)
    seq = F.col("edge_seq") if "edge_seq" in edges.columns else F.lit(0)
    first = edges.groupBy("src", "dst").agg(F.min_by("weight", seq).alias("weight"))
    ids = F.sequence(F.lit(0), F.size("path") - 2)
    hops = long.select("path_id", F.explode(F.transform(ids, lambda i: F.struct(i.alias("hop"), F.col("path")[i].alias("src"), F.col("path")[i + 1].alias("dst")))).alias("h")).select("path_id", "h.*")
    cost = hops.join(first, ["src", "dst"], "left").groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("hop", (F.coalesce("weight", F.lit(0.0)) * amount).alias("w")))).alias("ws"))
    cost = cost.select("path_id", F.aggregate("ws", F.lit(0.0), lambda s, x: s + x["w"]).alias("total_cost"))
    price = lambda name, at: nodes.select(F.col("node_id").alias(at), F.col("price").alias(name))
    ends = long.select("path_id", F.element_at("path", 1).alias("a"), F.element_at("path", -1).alias("b")).join(price("start_price", "a"), "a").join(price("end_price", "b"), "b")
    out = ends.join(cost, "path_id").withColumn("price_difference", (F.col("start_price") - F.col("end_price")) * amount)
    out = out.withColumn("net_profit", F.col("price_difference") - F.col("total_cost"))
    base = F.col("start_price") * amount
    out = out.select("path_id", "price_difference", "total_cost", "net_profit", F.when(base > 0, F.col("net_profit") / base * 100).otherwise(0.0).alias("roi"), (F.col("net_profit") > 0).alias("profitable"), F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("double")
    short = paths.where(F.size("path") < 2).select("path_id", none.alias("price_difference"), none.alias("total_cost"), none.alias("net_profit"), none.alias("roi"), F.lit(None).cast("boolean").alias("profitable"), F.lit(SHORT).alias("error"))
    return out.unionByName(short)


def opportunity_records(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """start_node, end_node, path_length, net_profit, total_cost, profit_margin (profit over the start price)."""
    side = lambda at, name: nodes.select(F.col("node_id").alias(at), label("exchange", "coin").alias(name), F.col("price").alias(f"{name}_price"))
    rows = found.where(F.size("path") > 0).withColumn("a", F.element_at("path", 1)).withColumn("b", F.element_at("path", -1))
    rows = rows.join(side("a", "start_node"), "a").join(side("b", "end_node"), "b")
    margin = F.when(F.col("start_node_price") > 0, F.col("net_profit") / F.col("start_node_price")).otherwise(0.0)
    return rows.select("start_node", "end_node", F.size("path").alias("path_length"), "net_profit", "total_cost", margin.alias("profit_margin"))
