"""Metric logs and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import ratio
from fathom.operators.orderstats import median


def opportunity_log(rows: DataFrame) -> DataFrame:
    """``rows``: path array<struct<exchange, coin>> and the other fields. Joins names and adds path_length and roi, the
    ratio of profit to cost (0 unless the cost is positive)."""
    join = lambda part: F.array_join(F.transform("path", lambda s: s[part]), " -> ")
    out = rows.withColumn("path_length", F.size("path")).withColumn("exchanges", join("exchange")).withColumn("coins", join("coin"))
    return out.withColumn("roi", ratio("predicted_profit", "predicted_cost")).drop("path")


def algorithm_log(rows: DataFrame) -> DataFrame:
    return rows.withColumn("exploration_rate", ratio("nodes_explored", "graph_size"))


def market_log(rows: DataFrame) -> DataFrame:
    spread = F.col("spread") if "spread" in rows.columns else F.lit(None).cast("double")
    return rows.select("timestamp", "exchange", "coin", "price", "volatility", spread.alias("spread"))


def summary(log: DataFrame, extremes: bool = False) -> DataFrame:
    """One row, or none for an empty log: counts, sums, means, median roi; figures of rows with an actual profit are
    null without such rows. ``extremes``: highest and lowest roi, too. The median is found by refining histograms, so no task
    has all values."""
    hit = F.when(F.col("actual_profit").isNotNull(), (F.col("actual_profit") > 0).cast("double"))
    more = [F.max("roi").alias("max_roi"), F.min("roi").alias("min_roi")] if extremes else []
    out = log.agg(
        F.count("*").alias("total_opportunities"),
        F.sum("predicted_profit").alias("total_predicted_profit"),
        F.avg("predicted_profit").alias("avg_predicted_profit"),
        F.avg("roi").alias("avg_roi"),
        F.sum("actual_profit").alias("total_actual_profit"),
        F.avg("actual_profit").alias("avg_actual_profit"),
        F.avg(hit).alias("success_rate"),
        *more,
    )
    out = out.where("total_opportunities > 0").join(F.broadcast(median(log, "roi", "median_roi")), F.lit(True))
    names = ["total_opportunities", "total_predicted_profit", "avg_predicted_profit", "avg_roi", "median_roi", "total_actual_profit", "avg_actual_profit", "success_rate"]
    return out.select(*names, *(["max_roi", "min_roi"] if extremes else []))


def algorithm_averages(log: DataFrame) -> DataFrame:
    return log.groupBy("algorithm").agg(F.count("*").alias("runs"), F.avg("opportunities_found").alias("avg_opportunities"), F.avg("search_time").alias("avg_time"), F.avg("exploration_rate").alias("avg_exploration"))
