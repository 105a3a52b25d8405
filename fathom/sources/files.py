"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import DataFrame, SparkSession

NOTE = "No opportunities recorded"
# Layouts of the benchmark tables.
LAYOUTS = {
    "graph_construction": "nodes int, edges_dense int, edges_sparse int, dense_time_s double, sparse_time_s double, speedup double, memory_dense_mb double, memory_sparse_mb double, memory_reduction double",
    "search": "nodes int, standard_astar_ms double, weighted_astar_ms double, speedup double, nodes_explored_std double, nodes_explored_wa double, exploration_reduction double, optimality_gap_pct double",
    "volatility": "market_condition string, volatility_pct double, static_fpr_pct double, dynamic_fpr_pct double, improvement_pct double, correlation_static double, correlation_dynamic double, mae_static double, mae_dynamic double",
    "transfer_time": "method string, mean_error_s double, percentile_coverage_pct double, opportunities_found int, successfully_executed int, survival_rate_pct double",
}


def read_csv(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(LAYOUTS.get(layout, layout)).csv(path) if layout else reader.option("inferSchema", True).csv(path)


def write_csv(log: DataFrame, path: str) -> bool:
    """Write a log with a header; nothing for an empty one."""
    if not log.take(1):
        return False
    log.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_sheets(spark: SparkSession, path: str, opportunities: DataFrame, summary: DataFrame, algorithms: DataFrame, markets: DataFrame) -> list[str]:
    """The report's tables, a folder each below ``path``: empty logs are left out, with notes as the workbook has
    them. Gives the names written."""
    filled = {n: df for n, df in (("Opportunities", opportunities), ("Algorithm Performance", algorithms), ("Market Conditions", markets)) if df.take(1)}
    note = spark.createDataFrame([(NOTE,)], "note string")
    if not filled:
        filled["Info"] = note
    else:
        filled["Summary"] = summary if "Opportunities" in filled else note
    for name, df in filled.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{name.replace(' ', '_')}")
    return sorted(filled)


def chart_points(rows: DataFrame, x: str, *series: str) -> DataFrame:
    """(x, series, value): what a chart of several series draws, a row for each point; null values are left out."""
    return rows.select(F.col(x).cast("string").alias("x"), *[F.col(s).cast("double") for s in series]).unpivot("x", list(series), "series", "value").where("value IS NOT NULL")


def write_workbook(path: str, sheets: dict[str, DataFrame], most_rows: int = 1_000_000) -> None:
    """One spreadsheet file, where openpyxl is installed; for reports of a bounded size only."""
    import openpyxl

    book = openpyxl.Workbook()
    book.remove(book.active)
    for name, df in sheets.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows; use write_sheets()")
        sheet = book.create_sheet(name)
        sheet.append(df.columns)
        for r in rows:
            sheet.append(list(r))
    book.save(path)
