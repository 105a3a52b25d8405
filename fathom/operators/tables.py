"""Written intermediate tables, and ranks by ranges: no row number ever needs all rows, or all rows of a key, in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IN_TASK = 33  # bits of monotonically_increasing_id() that count rows within a task


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below spark.checkpoint.dir and read back: what several branches read is worked out once, and a lost
    executor costs its own tasks. Where the setting is unset, a session of one JVM gets a folder of its own; a cluster
    needs the setting."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="fathom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, keys: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """Adds the number, from 0, of rows of the same ``keys`` that come before in ``order``. Rows are dealt by ranges of keys and order, so
    that a key of any size is many tasks, and written with their place in their range; a range's rows of a key are offset by
    the ranges before it, of which there are as many as shuffle partitions. Ties have different, arbitrary ranks."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    by = [*keys, *order]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    dealt = stored(dealt, "ranges").withColumn("__part", F.shiftright("__at", IN_TASK))
    sizes = dealt.groupBy("__part", *keys).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    if keys:
        before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first"))
    else:  # a row for each range
        found, bases, total = sorted(map(tuple, sizes.collect())), [], 0
        for part, n, first in found:
            bases.append((part, total - first))
            total += n
        sizes = F.broadcast(spark.createDataFrame(bases, "__part long, __base long"))
    same = [F.col("a.__part") == F.col("b.__part"), *[F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]]
    joined = dealt.alias("a").join(sizes.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("a.__at") + F.col("b.__base")).alias(rank))


def dense_numbers(rows: DataFrame, order: list[str], name: str, spread: bool = False) -> DataFrame:
    """Adds numbers from 0 in ``order``. ``spread``: by ranges, else in one ordered pass, which is quicker for sets that fit a task,
    as the nodes of a graph do whose complete edges are their square."""
    if spread:
        return ranked(rows, [], order, name)
    return rows.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
