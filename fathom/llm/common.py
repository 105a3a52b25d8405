"""Shared plumbing of the training-data operators: work folders, partition counts, safe columns."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``. Where that is unset, a session of one JVM gets a folder of its
    own; on a cluster no folder of this machine would do, so it is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="fathom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: While intermediate tables are written: a query's shuffle files go when it ends, and Arrow batches are bounded by bytes.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there, and a
    lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    with settings(spark, WRITING):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fathom_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_fathom_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Adds ``rank`` by ``order``, whose values differ: ranges of it are sorted and written, then offset by what stands in
    the ranges before, of which there are as many as shuffle partitions."""
    spark = rows.sparkSession
    ranges = rows.repartitionByRange(shuffle_partitions(spark), order).withColumn("part", F.spark_partition_id())
    ranges = materialise(ranges, "numbered")
    sizes = sorted(map(tuple, ranges.groupBy("part").count().collect()))
    starts = [(p, sum(n for _, n in sizes[:k])) for k, (p, _) in enumerate(sizes)]
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranges.withColumn("place", place).join(offsets, "part").withColumn("rank", F.col("place") + F.col("start")).drop("part", "place", "start")


def give_back() -> None:
    """At a Python task's end: what Arrow and malloc() keep for later goes back to the system, as an idle worker may
    stay beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is a malloc_trim()
        ctypes.CDLL(None).malloc_trim(0)


def slices(column: pa.Array, chars: int):
    """(a, b, texts): runs of rows of at most ``chars`` bytes of text, or one row; null is empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + chars, side="right")))
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]
        a = b


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(df: DataFrame, text: str = "text"):
    """The text, null taken as empty."""
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
