"""Sharded vector search: what both searches (3, 7) share.

Rows are dealt by a hash into shards of about ``shard_size`` vectors, each shard gets one index, written once to the
shared folder. An index moves once, to the task of its shard; queries go to every shard and stream through that task in
Arrow batches, behind the index, so a task holds one index and one batch, whatever the table's size. The k best of each
shard are merged by a window over shards x k rows for each query.
Vectors of different lengths never meet. Each row is a vector of its own, repeated ids included.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import materialise

HITS = "query_id long, vec_id long, score {score}"


def usable(df: DataFrame, zero_ok: bool) -> DataFrame:
    """(vec_id long, v array<double>, dim int) of vectors without null or non-finite components."""
    v = F.col("v")
    out = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    out = out.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite)
    if not zero_ok:
        out = out.where(F.exists("v", lambda x: x != 0))
    return out.withColumn("dim", F.size("v"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def to_blob(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def from_blob(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def sharded_search(vectors: DataFrame, is_query, build, search, k: int, descending: bool, score: str, shard_size: int) -> DataFrame:
    """``vectors``: from usable(). ``build(ids, matrix)`` gives the arrays of an index, ``search(arrays, query_ids,
    queries, k)`` gives lists of query_id, vec_id and score. Result: query_id, rank, vec_id, score."""
    shards = max(1, math.ceil(vectors.count() / shard_size))

    def build_one(part: pa.Table) -> pa.Table:
        dim = part.column("dim")[0].as_py()
        arrays = build(part.column("vec_id").to_numpy(), matrix(part.column("v"), dim))
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([part.column("shard")[0].as_py()], pa.int32()), "index": pa.array([to_blob(arrays)], pa.binary())})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(shards)).cast("int"))
    index = materialise(dealt.groupBy("dim", "shard").applyInArrow(build_one, "dim int, shard int, index binary"), "vector-index")
    queries = vectors.where(is_query).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    kind = pa.int64() if score == "long" else pa.float64()

    def search_all(parts):
        arrays, at = {}, None
        for part in parts:
            dims, numbers, blobs = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3)
            cuts = np.flatnonzero(np.concatenate(([True], (dims[1:] != dims[:-1]) | (numbers[1:] != numbers[:-1]), [True]))) if len(dims) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if blobs[a].is_valid:  # the shard's first row
                    arrays, at = from_blob(blobs[a].as_py()), (dims[a], numbers[a])
                    a += 1
                if a < b and at == (dims[b - 1], numbers[b - 1]):
                    out = search(arrays, part.column(2)[a:b].to_numpy(), matrix(part.column(4)[a:b], dims[b - 1]), k)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind)], names=["query_id", "vec_id", "score"])

    rows = index.selectExpr("dim", "shard", "CAST(NULL AS long) AS vec_id", "index", "CAST(NULL AS array<double>) AS v")
    rows = rows.unionByName(queries.selectExpr("dim", "shard", "vec_id", "CAST(NULL AS binary) AS index", "v"))
    rows = rows.repartition("dim", "shard").sortWithinPartitions("dim", "shard", F.col("index").isNull())
    hits = rows.mapInArrow(search_all, HITS.format(score=score))
    best = F.col("score").desc() if descending else F.col("score").asc()
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(best, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
