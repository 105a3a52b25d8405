"""Centroid clustering (12): Lloyd's rounds over whole numbers, with Drake's adaptive bounds.

Every vector keeps its centroid, an upper bound of the distance to it, lower bounds of the distances to the next few
centroids in their order, and one lower bound for all the rest. When centroids move, the bounds move by as much. A
vector whose upper bound stays below all lower bounds keeps its centroid without a distance; else the distance to its own
centroid is worked out, then those to as many of the next centroids as it takes until the first bound that stays above,
and only where even the rest's bound can't certify the order, those to all. Bounds are rounded outwards and must differ
strictly, distances are whole numbers, so ties (to the smaller number) and results are those of plain rounds. The
number of single bounds starts at half of the centroids and shrinks to what the round before made use of, as one bound
for the rest costs less.

A round reads the table of vectors with their bounds and writes the next one: no shuffle, no group, one Arrow batch of
rows at a time, so copies of a vector are as good as any other rows. Spark sums up the vectors that changed their
centroid (partial sums on the map side), at most 2 k rows come to the driver. The table before is then deleted.

Vectors that are null, of another length, or hold null or non-finite components are left out. Every row is a vector of
its own, equal ids and equal vectors included; a null vec_id is the last of all as a seed. With fewer than k vectors, as many
centroids; without any, no rows. Numbers of 2 ** 27 and more (components of 131,072 and more at the scale 1024) are an
error that says so, as distances might not fit a long; an inertia that does not is null. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import forget, materialise
from fathom.llm.vectors import matrix

LARGEST = 1 << 27
EXACT = 1 << 22  # below, sums of products of doubles are whole numbers without rounding
SLACK = 1e-12  # relative, for rounding of bounds
STATE = "vec_id long, v array<int>, cluster int, was int, upper double, near array<int>, lower array<double>, tried int, distance long"


def whole_vectors(df: DataFrame, dim: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component, in doubles."""
    v = F.col("v")
    out = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    out = out.where(v.isNotNull() & (F.size(v) == dim)).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))))
    return out.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exactly."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def below(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 - SLACK)


def above(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + SLACK)


@dataclass
class Bounds:
    """Of a batch: cluster (n), upper (n), near (n, b) and lower (n, b + 1), whose last column is the rest's."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray

    def narrowed(self, b: int) -> Bounds:
        rest = self.lower[:, b:].min(1, keepdims=True)
        return Bounds(self.cluster, self.upper, self.near[:, :b], np.concatenate([self.lower[:, :b], rest], 1))


def scanned(x: np.ndarray, c: np.ndarray, b: int) -> Bounds:
    """From the distances to all centroids."""
    d = squares(x, c)
    order = np.argsort(d, axis=1, kind="stable")
    sorted_d = np.take_along_axis(d, order, 1)
    rest = below(sorted_d[:, b + 1]) if b + 1 < len(c) else np.full(len(x), np.inf)
    return Bounds(order[:, 0].astype(np.int32), above(sorted_d[:, 0]), order[:, 1 : b + 1].astype(np.int32), np.concatenate([below(sorted_d[:, 1 : b + 1]), rest[:, None]], 1))


def moved(x: np.ndarray, c: np.ndarray, drift: np.ndarray, s: Bounds) -> np.ndarray:
    """Bring the bounds ``s`` to centroids that moved by ``drift``. Gives for each row how many of its next centroids were
    looked at: -1 none and not its own either, the number of centroids for all."""
    b = s.near.shape[1]
    s.upper = (s.upper + drift[s.cluster]) * (1 + SLACK)
    away = np.concatenate([drift[s.near], np.full((len(x), 1), drift.max(initial=0.0))], 1)
    s.lower = np.where(np.isinf(s.lower), s.lower, s.lower - away - SLACK * (np.abs(s.lower) + away))
    tried = np.full(len(x), -1, np.int32)
    least = np.minimum.accumulate(s.lower[:, ::-1], 1)[:, ::-1]  # of a place's bound and all after it
    rows = np.flatnonzero(s.upper >= least[:, 0])
    s.upper[rows] = above(((x[rows] - c[s.cluster[rows]]) ** 2).sum(1))
    fits = s.upper[rows, None] < least[rows]
    tried[rows] = np.where(fits.any(1), fits.argmax(1), len(c))
    for j in range(1, b + 1):
        rows = np.flatnonzero(tried == j)
        if len(rows):
            ids = np.concatenate([s.cluster[rows, None], s.near[rows, :j]], 1)
            d = ((x[rows, None, :] - c[ids]) ** 2).sum(2)
            order = np.lexsort((ids, d), axis=1)
            ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
            s.cluster[rows], s.upper[rows], s.near[rows, :j], s.lower[rows, :j] = ids[:, 0], above(d[:, 0]), ids[:, 1:], below(d[:, 1:])
    rows = np.flatnonzero(tried == len(c))
    if len(rows):
        new = scanned(x[rows], c, b)
        s.cluster[rows], s.upper[rows], s.near[rows], s.lower[rows] = new.cluster, new.upper, new.near, new.lower
    return tried


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def assigned(table: DataFrame, c: np.ndarray, drift: np.ndarray | None, b: int, last: bool = False) -> DataFrame:
    """The table of one round: STATE. ``drift``: None for the first round, whose table has vec_id and v alone. ``last``: with
    the exact distance to the centroid."""

    def work(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = matrix(batch.column(1), c.shape[1]).astype(np.int64)
            if drift is None:
                s, was, tried = scanned(x, c, b), np.full(n, -1, np.int32), np.full(n, len(c), np.int32)
            else:
                was = batch.column(2).to_numpy().copy()
                near, lower = (batch.column(i).flatten().to_numpy().reshape(n, -1).copy() for i in (5, 6))
                s = Bounds(was.copy(), batch.column(4).to_numpy().copy(), near, lower).narrowed(b)
                tried = moved(x, c, drift, s)
            exact = pa.array(((x - c[s.cluster]) ** 2).sum(1)) if last else pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s.cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(s.upper), lists(s.near, pa.int32()), lists(s.lower, pa.float64()), pa.array(tried), exact],
                names=["vec_id", "v", "cluster", "was", "upper", "near", "lower", "tried", "distance"],
            )

    return materialise(table.mapInArrow(work, STATE), "centroid-bounds")


def change(table: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What a round adds to the sums (k x dim, Python's whole numbers) and counts of the centroids."""
    rows = table.where("cluster <> was").withColumn("side", F.explode(F.expr("array(struct(cluster AS c, 1L AS sign), struct(was AS c, -1L AS sign))"))).where("side.c >= 0")
    sums = rows.groupBy("side.c").agg(F.sum("side.sign"), *[F.sum(F.col("v")[i] * F.col("side.sign")) for i in range(dim)])
    add, count = np.zeros((k, dim), object), np.zeros(k, object)
    for r in sums.collect():  # at most k rows
        add[r[0]], count[r[0]] = r[2:], r[1]
    return add, count


@dataclass
class Clustering:
    """``table``: STATE after the last round, with distances; ``centroids``: k x dim; ``tried``: for each round how many rows
    looked at how many of their next centroids (-1: at no centroid, k: at all)."""

    table: DataFrame | None
    centroids: np.ndarray
    tried: list[dict[int, int]]


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3:") -> Clustering:
    """Rounds from the ``k`` vectors with the smallest sha256 of salt and vec_id (then by vector)."""
    vectors = materialise(whole_vectors(df, dim, scale), "centroid-vectors")
    largest = vectors.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0]
    if largest is None:
        return Clustering(None, np.zeros((0, dim), np.int64), [])
    if largest >= LARGEST:
        raise ValueError(f"components reach {largest} after scaling; distances are exact below {LARGEST}")
    vectors = vectors.withColumn("v", F.col("v").cast("array<int>"))
    code = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    seeds = vectors.orderBy(code.asc_nulls_last(), "v").limit(k).collect()
    c = np.array([r.v for r in seeds], np.int64)
    k = len(c)
    sums, counts = np.zeros((k, dim), object), np.zeros(k, object)
    table, drift, b, tried = vectors, None, k // 2, []
    for step in range(rounds + 1):
        before, table = table, assigned(table, c, drift, b, last=step == rounds)
        tried.append({r[0]: r[1] for r in table.groupBy("tried").count().collect()})
        forget(before) if step else None
        if step == rounds:
            break
        add, count = change(table, k, dim)
        sums, counts = sums + add, counts + count
        new = np.array([[s // n for s in row] if n else old for row, n, old in zip(sums, counts, c.tolist())], np.int64)
        drift = above(((new - c) ** 2).sum(1))
        c = new
        if step:  # the first round looks at all
            b = min(b, max([k // 8, 1, *(t for t in tried[-1] if t < k)]))
    return Clustering(table, c, tried)


def clusters(df: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector."""
    spark = df.sparkSession
    done = cluster(df, k, rounds, dim, scale, salt)
    fields = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if done.table is None:
        return spark.createDataFrame([], f"vec_id long, cluster int, distance long, {fields.partition(', ')[2]}")
    found = {r[0]: int(r[1]) for r in done.table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}
    fit = lambda n: n if n < 1 << 63 else None
    rows = [(j, fit(n), fit(sum(found.values())), hashlib.sha256(",".join(map(str, done.centroids[j])).encode()).hexdigest()) for j, n in found.items()]
    return done.table.select("vec_id", "cluster", "distance").join(F.broadcast(spark.createDataFrame(rows, fields)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """The same rounds without bounds."""
    apart = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT x.r, x.vec_id, x.v, c.c, {apart} AS d FROM kept x CROSS JOIN c{i} c) GROUP BY r)""")
        parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM
 (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, {dim + 1}) t(i) GROUP BY c, i) GROUP BY c) n ON n.c = c.c)""")
    return "WITH " + ",\n".join(parts[:-1]) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""


ORACLE_SQL = oracle_sql()
