"""Bounded rounds against plain ones: same assignments, centroids and ties; bounds do save distances."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from fathom.llm import centroids, queries

SF = "/root/testdata/sf0.001"


def brute(rows, k=8, rounds=10, dim=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid hash), sorted."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in seeds]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(c)), key=lambda j: (apart(v, c[j]), j))
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            c[j] = [sum(x) // len(own) for x in zip(*own)] if own else c[j]
    out = [(i, near(v), apart(v, c[near(v)])) for i, v in kept]
    total = lambda j=None: sum(d for _, a, d in out if j in (None, a))
    return sorted([(i, a, d, total(a), total(), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for i, a, d in out], key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, `v.x` int").repartition(3)
    return sorted(map(tuple, centroids.clusters(df, **options).collect()), key=repr)


def odd_rows(dim=64):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-1, 0, 0.5]) + rng.random() / 50 for _ in range(dim)]) for i in range(150)]
    rows += [(1000 + i, [0.25] * dim) for i in range(60)] + [(5, [0.0] * dim), (5, [1.0] * dim), (None, [2.0] * dim), (6, [-3.5] * dim)]
    return rows + [(7, None), (8, [1.0]), (9, [None] * dim), (10, [math.nan] * dim), (11, [math.inf] + [0.0] * (dim - 1)), (12, [])]


def test_brute_force(spark):
    assert run(spark, odd_rows()) == brute(odd_rows())


@pytest.mark.parametrize("k", [1, 2, 3, 20])
def test_brute_force_small_grid(spark, k):
    """Two dimensions on a coarse grid: ties everywhere."""
    rng = random.Random(k)
    rows = [(i, [rng.randrange(6) / 1024, rng.randrange(6) / 1024]) for i in range(200)]
    assert run(spark, rows, k=k, dim=2) == brute(rows, k=k, dim=2)


def test_few_and_no_vectors(spark):
    for rows in ([], [(1, None)], [(1, [1.0] * 64)], [(3, [1.0] * 64), (3, [1.0] * 64), (4, [2.0] * 64)]):
        assert run(spark, rows) == brute(rows)


def test_large_numbers(spark):
    rows = [(i, [100_000.0 + i * 7] * 64) for i in range(40)]
    assert run(spark, rows) == brute(rows)
    with pytest.raises(ValueError, match="exact below"):
        run(spark, [(1, [1e9] * 64)])


def test_bounds_certify_most_rows(spark):
    rng = np.random.default_rng(1)
    at = rng.normal(size=(8, 16)) * 4
    rows = [(i, (at[i % 8] + rng.normal(size=16) / 3).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    done = centroids.cluster(df, dim=16)
    assert sum(done.tried[-1].values()) == 800 and done.tried[-1].get(-1, 0) > 700
    assert sum(t.get(8, 0) for t in done.tried[1:]) < 0.5 * 800 * 10
    plain = brute(rows, dim=16)
    assert sorted(map(tuple, centroids.clusters(df, dim=16).collect()), key=repr) == plain


def test_moved_is_exact_under_any_drift():
    rng = np.random.default_rng(5)
    x, c = rng.integers(-9, 9, (300, 3)), rng.integers(-9, 9, (9, 3))
    s = centroids.scanned(x, c, 4)
    for step in range(12):
        new = c + rng.integers(-1, 2, c.shape) * (step % 3)
        if step == 6:
            s = s.narrowed(2)
        centroids.moved(x, new, centroids.above(((new - c) ** 2).sum(1)), s)
        c, d = new, centroids.squares(x, new)
        assert (s.cluster == d.argmin(1)).all() and (s.upper**2 >= d.min(1)).all()
        assert (np.take_along_axis(d, s.near, 1) >= np.sign(s.lower[:, :-1]) * s.lower[:, :-1] ** 2).all()


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.sql(queries.ORACLE_SQL["op12_centroids"]).df()
    got = queries.QUERIES["op12_centroids"](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, want.itertuples(index=False))) == sorted(map(tuple, got.itertuples(index=False)))
