"""Layered and exact searches against each other and against enumeration."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_market import market

from fathom.operators import exact, search


def random_market(spark, seed, n=7, low=-0.02, high=0.01):
    rnd = random.Random(seed)
    prices = [(f"E{i % 3}", f"C{i}", round(1 + rnd.uniform(-0.01, 0.01), 6)) for i in range(n)]
    edges = [(a, b, rnd.uniform(low, high)) for a, b in itertools.permutations(range(n), 2)]
    return prices, edges, market(spark, prices, edges)


def walks(prices, edges, start, target, depth, gated):
    """The cheapest walk of each length that first meets ``target`` at its end."""
    out, best = {}, {start: (0.0, (start,))}
    for k in range(1, depth + 1):
        step = {}
        for node, (cost, path) in best.items():
            for a, b, w in edges:
                if a == node and (not gated or prices[a][2] - prices[b][2] > w):
                    c = (cost + w, (*path, b))
                    if b not in step or c < step[b]:
                        step[b] = c
        if target in step:
            out[k] = step.pop(target)
        best = step
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles(spark, seed):
    prices, edges, (nodes, rows) = random_market(spark, seed)
    layered = {(r.start, r.depth): (r.total_cost, tuple(r.path)) for r in search.cycles(nodes, rows, 4).collect()}
    expected = {}
    for s in range(len(prices)):
        for k, (cost, path) in walks(prices, edges, s, s, 4, True).items():
            expected[s, k] = (cost, path)
    assert layered == expected and layered
    for algorithm in exact.ALGORITHMS:
        found = {(r.start, r.depth): r.total_cost for r in exact.exact_cycles(nodes, rows, algorithm, 4).collect()}
        assert found.keys() == layered.keys()
        assert all(found[k] >= layered[k][0] - 1e-12 for k in found)


def test_shortest_paths(spark):
    prices, edges, (nodes, rows) = random_market(spark, 5, low=0.001, high=0.01)
    pairs = spark.createDataFrame([(a, b) for a in range(7) for b in range(7)], "start int, target int")
    got = {(r.start, r.target): (r.total_cost, tuple(r.path)) for r in search.shortest_paths(pairs, rows, 4).collect()}
    dijkstra = {(r.start, r.target): r.total_cost for r in exact.exact_paths(nodes, rows, pairs, "dijkstra", 4).collect()}
    for a in range(7):
        for b in range(7):
            cost, path = min(walks(prices, edges, a, b, 4, False).values(), key=lambda x: (x[0], len(x[1]), x[1]))
            assert got[a, b][0] == pytest.approx(cost) and dijkstra[a, b] == pytest.approx(cost)
    astar = {(r.start, r.target): r.total_cost for r in exact.exact_paths(nodes, rows, pairs, "astar", 4).collect()}
    assert all(astar[k] >= dijkstra[k] - 1e-12 for k in dijkstra)


def test_unreachable_and_snapshots(spark):
    nodes, rows = market(spark, [("A", "X", 1.0), ("B", "X", 1.1)], [(0, 1, -0.2), (1, 0, 0.05)])
    assert search.shortest_paths(spark.createDataFrame([(0, 5)], "start int, target int"), rows, 3).count() == 0
    two = nodes.withColumn("day", F.lit(1)).unionByName(nodes.withColumn("day", F.lit(2)))
    both = rows.withColumn("day", F.lit(1)).unionByName(rows.where("src = 0").withColumn("day", F.lit(2)))
    got = search.cycles(two, both, 2, snapshot="day").collect()
    assert {r.day for r in got} == {1} and len(got) == 2
    assert {r.day for r in exact.exact_cycles(two, both, "astar", 2, snapshot="day").collect()} == {1}


def test_names():
    assert exact.resolve("weighted_astar") == "weighted_astar" and exact.resolve("weighted_astar", strict=True) == "dijkstra"
    with pytest.warns(UserWarning):
        assert exact.resolve("other") == "dijkstra"


def test_labels_and_ties(spark):
    nodes, rows = market(spark, [("A", "X", 1.0), ("B", "X", 1.0), ("C", "X", 1.0)], [(0, 1, -0.1), (0, 2, -0.1), (1, 0, -0.1), (2, 0, -0.1)])
    r = search.cycles(nodes, rows, 2).where("start = 0")
    assert search.path_labels(r, nodes).first().path_labels == "A(X) -> B(X) -> A(X)"
    assert exact.exact_cycles(nodes, rows, "astar", 2, starts=[0]).first().path == [0, 1, 0]


@pytest.mark.parametrize(("algorithm", "path"), [("dijkstra", [0, 2, 3]), ("astar", [0, 2, 3]), ("weighted_astar", [0, 1, 3]), ("astar_optimized", [0, 1, 3])])
def test_order_decides(spark, algorithm, path):
    """Nodes 1 and 2 have one priority (0.5) but costs of 0.5 and 0.25; who goes first reaches 3 first."""
    nodes, rows = market(spark, [("A", "X", 1.0), ("B", "X", 1.0), ("C", "X", 1.0), ("D", "X", 1.0)], [(0, 1, 0.5), (0, 2, 0.25), (1, 3, -0.25), (2, 3, -0.25)])
    rows = rows.withColumn("transfer_time", F.when(F.col("dst") == 2, 250.0).otherwise(0.0))
    pairs = spark.createDataFrame([(0, 3), (3, 0)], "start int, target int")
    got = exact.exact_paths(nodes, rows, pairs, algorithm, 3).collect()
    assert [(r.start, r.path, r.depth) for r in got] == [(0, path, 2)]


@pytest.mark.parametrize(("algorithm", "path"), [("astar", [0, 2, 3, 0]), ("astar_optimized", [0, 1, 3, 0])])
def test_order_decides_cycles(spark, algorithm, path, monkeypatch):
    """The cycle kept for a depth is the one whose node 3 was met first; one task or many give the same."""
    nodes, rows = market(spark, [("A", "X", 1.0), ("B", "X", 1.0), ("C", "X", 1.0), ("D", "X", 1.0)], [(0, 1, -0.25), (0, 2, -0.5), (1, 3, -0.5), (2, 3, -0.5), (3, 0, -0.5)])
    rows = rows.withColumn("transfer_time", F.when(F.col("dst") == 2, 250.0).otherwise(0.0))
    dealt = exact.exact_cycles(nodes, rows, algorithm, 3, starts=[0]).collect()
    monkeypatch.setattr(exact, "MOST_EDGES", 2)
    assert [r.path for r in dealt] == [path] and exact.exact_cycles(nodes, rows, algorithm, 3, starts=[0]).collect() == dealt
    pairs = spark.createDataFrame([(0, 3), (0, 3), (3, 0), (2, 9)], "start int, target int")
    parts = exact.exact_paths(nodes, rows, pairs, algorithm, 3).collect()
    monkeypatch.undo()
    assert sorted(parts) == sorted(exact.exact_paths(nodes, rows, pairs, algorithm, 3).collect()) and len(parts) == 3


@pytest.mark.parametrize("algorithm", exact.ALGORITHMS)
def test_parts_equal_the_whole_graph(spark, algorithm, monkeypatch):
    """Graphs over the bound: each search gets its part by joins, and finds what it finds in the whole."""
    rng = random.Random(algorithm)
    nodes, rows = market(spark, [(f"E{i % 4}", f"C{i}", 1 + rng.random() / 50) for i in range(14)], [(a, b, round(rng.uniform(-0.03, 0.02), 4)) for a in range(14) for b in range(14) if a != b and rng.random() < 0.4])
    rows = rows.withColumn("transfer_time", (F.col("src") * 7 % 5 + F.col("dst") * 3 % 4).cast("double"))
    pairs = nodes.select(F.col("node_id").alias("start"), ((F.col("node_id") * 5 + 3) % 14).alias("target")).where("start <> target")
    two = lambda df: df.withColumn("day", F.lit("a")).unionByName(df.where("true").withColumn("day", F.lit("b")))
    found = lambda: [sorted(map(str, x.collect())) for x in (exact.exact_cycles(nodes, rows, algorithm, 4), exact.exact_paths(nodes, rows, pairs, algorithm, 4), exact.exact_cycles(two(nodes), two(rows), algorithm, 3, snapshot="day"))]
    whole = found()
    monkeypatch.setattr(exact, "MOST_EDGES", 10)
    assert found() == whole and all(whole)


def test_factors_decide_the_order(spark):
    """Ways 0-1-3 and 0-2-3 cost the same; a step's risk is the price gap to the target times the factor of its first node.
    Leaving 1 costs 0.1 x 10 and leaving 2 costs 0.1 x 1, so 2 goes first; with one factor the tie goes to 1."""
    nodes, rows = market(spark, [("A", "X", 1.0), ("B", "X", 1.1), ("C", "X", 1.1), ("D", "X", 1.0)], [(0, 1, 0.5), (0, 2, 0.5), (1, 3, 0.1), (2, 3, 0.1)])
    rows = rows.withColumn("transfer_time", F.lit(0.0))
    pairs = spark.createDataFrame([(0, 3)], "start int, target int")
    own = spark.createDataFrame([("B", "X", 10.0), ("C", "X", 1.0)], "exchange string, coin string, factor double")
    path = lambda e, a: exact.exact_paths(nodes, e, pairs, a, 3).first().path
    places = nodes.select(F.col("node_id").alias("src"), F.col("exchange").alias("src_exchange"), F.col("coin").alias("src_coin"))
    named = rows.drop("src_exchange", "src_coin").join(places, "src")
    for algorithm in ("astar", "dijkstra"):
        assert path(rows, algorithm) == [0, 1, 3]
    assert path(exact.edge_factors(named, own), "astar") == [0, 2, 3]
    assert path(exact.edge_factors(named, own), "dijkstra") == [0, 1, 3]
