"""Operators that must not need all rows, or all rows of a key, in one task: results against plain ones, and plans."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import build, graph, metrics, orderstats, rolling, search, simulate, tables
from fathom.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b"]), i, rng.random()) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, seq int, v double").repartition(7)
    places = {}
    for k, i, _ in sorted(rows, key=lambda r: r[1]):
        places[i] = places.setdefault(("n", k), 0)
        places["n", k] += 1
    assert {r.seq: r["rank"] for r in tables.ranked(df, ["k"], ["seq"]).collect()} == {i: places[i] for _, i, _ in rows}
    every = tables.ranked(df, [], ["seq"])
    assert sorted((r.seq, r["rank"]) for r in every.collect()) == [(i, i) for i in range(3000)]
    assert tables.ranked(df.where("false"), ["k"], ["seq"]).count() == 0


@pytest.mark.parametrize("stretch", [1, 7, 1 << 16])
def test_rolling_in_stretches(spark, stretch):
    """One exchange holds most ticks; any length of stretch gives the figures of a window over the whole key."""
    rng = random.Random(2)
    rows = [(i, "big" if rng.random() < 0.9 else f"x{i % 4}", "c", rng.choice([0.0, -1.0, 1.0, 1.1, 0.9, 5.0, None])) for i in range(1500)]
    ticks = spark.createDataFrame(rows, "seq int, exchange string, coin string, price double").repartition(5)
    want = {r.seq: r.volatility for r in rolling._volatility(ticks, 6, rolling.MARKET).collect()}
    got = rolling.rolling_volatility(ticks, 6, stretch=stretch)
    assert got.columns == [*ticks.columns, "volatility"]
    found = {r.seq: r.volatility for r in got.collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[s], want[s], rel_tol=1e-9) for s in want)


def test_hot_key_is_many_tasks(spark):
    ticks = spark.range(40_000).selectExpr("id AS seq", "IF(id % 10 = 0, concat('x', id % 3), 'big') AS exchange", "'c' AS coin", "1 + rand(1) AS price")
    out = rolling.rolling_volatility(ticks, 100, stretch=1000)
    text = plan(out)
    assert "windowspecdefinition(exchange#" not in text or "__stretch" in text
    assert all("__stretch" in line for line in text.splitlines() if "Window [" in line and "sum(__n" not in line)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 40_000 and max(sizes) < 0.6 * 40_000  # 4 partitions; nine tenths are one key


def market(rng, n, exchanges, hot):
    rows = [(i, "hot" if rng.random() < hot else f"e{rng.randrange(exchanges)}", f"c{rng.randrange(6)}", rng.random()) for i in range(n)]
    return rows


@pytest.mark.parametrize("n, exchanges, hot, k", [(60, 3, 0.0, 10), (60, 3, 0.9, 10), (60, 40, 0.3, 4), (40, 1, 1.0, 5), (25, 5, 0.2, 50), (1, 1, 0.0, 3)])
@pytest.mark.parametrize("listed", [False, True])
def test_sparse_pairs(spark, n, exchanges, hot, k, listed):
    rng = random.Random(n * k + exchanges)
    rows = market(rng, n, exchanges, hot)
    nodes = spark.createDataFrame(rows, "node_id int, exchange string, coin string, price double").repartition(3)
    listings = nodes.where("node_id % 3 = 0 AND exchange <> 'e0'").select("exchange", "coin") if listed else None
    want = build.sparse_edges(build.node_pairs(nodes), k, listings)
    got = build.sparse_pairs(nodes, k, listings)
    assert sorted(map(tuple, got.select(*build.COLUMNS).collect())) == sorted(map(tuple, want.select(*build.COLUMNS).collect()))


def test_sparse_plan_makes_no_product(spark):
    text = plan(build.sparse_market(spark.range(50).selectExpr("CAST(id AS int) AS node_id", "concat('e', id % 5) AS exchange", "concat('c', id) AS coin", "1.0D AS price")))
    assert "Cartesian" not in text and text.count("BroadcastNestedLoopJoin") <= 3  # with single rows


def doubles(rng, n):
    bits = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(n)]
    return [x for x in bits if not math.isnan(x)]


@pytest.mark.parametrize("kind", ["any", "near", "ties", "odd", "ulps"])
def test_order_statistics(spark, kind):
    rng = random.Random(kind)
    one = 1.2345
    ulps = [one + k * 2**-52 for k in range(300)]
    values = {
        "any": doubles(rng, 800),
        "near": [1e9 + rng.random() for _ in range(700)],
        "ties": [rng.choice([3.0, 3.0, 3.0, -1.0, 0.0, -0.0, 2.5]) for _ in range(500)],
        "odd": [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7e308, -1.7e308, None, 1.0, 2.0, None],
        "ulps": ulps * 2,
    }[kind]
    rng.shuffle(values)
    want = sorted(v for v in values if v is not None)
    places = sorted({0, 1, len(want) // 3, len(want) // 2, len(want) - 1, len(want) + 5})
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    got = {r.place: r.value for r in orderstats.order_statistics(df, "v", spark.createDataFrame([(p,) for p in places], "place long")).collect()}
    assert got == {p: want[p] for p in places if p < len(want)}


def test_median_and_tail(spark):
    rng = random.Random(9)
    for n in (0, 1, 2, 7, 20, 21, 100, 399):
        profits = [round(rng.gauss(0, 9), rng.choice([0, 3])) for _ in range(n)]
        df = spark.createDataFrame([(i, 1, p, True) for i, p in enumerate(profits)], "sim_id int, num_opportunities int, total_profit double, has_opportunities boolean")
        middle = orderstats.median(df, "total_profit").first()[0]
        assert middle == (pytest.approx(float(np.median(profits))) if n else None)
        rows = simulate.statistics(df).collect()
        if not n:
            assert rows == []
            continue
        low, tail = sorted(profits), int(0.05 * n)
        assert rows[0].var_5 == (low[tail] if n > 20 else 0.0)
        assert rows[0].expected_shortfall == pytest.approx(sum(low[:tail]) / tail if tail else 0.0)


def test_median_plan_has_no_task_with_all_values(spark):
    text = plan(catalog.QUERIES["metrics_summary"](spark, SF))
    assert "median" not in text.replace("median_roi", "") and "percentile" not in text
    assert metrics.summary(metrics.opportunity_log(catalog.M.orders_log(spark, SF)).where("false")).count() == 0


def test_named_paths(spark):
    found = spark.createDataFrame([(1, [0, 2, 0]), (1, [0, 2, 0]), (2, []), (3, [9, 1])], "start int, path array<int>")
    nodes = spark.createDataFrame([(0, "A", "X"), (1, "B", "Y"), (2, "C", "Z")], "node_id int, exchange string, coin string")
    got = sorted((r.start, r.path_labels) for r in search.path_labels(found, nodes).collect())
    assert got == [(1, "A(X) -> C(Z) -> A(X)"), (1, "A(X) -> C(Z) -> A(X)"), (2, ""), (3, "B(Y)")]
    steps = [r.steps for r in search.named_paths(found, nodes, F.struct("exchange", "coin")).where("start = 1").collect()]
    assert steps[0][1].coin == "Z" and "BroadcastNestedLoop" not in plan(search.path_labels(found, nodes))


def test_dense_numbers(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(10**6), f"E{rng.randrange(40)}", f"C{rng.randrange(40)}", rng.random()) for _ in range(2000)]
    df = spark.createDataFrame(rows, "seq int, exchange string, coin string, price double").dropDuplicates(["seq"])
    a, b = graph.upsert_nodes(df), graph.upsert_nodes(df, spread=True)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert "SinglePartition" not in plan(b) and "SinglePartition" in plan(a)
    panel = df.selectExpr("seq % 3 AS ts", "exchange", "coin", "price").dropDuplicates(["ts", "exchange", "coin"])
    ids = lambda spread: sorted(map(tuple, simulate.panel_nodes(panel, "ts", spread).collect()))
    assert ids(True) == ids(False)
    assert sorted(map(tuple, build.fiat_nodes(a, spread=True).collect())) == sorted(map(tuple, build.fiat_nodes(a).collect()))
