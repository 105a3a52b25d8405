"""Whole runs, fiat nodes, lookups, clearing, chart points and the command line."""

import pytest
from test_market import market

from fathom import cli
from fathom.operators import build, graph, rolling, simulate, wallet
from fathom.plans import runs
from fathom.sources import files

NODES = [("A", "X", 1.02), ("A", "Y", 1.0), ("B", "X", 0.99)]
LOOPS = [(0, 1, -0.02), (1, 2, -0.01), (2, 0, -0.05), (0, 2, -0.03), (2, 1, -0.03), (1, 0, -0.04)]


def test_monte_carlo(spark):
    rows = runs.monte_carlo(spark, 5, 3, 2, algorithm="astar", max_depth=3, seed=1).collect()
    assert sorted(r.sim_id for r in rows) == list(range(5)) and {r.graph_size for r in rows} == {6}
    assert all(not r.has_opportunities and r.num_opportunities == 0 and r.total_profit == 0 for r in rows)  # no rebates
    none = runs.monte_carlo(spark, 2, 0, 2).collect()
    assert [(r.graph_size, r.num_opportunities) for r in none] == [(0, 0)] * 2
    stats = runs.stress_test(spark, 25).first()
    assert stats.simulations == 25 and stats.success_rate == 0 and stats.avg_opportunities == 0 and stats.var_5 == 0


def test_compare_algorithms(spark):
    found = runs.compare_algorithms(spark, max_depth=3, runs=2, markets=lambda s, e, c, seed: market(s, NODES, LOOPS))
    rows = {(r.run, r.method): r for r in found.collect()}
    assert len(rows) == 8 and all(r.seconds > 0 for r in rows.values())
    nodes, edges = market(spark, NODES, LOOPS)
    for method, algorithm in (("two_level_dijkstra", "dijkstra"), ("two_level_astar", "astar")):
        expected = simulate.opportunities(nodes, edges, algorithm, 3).collect()
        assert rows[0, method].opportunities == len(expected) > 0
        assert rows[0, method].profit == pytest.approx(sum(r.net_profit for r in expected))
    means = {r.method: r for r in runs.comparison_summary(found).collect()}
    assert means["astar"].avg_opportunities == rows[0, "astar"].opportunities


def test_basic_experiment(spark):
    rows = runs.basic_experiment(spark, max_depth=3, markets=lambda s, e, c, seed: market(s, NODES, LOOPS)).collect()
    by = {s: [r for r in rows if r.search == s] for s in ("dijkstra", "astar", "two_level_astar")}
    assert by["dijkstra"][0].description.startswith("A(X) -> ") and len(by["two_level_astar"]) <= 5
    for group in by.values():
        assert [r.place for r in group] == list(range(1, len(group) + 1))
        assert [r.net_profit for r in group] == sorted((r.net_profit for r in group), reverse=True)


def test_backtest_algorithms(spark):
    panel = spark.createDataFrame([("d1", "A", "X", 1.0), ("d1", "B", "X", 1.1), ("d2", "A", "X", 1.0)], "day string, exchange string, coin string, price double")
    for algorithm in ("layered", "astar"):
        got = sorted((r.day, r.num_opportunities, r.num_nodes) for r in simulate.run_backtest(panel, "day", 3, algorithm=algorithm).collect())
        assert got == [("d1", 0, 2), ("d2", 0, 1)]
    nodes = simulate.panel_nodes(panel, "day")
    stats = {r.day: (r.num_nodes, r.num_edges, r.num_exchanges) for r in simulate.snapshot_statistics(nodes, build.panel_edges(nodes, "day"), "day").collect()}
    assert stats == {"d1": (2, 2, 2), "d2": (1, 0, 1)}


def test_fiat_nodes(spark):
    nodes, _ = market(spark, [("A", "X", 1.2), ("B", "X", 0.9), ("B", "USD", 0.7)], [(0, 1, 0.1)])
    rows = lambda df: sorted((r.node_id, r.exchange, r.coin, r.price) for r in df.collect())
    assert rows(build.fiat_nodes(nodes)) == [(0, "A", "X", 1.2), (1, "B", "X", 0.9), (2, "B", "USD", 1.0), (3, "A", "USD", 1.0)]
    own = spark.createDataFrame([("A", "EUR"), ("A", "CAD"), ("A", "EUR")], "exchange string, fiat string")
    assert rows(build.fiat_nodes(nodes, own))[2:] == [(2, "B", "USD", 1.0), (3, "A", "CAD", 1.0), (4, "A", "EUR", 1.0)]
    assert rows(build.fiat_nodes(nodes.limit(0))) == []
    demo = {r.with_fiat: (r.num_nodes, r.num_edges) for r in runs.fiat_demo(nodes.where("coin = 'X'"), max_depth=2).collect()}
    assert demo == {False: (2, 2), True: (4, 8)}


def test_lookups(spark):
    nodes, _ = market(spark, NODES, LOOPS)
    wanted = spark.createDataFrame([("A", "Y"), ("A", "Y"), ("Z", "X")], "exchange string, coin string")
    assert [r.node_id for r in graph.find_nodes(nodes, wanted).collect()] == [1]
    held = spark.createDataFrame([("A", "Y", 5.0)], "exchange string, coin string, balance double")
    assert sorted(r.balance for r in wallet.balances_of(held, wanted.distinct()).collect()) == [0.0, 5.0]


def test_clear(spark):
    ticks = spark.createDataFrame([(s, "A", "X", 1.0 + s) for s in range(6)], "seq long, exchange string, coin string, price double")
    clears = spark.createDataFrame([(1,), (3,)], "seq long")
    assert sorted(r.seq for r in rolling.since_clear(ticks, clears).collect()) == [4, 5]
    assert rolling.since_clear(ticks, clears.limit(0)).count() == 6
    assert rolling.latest_volatility(rolling.since_clear(ticks, clears)).first().volatility == rolling.DEFAULT_VOLATILITY


def test_fee_savings_and_chart(spark):
    rows = runs.fee_savings(spark).orderBy("volume").collect()
    assert (rows[0].fee, rows[0].savings) == (0.5, 0.0) and rows[-1].rate == 0.0001 and rows[-1].savings == pytest.approx(-19.5)
    table = spark.createDataFrame([(10, 2.0, None), (20, 4.0, 1.0)], "nodes int, dense double, sparse double")
    points = sorted(tuple(r) for r in files.chart_points(table, "nodes", "dense", "sparse").collect())
    assert points == [("10", "dense", 2.0), ("20", "dense", 4.0), ("20", "sparse", 1.0)]


def test_command_line(spark, capsys, monkeypatch):
    top = cli.report(*market(spark, NODES, LOOPS), "astar", 3).collect()
    assert 0 < len(top) <= cli.TOP and all(r.roi_percent is not None for r in top)
    monkeypatch.setattr(cli, "synthetic", lambda *a, **k: spark.range(1))
    cli.main(["--synthetic"])
    assert "id" in capsys.readouterr().out
    monkeypatch.setattr(cli, "live_market", lambda *a: (_ for _ in ()).throw(RuntimeError("no venue")))
    cli.main(["--live"])
    assert "live market failed (no venue)" in capsys.readouterr().out
