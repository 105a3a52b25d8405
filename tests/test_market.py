"""Fixtures with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from fathom import functions as X
from fathom.operators import build, evaluate, graph, metrics, rolling, search, simulate, wallet
from fathom.sources import files, generate, quotes, rules

EDGE = "edge_seq long, src int, dst int, fee double, volatility_cost double, transfer_time double, weight double"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def market(spark, prices, edges):
    """prices: [(exchange, coin, price)]; edges: [(src, dst, weight)]."""
    nodes = spark.createDataFrame([(i, *p) for i, p in enumerate(prices)], "node_id int, exchange string, coin string, price double")
    rows = spark.createDataFrame([(k, a, b, w, 0.0, 0.0, w) for k, (a, b, w) in enumerate(edges)], EDGE)
    side = lambda n: nodes.select(F.col("node_id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("exchange", "coin", "price")])
    return nodes, rows.join(side("src"), "src").join(side("dst"), "dst")


def test_expressions(spark):
    r = one(
        spark,
        weight=X.edge_weight(F.lit(0.001), F.lit(0.0001)),
        h=X.heuristic(F.lit(120.0), F.lit(1.00), F.lit(1.01)),
        zero=X.ratio(F.lit(5.0), F.lit(0)),
        rate=X.ratio(F.lit(25.0), F.lit(6)),
        usd=X.is_fiat(F.lit("usd")),
        dai=X.is_fiat(F.lit("DAI")),
        floor=X.volatility_multiple(F.lit(0.0014)),
        label=X.label(F.lit("Kraken"), F.lit("USDT")),
    )
    assert r.weight == pytest.approx(0.0011) and r.h == pytest.approx(0.121) and r.zero == 0.0 and r.rate == 25 / 6
    assert r.usd and not r.dai and r.floor == 0.05 and r.label == "Kraken(USDT)"


def test_default_tiers(spark):
    volumes = [500, 1000, 5000, 10000, 50000, 100000, 200000]
    rows = spark.createDataFrame([(float(v),) for v in volumes], "v double").select(X.tier_rate("v").alias("r")).collect()
    assert [r.r for r in rows] == [0.001, 0.0005, 0.0005, 0.0002, 0.0002, 0.0001, 0.0001]


def test_upsert_updates_and_foreign_keys(spark):
    rows = spark.createDataFrame([(0, "Kraken", "USDT", 1.0), (1, "Coinbase", "USDC", 0.99), (2, "Kraken", "USDT", 1.01)], "seq int, exchange string, coin string, price double")
    nodes = graph.upsert_nodes(rows)
    assert [(r.node_id, r.exchange, r.price) for r in nodes.orderBy("node_id").collect()] == [(0, "Kraken", 1.01), (1, "Coinbase", 0.99)]
    new = spark.createDataFrame([(0, "Kraken", "USDT", 2.0), (1, "X", "Y", 9.0)], "seq int, exchange string, coin string, price double")
    assert sorted(r.price for r in graph.update_prices(nodes, new).collect()) == [0.99, 2.0]
    schema = "src_exchange string, src_coin string, dst_exchange string, dst_coin string, fee double"
    good = spark.createDataFrame([("Kraken", "USDT", "Coinbase", "USDC", 0.1)], schema)
    bad = spark.createDataFrame([("Kraken", "USDT", "Gone", "USDC", 0.1)], schema)
    assert graph.insert_edges(good, good, nodes).count() == 2
    with pytest.raises(ValueError):
        graph.insert_edges(good, bad, nodes)


@pytest.mark.parametrize(("exchanges", "coins", "k", "expected"), [(4, 3, 10, 120), (7, 1, 10, 42), (4, 3, 3, 36)])
def test_dense_and_sparse_sizes(spark, exchanges, coins, k, expected):
    nodes, edges = generate.synthetic_market(spark, exchanges, coins, seed=1)
    v = exchanges * coins
    assert nodes.count() == v and edges.count() == v * (v - 1)
    sparse = build.sparse_edges(edges, k)
    assert sparse.count() == expected
    first = sparse.where("src = 0").orderBy("dst").collect()
    assert sum(r.src_exchange == r.dst_exchange for r in first) == min(k, coins - 1)


def test_fiat_sizes(spark):
    rows = [(f"E{e}", c, 1.0) for e in range(3) for c in ("USDT", "USDC", "DAI", "USD")]
    nodes = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "node_id int, exchange string, coin string, price double")
    edges = build.fiat_edges(nodes)
    fiat = F.upper("src_coin") == "USD"
    assert edges.count() == 72 + 18 + 6
    assert edges.where(fiat & (F.col("dst_coin") == "USD")).count() == 6
    assert build.fiat_edges(nodes, between_fiat=False).count() == 90
    assert build.fiat_bridge_paths(nodes, "USDT", "DAI").count() == 3 * 2


def test_no_cycles_without_rebates(spark):
    nodes, edges = generate.synthetic_market(spark, seed=7)
    assert search.cycles(nodes, edges, 4).count() == 0


def test_two_cycle_with_rebate(spark):
    nodes, edges = market(spark, [("A", "X", 1.00), ("B", "X", 1.01)], [(0, 1, -0.02), (1, 0, 0.005)])
    found = search.cycles(nodes, edges, 2).where("start = 0").collect()
    assert [r.path for r in found] == [[0, 1, 0]] and found[0].total_cost == pytest.approx(-0.015) and found[0].net_profit == pytest.approx(0.015)
    assert search.cycles(nodes, edges, 1).count() == 0
    rows = search.two_level(search.cycles(nodes, edges, 2), nodes).orderBy("start").collect()
    assert [r.description for r in rows] == ["A(X) -> B(X)", "B(X) -> A(X)"]


def test_self_loop(spark):
    nodes, edges = market(spark, [("A", "X", 1.0)], [(0, 0, -0.001)])
    r = search.cycles(nodes, edges, 3).collect()
    assert len(r) == 1 and r[0].path == [0, 0] and r[0].total_cost == -0.001


def test_path_evaluation(spark):
    nodes, edges = market(spark, [("A", "X", 1.00), ("B", "X", 1.01)], [(0, 1, 0.0006)])
    paths = spark.createDataFrame([(1, [0, 1]), (2, [0]), (3, [1, 0])], "path_id int, path array<int>")
    r = {x.path_id: x for x in evaluate.evaluate_paths(paths, nodes, edges, 100.0).collect()}
    assert r[1].price_difference == pytest.approx(-1.0) and r[1].total_cost == pytest.approx(0.06) and r[1].net_profit == pytest.approx(-1.06) and r[1].roi == pytest.approx(-1.06) and not r[1].profitable
    assert r[2].error == "Path too short" and r[3].total_cost == 0.0 and r[3].net_profit == pytest.approx(1.0)


def stops(*names):
    return [(n, "USDT") for n in names]


WALLET = "path_id int, path array<struct<exchange: string, coin: string>>, profit_rate double, cost_rate double, funds double"


def test_wallet(spark):
    balances = spark.createDataFrame([("Kraken", "USDT", 1000.0), ("Coinbase", "USDT", 500.0), ("Binance", "USDT", 2000.0)], "exchange string, coin string, balance double")
    paths = spark.createDataFrame([(1, stops("Kraken", "Coinbase", "Binance")), (2, stops("Kraken", "None")), (3, [])], "path_id int, path array<struct<exchange: string, coin: string>>")
    assert {r.path_id: r.max_amount for r in wallet.executable_amounts(paths, balances).collect()} == {1: 500.0, 2: 0.0, 3: 0.0}
    assert {r.path_id: r.executable for r in wallet.can_execute(paths, balances, 500).collect()} == {1: True, 2: False, 3: True}
    assert not wallet.can_execute(paths.where("path_id = 1"), balances, 600).first().executable
    s = {r.exchange: (r.total, r.positions) for r in wallet.summary(balances).collect()}
    assert s[None] == (3500.0, 3) and s["Kraken"] == (1000.0, 1)


@pytest.mark.parametrize(("funds", "volume", "profit"), [(10000.0, 10000.0, 1.0), (1000.0, 0.0, 0.0), (50000.0, 50000.0, 5.0), (-5.0, 0.0, 0.0)])
def test_optimise_volume(spark, funds, volume, profit):
    r = wallet.optimise_volumes(spark.createDataFrame([(1, stops("A", "B"), 0.001, 0.0005, funds)], WALLET)).first()
    assert r.optimal_volume == volume and r.optimal_profit == pytest.approx(profit)


def test_verdict(spark):
    path = stops("A", "B", "C", "A")
    offers = spark.createDataFrame([(1, path, 0.002, 0.0015, 0.0)], WALLET).drop("funds")
    rich = spark.createDataFrame([(e, "USDT", 100000.0) for e in "ABC"], "exchange string, coin string, balance double")
    r = wallet.verdicts(offers, rich, 1000.0).first()
    assert r.executable and r.max_amount == 100000.0 and r.optimal_volume == 100000.0 and r.optimal_profit == pytest.approx(10.0)
    poor = wallet.verdicts(offers, rich.withColumn("balance", F.lit(10.0)), 1000.0).first()
    assert not poor.executable and poor.max_amount == 0.0 and poor.reason == "Insufficient funds"


def ticks(spark, prices):
    return spark.createDataFrame([(i, "K", "U", float(p)) for i, p in enumerate(prices)], "seq long, exchange string, coin string, price double")


def test_volatility(spark):
    values = [1.00, 1.001, 1.002, 1.001, 0.999, 1.001, 1.003, 1.002, 1.001, 1.000]
    assert rolling.latest_volatility(ticks(spark, values), 10).first().volatility == pytest.approx(0.0014131951125225157)
    assert rolling.volatility_factors(ticks(spark, values), window=10).first().factor == 0.05
    for few in ([1.0], [1.0, 1.1]):
        assert rolling.latest_volatility(ticks(spark, few)).first().volatility == 0.1
    assert rolling.latest_volatility(ticks(spark, [1.0, 1.0, 1.0])).first().volatility == 0.001
    import numpy as np

    r = np.array([-1.0, 0.1, 1.2 / 1.1 - 1])
    assert rolling.latest_volatility(ticks(spark, [1.0, 0.0, 1.0, 1.1, 1.2])).first().volatility == pytest.approx(r.std())


def test_transfer_estimates(spark):
    times = [45, 50, 55, 60, 65, 70, 75, 80, 120, 150]
    rows = spark.createDataFrame([(i, "A", "x", "B", "y", float(t)) for i, t in enumerate(times)], "seq long, src_exchange string, src_coin string, dst_exchange string, dst_coin string, actual_time double")
    routes = spark.createDataFrame([("A", "x", "B", "y"), ("A", "x", "C", "y")], "src_exchange string, src_coin string, dst_exchange string, dst_coin string")
    r = {x.dst_exchange: x for x in rolling.transfer_estimates(rows, routes).collect()}
    assert r["B"].estimated_time == pytest.approx(136.5) and r["B"].average_time == 77.0 and r["C"].estimated_time == 60.0


def test_metrics(spark):
    rows = spark.createDataFrame([([("A", "x"), ("B", "y")], 0.010, 0.002, 0.008), ([("A", "x")], 0.011, 0.002, 0.009), ([], 0.012, 0.002, None)], "path array<struct<exchange: string, coin: string>>, predicted_profit double, predicted_cost double, actual_profit double")
    log = metrics.opportunity_log(rows)
    assert log.where("path_length = 2").first().exchanges == "A -> B"
    r = metrics.summary(log).first()
    assert r.total_opportunities == 3 and r.total_predicted_profit == pytest.approx(0.033) and r.avg_roi == pytest.approx(5.5) and r.median_roi == pytest.approx(5.5)
    assert r.total_actual_profit == pytest.approx(0.017) and r.avg_actual_profit == pytest.approx(0.0085) and r.success_rate == 1.0
    assert metrics.summary(log.where("false")).count() == 0


@pytest.mark.parametrize(("n", "var", "shortfall"), [(20, 0.0, 0.0), (40, 2.0, 0.5)])
def test_tail_statistics(spark, n, var, shortfall):
    rows = spark.range(n).selectExpr("cast(id as int) AS sim_id", "1L AS num_opportunities", "cast(id as double) AS total_profit", "cast(id as double) AS avg_profit", "true AS has_opportunities")
    r = simulate.statistics(rows).first()
    assert r.var_5 == var and r.expected_shortfall == shortfall and r.max_profit == n - 1


def test_backtest_counts_empty_snapshots(spark):
    panel = generate.historical_panel(spark, 2, ("A", "B"), ("USDT", "USDC"), seed=1)
    assert panel.count() == 48 * 4
    result = simulate.run_backtest(panel, "ts", 2)
    r = simulate.backtest_metrics(result).first()
    assert r.timestamps == 48 and r.total_opportunities == 0 and r.avg_profit == 0.0
    assert simulate.backtest_metrics(result.where("false")).count() == 0


def test_rules(spark):
    rows = spark.createDataFrame([("Kraken", "USDT", "USDC", 1.0), ("Kraken", "USDT", "USDT", 1.0), ("Coinbase", "USDT", "USDC", 1.0), ("Coinbase", "USDT", "USDT", 1.0)], "exchange string, src_coin string, dst_coin string, amount double")
    got = {(r.exchange, r.dst_coin): (r.fee, r.transfer_time) for r in rules.transfer_terms(rows, rules.venue_rules(spark)).collect()}
    assert got == {("Kraken", "USDC"): (0.002, 60.0), ("Kraken", "USDT"): (0.0, 180.0), ("Coinbase", "USDC"): (0.005, 45.0), ("Coinbase", "USDT"): (0.0, 120.0)}


def test_quotes(spark):
    bodies = [
        ("Kraken", "usdt", "USDTUSD", '{"error":[],"result":{"USDTUSD":{"c":["1.0001","2"]}}}', 1.0001),
        ("Kraken", "usdt", "OTHER", '{"error":[],"result":{"USDTUSD":{"c":["1.5"]}}}', 1.5),
        ("Kraken", "usdt", "USDTUSD", '{"error":["x"],"result":{"USDTUSD":{"c":["1.5"]}}}', None),
        ("Kraken", "usdt", "USDTUSD", '{"error":[],"result":{"USDTUSD":{"c":["?"]}}}', None),
        ("Coinbase", "dai", "p", '{"data":{"rates":{"USD":"1.0002"}}}', 1.0002),
        ("Coinbase", "dai", "p", '{"data":{"amount":"0.99"}}', 0.99),
        ("Coinbase", "dai", "p", '{"errors":[{"message":"m"}]}', None),
        ("Coinbase", "dai", "p", "not json", None),
    ]
    rows = spark.createDataFrame([b[:4] for b in bodies], "exchange string, coin string, pair string, body string")
    assert sorted(r.price for r in quotes.parse_quotes(rows).collect()) == sorted(b[4] for b in bodies if b[4])


def test_quote_source_reports_failures(spark, monkeypatch):
    reader = quotes.QuoteReader({"venues": "Kraken", "pause": "0"})
    monkeypatch.setattr(reader, "fetch", lambda url: (quotes.NETWORK, None))
    rows = list(reader.read(reader.partitions()[0]))
    assert len(rows) == 4 and {r[3] for r in rows} == {quotes.NETWORK}


def test_files(spark, tmp_path):
    log = spark.createDataFrame([("a", 1.5)], "name string, value double")
    assert files.write_csv(log, str(tmp_path / "log")) and not files.write_csv(log.where("false"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    assert files.read_csv(spark, str(tmp_path / "log"), "name string, value double").collect() == log.collect()
    empty = log.where("false")
    assert files.write_sheets(spark, str(tmp_path / "s1"), empty, empty, empty, empty) == ["Info"]
    assert files.write_sheets(spark, str(tmp_path / "s2"), empty, empty, log, empty) == ["Algorithm Performance", "Summary"]


def test_generators_do_not_depend_on_partitions(spark):
    a = generate.adversarial_market(spark, seed=3)[1].repartition(7).orderBy("src", "dst").collect()
    b = generate.adversarial_market(spark, seed=3)[1].coalesce(1).orderBy("src", "dst").collect()
    assert a == b and all(0.001 <= r.fee <= 0.05 for r in a)
    assert generate.market_nodes(spark, 2, 9, 1.0, 0.01, 1).count() == 6  # three coins at most
