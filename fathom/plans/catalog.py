"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom import functions as X
from fathom.operators import build, evaluate, exact, graph, metrics, rolling, search, simulate, wallet
from fathom.plans import market as M
from fathom.plans import runs
from fathom.sources import files, generate, quotes, rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NODE = """customers AS (
  SELECT r_name AS exchange, c_mktsegment AS coin, CAST(c_acctbal AS DECIMAL(18,2)) AS amount
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), node AS (
  SELECT CAST(row_number() OVER (ORDER BY exchange, coin) - 1 AS INTEGER) AS node_id, exchange, coin,
         1e0 + (CAST(sum(amount) AS DOUBLE) / count(*) - 4500e0) / 100000e0 AS price
  FROM customers GROUP BY exchange, coin
)"""
PAIR = """pair AS (
  SELECT s.node_id AS src, d.node_id AS dst, s.exchange AS src_exchange, s.coin AS src_coin, s.price AS src_price,
         d.exchange AS dst_exchange, d.coin AS dst_coin, d.price AS dst_price
  FROM node s JOIN node d ON s.node_id <> d.node_id
)"""
EDGE = """costed AS (
  SELECT *, ((src * 7 + dst * 13) % 11 - 3) * 1e-3 AS fee, abs(src_price - dst_price) * 1e-3 AS volatility_cost,
         CAST(30 + (src * 17 + dst * 29) % 271 AS DOUBLE) AS transfer_time
  FROM pair
), edge AS (SELECT *, fee + volatility_cost AS weight FROM costed)"""
GRAPH = f"WITH {NODE}, {PAIR}, {EDGE}"
EDGE_COLUMNS = "src, dst, src_exchange, src_coin, src_price, dst_exchange, dst_coin, dst_price, fee, volatility_cost, transfer_time, weight"
TICK = "tick AS (SELECT event_id, ts, event_type AS exchange, CAST(user_id % 5 AS VARCHAR) AS coin, value AS price FROM events)"
BALANCE = """balance AS (
  SELECT exchange, coin, CAST(sum(amount) AS DOUBLE) / 100e0 AS balance FROM customers
  JOIN (SELECT exchange, coin, node_id FROM node) USING (exchange, coin) GROUP BY exchange, coin, node_id HAVING node_id % 6 <> 5
)"""
STOP = """stop AS (
  SELECT a.node_id AS path_id, n.exchange, n.coin, k.hop
  FROM node a, (VALUES (0, 0), (1, 7), (2, 0)) k(hop, step) JOIN node n ON true WHERE n.node_id = (a.node_id + k.step) % 25
)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def graph_of(spark, d):
    n = M.nodes(spark, d)
    return n, M.edges(n)


# ---- nodes and edges


@query("nodes_build", f"WITH {NODE} SELECT * FROM node")
def nodes_build(spark, d):
    return M.nodes(spark, d)


@query("nodes_upsert_last_wins", """WITH o AS (SELECT o_orderkey AS seq, 'E' || (o_custkey % 7) AS exchange, 'C' || (o_custkey % 5) AS coin, o_totalprice AS price FROM orders),
 m AS (SELECT exchange, coin, arg_max(price, seq) AS price, min(seq) AS f FROM o GROUP BY 1, 2)
 SELECT CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS node_id, exchange, coin, price FROM m""")
def nodes_upsert_last_wins(spark, d):
    o = M.table(spark, d, "orders")
    return graph.upsert_nodes(o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("E"), (F.col("o_custkey") % 7).cast("string")).alias("exchange"), F.concat(F.lit("C"), (F.col("o_custkey") % 5).cast("string")).alias("coin"), F.col("o_totalprice").alias("price")), spread=True)


DENSE = "SELECT src, dst, src_exchange, src_coin, src_price, dst_exchange, dst_coin, dst_price, fee, v AS volatility_cost, time AS transfer_time, fee + v AS weight"


@query("edges_dense", f"WITH {NODE}, {PAIR}, c AS (SELECT *, 2e-3 AS fee, abs(src_price - dst_price) * 1e-3 AS v, 60e0 AS time FROM pair) {DENSE} FROM c")
def edges_dense(spark, d):
    return build.dense_edges(M.nodes(spark, d))


@query("edges_dense_venue_rules", f"""WITH {NODE}, {PAIR}, c AS (SELECT *, CASE WHEN src_exchange NOT IN ('ASIA', 'EUROPE') THEN 2e-3 WHEN src_coin = dst_coin THEN 0e0 WHEN src_exchange = 'ASIA' THEN 2e-3 ELSE 5e-3 END AS fee,
 abs(src_price - dst_price) * 1e-3 AS v, CASE WHEN src_exchange NOT IN ('ASIA', 'EUROPE') THEN 60e0 WHEN src_exchange = 'ASIA' THEN CASE WHEN src_coin = dst_coin THEN 180e0 ELSE 60e0 END WHEN src_coin = dst_coin THEN 120e0 ELSE 45e0 END AS time FROM pair) {DENSE} FROM c""")
def edges_dense_venue_rules(spark, d):
    names = {"Kraken": "ASIA", "Coinbase": "EUROPE"}
    own = rules.venue_rules(spark).replace(names, subset=["exchange"])
    return build.dense_edges(M.nodes(spark, d), own)


@query("edges_sparse_k", f"""{GRAPH} SELECT {EDGE_COLUMNS} FROM edge QUALIFY row_number() OVER (PARTITION BY src ORDER BY CASE WHEN src_exchange = dst_exchange THEN 0 ELSE 1 END, dst) <= 10""")
def edges_sparse_k(spark, d):
    return M.costed(build.sparse_pairs(M.nodes(spark, d), 10))


@query("edges_sparse_feasible", f"""{GRAPH} SELECT {EDGE_COLUMNS} FROM edge WHERE src_exchange = dst_exchange OR dst_exchange NOT IN (SELECT exchange FROM node WHERE node_id % 3 = 0)
 OR (dst_exchange, dst_coin) IN (SELECT (exchange, coin) FROM node WHERE node_id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY src ORDER BY CASE WHEN src_exchange = dst_exchange THEN 0 ELSE 1 END, dst) <= 8""")
def edges_sparse_feasible(spark, d):
    n = M.nodes(spark, d)
    return M.costed(build.sparse_pairs(n, 8, n.where("node_id % 3 = 0 AND exchange <> 'none'")))


@query("feasible_transfers", f"""{GRAPH} SELECT src, dst FROM edge WHERE src_exchange = dst_exchange OR dst_exchange NOT IN (SELECT exchange FROM node WHERE node_id % 3 = 0)
 OR (dst_exchange, dst_coin) IN (SELECT (exchange, coin) FROM node WHERE node_id % 3 = 0)""")
def feasible_transfers(spark, d):
    n, e = graph_of(spark, d)
    return build.feasible(e, n.where("node_id % 3 = 0 AND exchange <> 'none'")).select("src", "dst")


FIAT_NODE = "fiat AS (SELECT node_id, exchange, CASE coin WHEN 'BUILDING' THEN 'USD' WHEN 'MACHINERY' THEN 'eur' ELSE coin END AS coin, CASE WHEN coin IN ('BUILDING', 'MACHINERY') THEN 1e0 ELSE price END AS price FROM node)"


def fiat_nodes(spark, d):
    n = M.nodes(spark, d)
    money = F.col("coin").isin("BUILDING", "MACHINERY")
    coin = F.when(F.col("coin") == "BUILDING", "USD").when(F.col("coin") == "MACHINERY", "eur").otherwise(F.col("coin"))
    return n.select("node_id", "exchange", coin.alias("coin"), F.when(money, 1.0).otherwise(F.col("price")).alias("price"))


@query("edges_fiat", f"""WITH {NODE}, {FIAT_NODE}, {PAIR.replace('FROM node s JOIN node d', 'FROM fiat s JOIN fiat d')},
 k AS (SELECT *, upper(src_coin) IN ('USD', 'EUR') AS sf, upper(dst_coin) IN ('USD', 'EUR') AS df FROM pair),
 c AS (SELECT *, CASE WHEN NOT sf AND NOT df THEN 2e-3 WHEN sf <> df THEN 1e-3 ELSE 15e-4 END AS fee, CASE WHEN NOT sf AND NOT df THEN 1e-3 ELSE 1e-4 END AS v, CASE WHEN sf <> df THEN 0e0 ELSE 60e0 END AS time
 FROM k WHERE (NOT sf AND NOT df) OR (sf <> df AND src_exchange = dst_exchange) OR (sf AND df AND src_coin = dst_coin AND src_exchange <> dst_exchange)) {DENSE} FROM c""")
def edges_fiat(spark, d):
    return build.fiat_edges(fiat_nodes(spark, d))


@query("fiat_flag", f"WITH {NODE}, {FIAT_NODE} SELECT node_id, coin, upper(coin) IN ('USD', 'EUR') AS is_fiat FROM fiat")
def fiat_flag(spark, d):
    return fiat_nodes(spark, d).select("node_id", "coin", X.is_fiat("coin").alias("is_fiat"))


@query("fiat_nodes_supported", f"""WITH {NODE}, money AS (SELECT DISTINCT exchange, 'USD' AS coin FROM node UNION ALL SELECT 'ASIA', 'EUR')
 SELECT * FROM node UNION ALL SELECT CAST(24 + row_number() OVER (ORDER BY exchange, coin) AS INTEGER), exchange, coin, 1e0 FROM money""")
def fiat_nodes_supported(spark, d):
    own = spark.createDataFrame([("ASIA", "USD"), ("ASIA", "EUR")], "exchange string, fiat string")
    return build.fiat_nodes(M.nodes(spark, d), own, spread=True)


@query("fiat_bridge_paths", f"""WITH {NODE}, {FIAT_NODE} SELECT a.exchange AS src_exchange, c.exchange AS dst_exchange, a.node_id || '->' || b.node_id || '->' || c.node_id || '->' || e.node_id AS path
 FROM fiat a JOIN fiat b ON a.exchange = b.exchange AND b.coin = 'USD' JOIN fiat c ON c.coin = 'USD' AND c.exchange <> b.exchange JOIN fiat e ON e.exchange = c.exchange AND e.coin = 'FURNITURE' WHERE a.coin = 'AUTOMOBILE'""")
def fiat_bridge_paths(spark, d):
    return build.fiat_bridge_paths(fiat_nodes(spark, d), "AUTOMOBILE", "FURNITURE").withColumn("path", F.array_join("path", "->"))


@query("transfer_terms", """SELECT o_orderkey, exchange, src_coin, dst_coin, CASE WHEN src_coin = dst_coin THEN 0e0 ELSE o_totalprice * CASE exchange WHEN 'Kraken' THEN 2e-3 ELSE 5e-3 END END AS fee,
 CASE WHEN exchange = 'Kraken' THEN CASE WHEN src_coin = dst_coin THEN 180e0 ELSE 60e0 END ELSE CASE WHEN src_coin = dst_coin THEN 120e0 ELSE 45e0 END END AS transfer_time
 FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 'Kraken' ELSE 'Coinbase' END AS exchange, 'C' || (o_custkey % 3) AS src_coin, 'C' || (o_orderkey % 3) AS dst_coin FROM orders)""")
def transfer_terms(spark, d):
    o = M.table(spark, d, "orders")
    c = lambda x: F.concat(F.lit("C"), (F.col(x) % 3).cast("string"))
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "Kraken").otherwise("Coinbase").alias("exchange"), c("o_custkey").alias("src_coin"), c("o_orderkey").alias("dst_coin"), F.col("o_totalprice").alias("amount"))
    return rules.transfer_terms(rows, rules.venue_rules(spark)).drop("amount")


@query("price_update_join", f"WITH {NODE} SELECT node_id, exchange, coin, CASE WHEN node_id % 2 = 0 THEN price * 1.5e0 ELSE price END AS price FROM node")
def price_update_join(spark, d):
    n = M.nodes(spark, d)
    return graph.update_prices(n, updates(n))


def updates(n):
    new = n.where("node_id % 2 = 0")
    unknown = new.select(F.lit(9).alias("seq"), F.lit("nowhere").alias("exchange"), "coin", "price")
    rows = [new.select(F.lit(s).alias("seq"), "exchange", "coin", (F.col("price") * f).alias("price")) for s, f in ((1, 9.0), (2, 1.5))]
    return rows[0].unionByName(rows[1]).unionByName(unknown)


@query("edges_after_price_update_stale", f"{GRAPH} SELECT src, dst, CASE WHEN src % 2 = 0 THEN src_price * 1.5e0 ELSE src_price END AS new_src_price, weight FROM edge")
def edges_after_price_update_stale(spark, d):
    n, e = graph_of(spark, d)
    new = graph.update_prices(n, updates(n)).select(F.col("node_id").alias("src"), F.col("price").alias("new_src_price"))
    return e.join(new, "src").select("src", "dst", "new_src_price", "weight")


@query("edge_volatility_update", f"{GRAPH} SELECT src, dst, CASE WHEN src = 3 THEN 5e-4 ELSE volatility_cost END AS volatility_cost, fee + CASE WHEN src = 3 THEN 5e-4 ELSE volatility_cost END AS weight FROM edge")
def edge_volatility_update(spark, d):
    return graph.update_volatility_cost(graph_of(spark, d)[1], F.col("src") == 3, 0.0005).select("src", "dst", "volatility_cost", "weight")


@query("edges_fk_violations", f"{GRAPH} SELECT src, dst FROM edge WHERE src % 5 = 0 OR dst % 5 = 0")
def edges_fk_violations(spark, d):
    n, e = graph_of(spark, d)
    return graph.foreign_key_violations(e, n.where("node_id % 5 <> 0")).select("src", "dst")


@query("admissible_edges", f"{GRAPH} SELECT {EDGE_COLUMNS} FROM edge WHERE src_price - dst_price > weight")
def admissible_edges(spark, d):
    return search.gate(graph_of(spark, d)[1])


@query("heuristic_values", f"{GRAPH} SELECT src, dst, transfer_time * 1e-3 + abs(src_price - dst_price) * 1e-1 AS h FROM edge")
def heuristic_values(spark, d):
    return graph_of(spark, d)[1].select("src", "dst", X.heuristic("transfer_time", "src_price", "dst_price").alias("h"))


@query("frontier_one_hop", f"{GRAPH} SELECT src AS start, dst AS node, weight AS cost FROM edge WHERE src_price - dst_price > weight")
def frontier_one_hop(spark, d):
    n, e = graph_of(spark, d)
    starts = n.select(F.col("node_id").alias("start"), F.lit(-1).alias("target"))
    return search.layers(starts, search.gate(e), 1, [], F.lit(True)).select("start", "node", "cost")


@query("graph_statistics", f"""{GRAPH} SELECT count(*) AS num_nodes, (SELECT count(*) FROM edge) AS num_edges, count(DISTINCT exchange) AS num_exchanges, count(DISTINCT coin) AS num_coins,
 string_agg(DISTINCT exchange, ',' ORDER BY exchange) AS exchanges, string_agg(DISTINCT coin, ',' ORDER BY coin) AS coins, round(avg(price), 9) AS avg_price FROM node""")
def graph_statistics(spark, d):
    return graph.statistics(*graph_of(spark, d))


# ---- searches


def layer_sql(depth: int, start: str, step: str, ends: str) -> str:
    """CTEs f1.. of the frontier, cheapest path for each (start, target, node), and ``ended``."""
    out, before = [], start
    for k in range(1, depth + 1):
        out.append(f"""f{k} AS (SELECT start, target, dst AS node, cost + weight AS cost, list_append(path, dst) AS path FROM {before} JOIN {step} ON node = src
 QUALIFY row_number() OVER (PARTITION BY start, target, dst ORDER BY cost + weight, list_append(path, dst)) = 1)""")
        before = f"(SELECT * FROM f{k} WHERE NOT ({ends}))"
    union = " UNION ALL ".join(f"SELECT *, {k} AS depth FROM f{k} WHERE {ends}" for k in range(1, depth + 1))
    return ",\n".join([*out, f"ended AS ({union})"])


def cycle_sql(depth: int, graph: str = GRAPH, nodes: str = "node") -> str:
    return f"""{graph}, step AS (SELECT src, dst, weight FROM edge WHERE src_price - dst_price > weight),
f0 AS (SELECT node_id AS start, node_id AS target, node_id AS node, 0e0 AS cost, [node_id] AS path FROM {nodes}),
{layer_sql(depth, "f0", "step", "node = target")},
found AS (SELECT e.start, CAST(e.depth AS INTEGER) AS depth, e.cost AS total_cost, n.price - n.price * (1e0 + e.cost) AS net_profit, e.path, n.exchange, n.coin FROM ended e JOIN {nodes} n ON n.node_id = e.start WHERE n.price - n.price * (1e0 + e.cost) > 0)"""


CYCLE = "start, depth, total_cost, net_profit, array_to_string(path, '->') AS path"
PASSED = "passed AS (SELECT f.*, p.target FROM found f, LATERAL (SELECT DISTINCT unnest(f.path) AS target) p)"


def texts(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.array_join("path", "->"))


def found(spark, d, depth):
    n, e = graph_of(spark, d)
    return search.cycles(n, e, depth), n


for _depth in (3, 5):
    query(f"cycles_layered_d{_depth}", f"{cycle_sql(_depth)} SELECT {CYCLE} FROM found")(lambda spark, d, depth=_depth: texts(found(spark, d, depth)[0]))


@query("cycles_single_start", f"{cycle_sql(5)} SELECT {CYCLE} FROM found WHERE start = 6")
def cycles_single_start(spark, d):
    n, e = graph_of(spark, d)
    return texts(search.cycles(n, e, 5, starts=n.where("node_id = 6").select(F.col("node_id").alias("start"))))


DENSE_GRAPH = f"WITH {NODE}, {PAIR}, edge AS (SELECT *, 2e-3 + abs(src_price - dst_price) * 1e-3 AS weight FROM pair)"
MONEY = f"""WITH {NODE}, fnode AS (SELECT * FROM node UNION ALL SELECT CAST((SELECT max(node_id) FROM node) + row_number() OVER (ORDER BY exchange) AS INTEGER), exchange, 'USD', 1e0 FROM (SELECT DISTINCT exchange FROM node)),
 {PAIR.replace('FROM node s JOIN node d', 'FROM fnode s JOIN fnode d')}, k AS (SELECT *, src_coin = 'USD' AS sf, dst_coin = 'USD' AS df FROM pair),
 edge AS (SELECT *, CASE WHEN NOT sf AND NOT df THEN 3e-3 WHEN sf <> df THEN 11e-4 ELSE 16e-4 END AS weight FROM k WHERE (NOT sf AND NOT df) OR (sf <> df AND src_exchange = dst_exchange) OR (sf AND df AND src_exchange <> dst_exchange))"""


def market_size_sql(with_fiat: bool) -> str:
    graph, nodes = (MONEY, "fnode") if with_fiat else (DENSE_GRAPH, "node")
    return f"""SELECT * FROM ({cycle_sql(3, graph, nodes)}, {PASSED} SELECT {str(with_fiat).lower()} AS with_fiat, (SELECT count(*) FROM {nodes}) AS num_nodes, (SELECT count(*) FROM edge) AS num_edges,
 (SELECT count(*) FROM passed p JOIN {nodes} t ON t.node_id = p.target WHERE t.exchange <> p.exchange) AS num_opportunities)"""


@query("fiat_market_size", f"{market_size_sql(False)} UNION ALL {market_size_sql(True)}")
def fiat_market_size(spark, d):
    return runs.fiat_demo(M.nodes(spark, d), max_depth=3)


@query("cycle_costs_nonneg_empty", f"{cycle_sql(3, DENSE_GRAPH)} SELECT {CYCLE} FROM found")
def cycle_costs_nonneg_empty(spark, d):
    n = M.nodes(spark, d)
    return texts(search.cycles(n, build.dense_edges(n), 3))


PLAIN = f"{GRAPH}, step AS (SELECT src, dst, abs(fee) + volatility_cost AS weight FROM edge)"
WAY = "start, target, total_cost, array_to_string(path, '->') AS path, CAST(depth AS INTEGER) AS depth"


@query("shortest_path_layered", f"""{PLAIN}, f0 AS (SELECT a.node_id AS start, b.node_id AS target, a.node_id AS node, 0e0 AS cost, [a.node_id] AS path FROM node a JOIN node b ON b.node_id = (a.node_id + 11) % 25 OR b.node_id = a.node_id),
{layer_sql(4, "f0", "step", "node = target")}, best AS (SELECT start, target, cost AS total_cost, path, depth FROM ended QUALIFY row_number() OVER (PARTITION BY start, target ORDER BY cost, depth, path) = 1) SELECT {WAY} FROM best""")
def shortest_path_layered(spark, d):
    n, e = graph_of(spark, d)
    pairs = n.select(F.col("node_id").alias("start"), F.explode(F.array((F.col("node_id") + 11) % M.NODES, "node_id")).alias("target"))
    return texts(search.shortest_paths(pairs, e.withColumn("weight", F.abs("fee") + F.col("volatility_cost")), 4))


@query("two_level_opportunities", f"""{cycle_sql(5)}, {PASSED} SELECT p.start, p.depth, p.total_cost, p.net_profit, array_to_string(p.path, '->') AS path, p.target,
 p.exchange || '(' || p.coin || ') -> ' || t.exchange || '(' || t.coin || ')' AS description FROM passed p JOIN node t ON t.node_id = p.target WHERE t.exchange <> p.exchange""")
def two_level_opportunities(spark, d):
    f, n = found(spark, d, 5)
    return texts(search.two_level(f, n))


@query("all_pairs_compare", f'{cycle_sql(5)}, {PASSED} SELECT start AS "first", target AS "second", depth, total_cost, net_profit, array_to_string(path, \'->\') AS path FROM passed WHERE target > start')
def all_pairs_compare(spark, d):
    return texts(search.compare_pairs(*found(spark, d, 5)))


@query("top5_opportunities", f"{cycle_sql(5)} SELECT {CYCLE} FROM found ORDER BY net_profit DESC, start, depth LIMIT 5")
def top5_opportunities(spark, d):
    return texts(found(spark, d, 5)[0].orderBy(F.desc("net_profit"), "start", "depth").limit(5))


@query("opportunity_record", f"""{cycle_sql(5)} SELECT exchange || '(' || coin || ')' AS start_node, exchange || '(' || coin || ')' AS end_node, CAST(len(path) AS INTEGER) AS path_length, net_profit, total_cost,
 net_profit / (SELECT price FROM node WHERE node_id = start) AS profit_margin FROM found""")
def opportunity_record(spark, d):
    return evaluate.opportunity_records(*found(spark, d, 5))


@query("path_evaluation", f"""{GRAPH}, hop AS (SELECT a.node_id AS path_id, CASE k WHEN 0 THEN a.node_id ELSE (a.node_id + 7) % 25 END AS src, CASE k WHEN 0 THEN (a.node_id + 7) % 25 ELSE (a.node_id + 9) % 25 END AS dst, k FROM node a, range(2) r(k)),
 w AS (SELECT path_id, k, coalesce(weight, 0e0) * 100e0 AS w FROM hop LEFT JOIN edge USING (src, dst)),
 c AS (SELECT path_id, max(CASE k WHEN 0 THEN w END) + max(CASE k WHEN 1 THEN w END) AS cost FROM w GROUP BY path_id),
 e AS (SELECT path_id, (a.price - b.price) * 100e0 AS diff, cost, a.price AS p FROM c JOIN node a ON a.node_id = path_id JOIN node b ON b.node_id = (path_id + 9) % 25)
 SELECT path_id, diff AS price_difference, cost AS total_cost, diff - cost AS net_profit, (diff - cost) / (p * 100e0) * 100 AS roi, diff - cost > 0 AS profitable, CAST(NULL AS VARCHAR) AS error FROM e""")
def path_evaluation(spark, d):
    n, e = graph_of(spark, d)
    at = lambda k: F.pmod(F.col("node_id") + k, F.lit(M.NODES))
    paths = n.select(F.col("node_id").alias("path_id"), F.array("node_id", at(7), at(9)).alias("path"))
    return evaluate.evaluate_paths(paths, n, e, 100.0)


for _name in exact.ALGORITHMS:
    query(f"search_exact_{_name}")(lambda spark, d, a=_name: texts(exact.exact_cycles(*graph_of(spark, d), algorithm=a, max_depth=5)))


def exact_paths(spark, d, algorithm):
    n, e = graph_of(spark, d)
    pairs = n.select(F.col("node_id").alias("start"), ((F.col("node_id") + 11) % M.NODES).alias("target"))
    return texts(exact.exact_paths(n, e.withColumn("weight", F.abs("fee") + F.col("volatility_cost")), pairs, algorithm, 4))


EXACT_PATH = f"""{PLAIN}, f0 AS (SELECT node_id AS start, (node_id + 11) % 25 AS target, node_id AS node, 0e0 AS cost, [node_id] AS path FROM node),
{layer_sql(4, "f0", "step", "node = target")}, best AS (SELECT start, target, cost AS total_cost, path, depth FROM ended QUALIFY row_number() OVER (PARTITION BY start, target ORDER BY cost, depth, path) = 1)
SELECT start, CAST(target AS INTEGER) AS target, round(total_cost, 12) AS total_cost FROM best"""
for _name in exact.ALGORITHMS:
    query(f"path_exact_{_name}")(lambda spark, d, a=_name: exact_paths(spark, d, a))


# Which cycle or which of equally cheap paths is kept follows the order of visits; that there is one, and Dijkstra's cost, does not.
@query("search_exact_depths", f"{cycle_sql(5)} SELECT algorithm, start, depth FROM found CROSS JOIN (VALUES ('dijkstra'), ('astar')) a(algorithm)")
def search_exact_depths(spark, d):
    n, e = graph_of(spark, d)
    found = [exact.exact_cycles(n, e, a, 5).select(F.lit(a).alias("algorithm"), "start", "depth") for a in ("dijkstra", "astar")]
    return found[0].unionByName(found[1])


@query("path_cost_dijkstra", EXACT_PATH)
def path_cost_dijkstra(spark, d):
    return exact_paths(spark, d, "dijkstra").select("start", "target", F.round("total_cost", 12).alias("total_cost"))


# ---- rolling statistics

ROLL = """moved AS (SELECT *, lag(price) OVER w AS before FROM tick WINDOW w AS (PARTITION BY exchange, coin ORDER BY ts, event_id)),
 stepped AS (SELECT *, CASE WHEN before > 0 THEN price / before - 1 END AS r FROM moved),
 rolled AS (SELECT *, CASE WHEN count(r) OVER w < 2 THEN 1e-1 ELSE greatest(stddev_pop(r) OVER w, 1e-3) END AS volatility FROM stepped
 WINDOW w AS (PARTITION BY exchange, coin ORDER BY ts, event_id ROWS BETWEEN 98 PRECEDING AND CURRENT ROW))"""
LATEST = f"WITH {TICK}, {ROLL}, latest AS (SELECT exchange, coin, volatility FROM rolled QUALIFY row_number() OVER (PARTITION BY exchange, coin ORDER BY ts DESC, event_id DESC) = 1)"


@query("rolling_volatility", f"WITH {TICK}, {ROLL} SELECT event_id, exchange, coin, price, round(volatility, 6) AS volatility FROM rolled")
def rolling_volatility(spark, d):
    return rolling.rolling_volatility(M.ticks(spark, d)).select("event_id", "exchange", "coin", "price", F.round("volatility", 6).alias("volatility"))


@query("volatility_latest_all", f"{LATEST} SELECT exchange, coin, round(volatility, 6) AS volatility FROM latest")
def volatility_latest_all(spark, d):
    return rolling.latest_volatility(M.ticks(spark, d)).withColumn("volatility", F.round("volatility", 6))


@query("volatility_factor", f"{LATEST} SELECT exchange, coin, round(1e-1 * greatest(volatility / 1e-2, 5e-1), 5) AS factor FROM latest")
def volatility_factor(spark, d):
    return rolling.volatility_factors(M.ticks(spark, d)).select("exchange", "coin", F.round("factor", 5).alias("factor"))


FACTOR = f"""{LATEST}, keyed AS (SELECT row_number() OVER (ORDER BY exchange, coin) - 1 AS node_id, 1e-1 * greatest(volatility / 1e-2, 5e-1) AS factor FROM latest), {GRAPH.removeprefix('WITH ')}"""


@query("heuristic_values_volatility", f"""{FACTOR} SELECT src, dst, round(factor, 5) AS factor, round(transfer_time * 1e-3 + abs(src_price - dst_price) * coalesce(factor, 1e-1), 6) AS h FROM edge LEFT JOIN keyed ON node_id = src""")
def heuristic_values_volatility(spark, d):
    n, e = graph_of(spark, d)
    rows = exact.edge_factors(e, M.node_factors(spark, d, n))
    h = F.col("transfer_time") * X.TIME_RISK_PER_SECOND + F.abs(F.col("src_price") - F.col("dst_price")) * F.coalesce("factor", F.lit(X.VOLATILITY_FACTOR))
    return rows.select("src", "dst", F.round("factor", 5).alias("factor"), F.round(h, 6).alias("h"))


@query("search_volatility_astar")
def search_volatility_astar(spark, d):
    n, e = graph_of(spark, d)
    return texts(exact.exact_cycles(n, exact.edge_factors(e, M.node_factors(spark, d, n)), "astar", 5))


@query("search_volatility_depths", f"{cycle_sql(5)} SELECT start, depth FROM found")
def search_volatility_depths(spark, d):
    return search_volatility_astar(spark, d).select("start", "depth")


CLEARED = LATEST.replace(TICK, f"{TICK.replace('tick AS', 'every AS', 1)}, tick AS (SELECT * FROM every WHERE ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM every))")


@query("volatility_after_clear", f"{CLEARED} SELECT exchange, coin, round(volatility, 6) AS volatility FROM latest")
def volatility_after_clear(spark, d):
    t = M.ticks(spark, d)
    cleared = t.agg(F.struct((F.max("seq.ts") - F.expr("INTERVAL 10 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("event_id")).alias("seq"))
    return rolling.latest_volatility(rolling.since_clear(t, cleared)).withColumn("volatility", F.round("volatility", 6))


LAST50 = f"WITH {TICK}, recent AS (SELECT exchange, coin, price FROM tick QUALIFY row_number() OVER (PARTITION BY exchange, coin ORDER BY ts DESC, event_id DESC) <= 50)"
PLACE = ["exchange", "coin"]


@query("transfer_p95", f"{LAST50} SELECT exchange, coin, round(quantile_cont(price, 0.95), 6) AS estimated_time FROM recent GROUP BY 1, 2")
def transfer_p95(spark, d):
    return rolling.transfer_estimates(M.transfers(spark, d), keys=PLACE).select(*PLACE, F.round("estimated_time", 6).alias("estimated_time"))


@query("transfer_avg", f"{LAST50} SELECT exchange, coin, round(avg(price), 6) AS average_time FROM recent GROUP BY 1, 2")
def transfer_avg(spark, d):
    return rolling.transfer_estimates(M.transfers(spark, d), keys=PLACE).select(*PLACE, F.round("average_time", 6).alias("average_time"))


@query("transfer_default_unseen", f"""{LAST50}, route AS (SELECT DISTINCT exchange, coin FROM tick UNION ALL SELECT 'unseen', '0')
 SELECT exchange, coin, coalesce(round(quantile_cont(price, 0.95), 6), 60e0) AS estimated_time, coalesce(round(avg(price), 6), 60e0) AS average_time FROM route LEFT JOIN recent USING (exchange, coin) GROUP BY 1, 2""")
def transfer_default_unseen(spark, d):
    t = M.transfers(spark, d)
    routes = t.select(*PLACE).distinct().unionByName(spark.createDataFrame([("unseen", "0")], "exchange string, coin string"))
    out = rolling.transfer_estimates(t, routes, keys=PLACE)
    return out.select(*PLACE, F.round("estimated_time", 6).alias("estimated_time"), F.round("average_time", 6).alias("average_time"))


# ---- wallet

TIER = "CASE WHEN {v} < 1000 THEN 1e-3 WHEN {v} < 10000 THEN 5e-4 WHEN {v} < 100000 THEN 2e-4 ELSE 1e-4 END"


@query("fee_tiers", f"SELECT o_orderkey, o_totalprice AS volume, {TIER.format(v='o_totalprice')} AS rate FROM orders")
def fee_tiers(spark, d):
    return M.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("volume"), X.tier_rate("o_totalprice").alias("rate"))


@query("fee_tier_override", f"""SELECT o_orderkey, o_orderpriority AS exchange, o_totalprice AS volume, CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_totalprice < 50000 THEN 3e-3 ELSE 1e-3 END ELSE {TIER.format(v='o_totalprice')} END AS rate FROM orders""")
def fee_tier_override(spark, d):
    own = spark.createDataFrame([("1-URGENT", 0.0, 0.003), ("1-URGENT", 50000.0, 0.001)], "exchange string, lower_bound double, rate double")
    rows = M.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("exchange"), F.col("o_totalprice").alias("volume"))
    return wallet.effective_rates(rows, own)


@query("udf_fee_schedule", "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 4e-3 ELSE 2e-3 END AS rate FROM orders")
def udf_fee_schedule(spark, d):
    rate = X.fee_schedule(lambda v: 0.004 if v < 100_000 else 0.002)
    return M.table(spark, d, "orders").select("o_orderkey", rate(F.col("o_totalprice")).alias("rate"))


HELD = f"WITH {NODE}, {BALANCE}, {STOP}, held AS (SELECT path_id, s.exchange, s.coin, coalesce(balance, 0e0) AS b FROM stop s LEFT JOIN balance USING (exchange, coin)), most AS (SELECT path_id, min(b) AS max_amount FROM held GROUP BY path_id)"


@query("wallet_can_execute", f"{HELD} SELECT path_id, bool_and(b >= 500) AS executable FROM held GROUP BY path_id")
def wallet_can_execute(spark, d):
    return wallet.can_execute(M.paths(M.nodes(spark, d)), M.balances(spark, d), 500.0)


@query("wallet_max_amount", f"{HELD} SELECT * FROM most")
def wallet_max_amount(spark, d):
    return wallet.executable_amounts(M.paths(M.nodes(spark, d)), M.balances(spark, d))


BEST = f"""tried AS (SELECT DISTINCT path_id, max_amount, v FROM most, LATERAL (SELECT unnest([0e0, least(1000e0, max_amount), least(10000e0, max_amount), least(100000e0, max_amount), max_amount]) AS v) t),
 rated AS (SELECT path_id, max_amount, v, {TIER.format(v='v')} AS rate FROM tried),
 net AS (SELECT path_id, max_amount, v, (path_id * 4e-4 - 1e-3 - (rate + rate + rate)) * v AS net FROM rated),
 best AS (SELECT path_id, max_amount, coalesce(max(CASE WHEN net > 0 THEN net END), 0e0) AS profit, coalesce(arg_min(v, (-net, v)) FILTER (net > 0), 0e0) AS volume FROM net GROUP BY path_id, max_amount)"""


@query("wallet_optimise_volume", f"{HELD}, {BEST} SELECT path_id, volume AS optimal_volume, round(profit, 9) AS optimal_profit FROM best")
def wallet_optimise_volume(spark, d):
    n = M.nodes(spark, d)
    o = M.offers(n).join(wallet.executable_amounts(M.paths(n), M.balances(spark, d)), "path_id").withColumnRenamed("max_amount", "funds")
    return wallet.optimise_volumes(o).withColumn("optimal_profit", F.round("optimal_profit", 9))


@query("wallet_verdict", f"""{HELD}, {BEST} SELECT path_id, max_amount >= 3000 AND profit > 0 AS executable, CASE WHEN max_amount >= 3000 THEN max_amount ELSE 0e0 END AS max_amount, CASE WHEN max_amount >= 3000 THEN volume ELSE 0e0 END AS optimal_volume,
 round(CASE WHEN max_amount >= 3000 THEN profit ELSE 0e0 END, 9) AS optimal_profit, CASE WHEN max_amount >= 3000 THEN 'Sufficient funds available' ELSE 'Insufficient funds' END AS reason FROM best""")
def wallet_verdict(spark, d):
    out = wallet.verdicts(M.offers(M.nodes(spark, d)), M.balances(spark, d), 3000.0)
    return out.withColumn("optimal_profit", F.round("optimal_profit", 9))


@query("wallet_balances_of", f"WITH {NODE}, {BALANCE} SELECT exchange, coin, coalesce(balance, 0e0) AS balance FROM node LEFT JOIN balance USING (exchange, coin)")
def wallet_balances_of(spark, d):
    return wallet.balances_of(M.balances(spark, d), M.nodes(spark, d).select("exchange", "coin"))


@query("fee_savings", f"""SELECT 'Kraken' AS exchange, v AS volume, {TIER.format(v='v')} AS rate, v * {TIER.format(v='v')} AS fee, 500e0 * 1e-3 - v * {TIER.format(v='v')} AS savings
 FROM (SELECT unnest([500e0, 1000e0, 5000e0, 10000e0, 50000e0, 100000e0, 200000e0]) AS v)""")
def fee_savings(spark, d):
    return runs.fee_savings(spark)


@query("wallet_summary", f"WITH {NODE}, {BALANCE} SELECT exchange, round(sum(balance), 4) AS total, count(*) AS positions FROM balance GROUP BY ROLLUP (exchange)")
def wallet_summary(spark, d):
    return wallet.summary(M.balances(spark, d)).withColumn("total", F.round("total", 4))


# ---- logs

LOG = """log AS (SELECT o_orderkey, o_totalprice / 1000e0 AS predicted_profit, CAST(o_orderkey % 7 AS DOUBLE) AS predicted_cost, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice / 1000e0 - 150e0 END AS actual_profit, o_orderpriority AS algorithm,
 CAST(o_orderkey % 100 AS INTEGER) AS nodes_explored, CAST(o_custkey % 25 AS INTEGER) AS graph_size, CAST(o_orderkey % 5 AS INTEGER) AS opportunities_found, (o_orderkey % 13) * 25e-2 AS search_time, o_custkey FROM orders),
 rated AS (SELECT *, CASE WHEN predicted_cost > 0 THEN predicted_profit / predicted_cost ELSE 0e0 END AS roi, CASE WHEN graph_size > 0 THEN CAST(nodes_explored AS DOUBLE) / graph_size ELSE 0e0 END AS exploration_rate FROM log)"""


@query("metrics_log", f"""WITH {LOG} SELECT o_orderkey, 3 AS path_length, 'E' || (o_custkey % 3) || ' -> E' || (o_custkey % 4) || ' -> E' || (o_custkey % 3) AS exchanges, 'C' || (o_orderkey % 3) || ' -> C' || (o_orderkey % 4) || ' -> C' || (o_orderkey % 3) AS coins,
 predicted_profit, predicted_cost, actual_profit, algorithm, roi FROM rated""")
def metrics_log(spark, d):
    rows = M.orders_log(spark, d).select("o_orderkey", "path", "predicted_profit", "predicted_cost", "actual_profit", "algorithm")
    return metrics.opportunity_log(rows)


@query("metrics_algo_log", f"WITH {LOG} SELECT o_orderkey, algorithm, search_time, nodes_explored, opportunities_found, graph_size, exploration_rate FROM rated")
def metrics_algo_log(spark, d):
    rows = M.orders_log(spark, d).select("o_orderkey", "algorithm", "search_time", "nodes_explored", "opportunities_found", "graph_size")
    return metrics.algorithm_log(rows)


@query("market_log", f"WITH {TICK} SELECT ts AS timestamp, exchange, coin, price, price / 100e0 AS volatility, CAST(NULL AS DOUBLE) AS spread FROM tick")
def market_log(spark, d):
    t = M.ticks(spark, d)
    return metrics.market_log(t.select(F.col("seq.ts").cast("timestamp_ntz").alias("timestamp"), "exchange", "coin", "price", (F.col("price") / 100.0).alias("volatility")))


SUMMARY = """count(*) AS total_opportunities, round(sum(predicted_profit), 2) AS total_predicted_profit, round(avg(predicted_profit), 6) AS avg_predicted_profit, round(avg(roi), 6) AS avg_roi, round(median(roi), 6) AS median_roi,
 round(sum(actual_profit), 2) AS total_actual_profit, round(avg(actual_profit), 6) AS avg_actual_profit, round(avg(CASE WHEN actual_profit IS NOT NULL THEN CAST(actual_profit > 0 AS INTEGER) END), 9) AS success_rate"""
DIGITS = {"total_predicted_profit": 2, "avg_predicted_profit": 6, "avg_roi": 6, "median_roi": 6, "total_actual_profit": 2, "avg_actual_profit": 6, "success_rate": 9, "max_roi": 6, "min_roi": 6}


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


@query("metrics_summary", f"WITH {LOG} SELECT {SUMMARY} FROM rated")
def metrics_summary(spark, d):
    return rounded(metrics.summary(metrics.opportunity_log(M.orders_log(spark, d))), DIGITS)


@query("metrics_summary_extremes", f"WITH {LOG} SELECT {SUMMARY}, round(max(roi), 6) AS max_roi, round(min(roi), 6) AS min_roi FROM rated")
def metrics_summary_extremes(spark, d):
    return rounded(metrics.summary(metrics.opportunity_log(M.orders_log(spark, d)), extremes=True), DIGITS)


@query("algorithm_averages", f"WITH {LOG} SELECT algorithm, count(*) AS runs, round(avg(opportunities_found), 6) AS avg_opportunities, round(avg(search_time), 6) AS avg_time, round(avg(exploration_rate), 6) AS avg_exploration FROM rated GROUP BY algorithm")
def algorithm_averages(spark, d):
    out = metrics.algorithm_averages(metrics.algorithm_log(M.orders_log(spark, d)))
    return rounded(out, {"avg_opportunities": 6, "avg_time": 6, "avg_exploration": 6})


# ---- snapshots and simulations

PANEL = """panel AS (SELECT date_trunc('day', ts) AS ts, event_type AS exchange, CAST(user_id % 5 AS VARCHAR) AS coin, 1e0 + (CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) - 50e0) / 10000e0 AS price FROM events GROUP BY 1, 2, 3),
 ids AS (SELECT exchange, coin, CAST(row_number() OVER (ORDER BY exchange, coin) - 1 AS INTEGER) AS node_id FROM (SELECT DISTINCT exchange, coin FROM panel)),
 pnode AS (SELECT CAST(ts AS TIMESTAMP) AS ts, node_id, exchange, coin, price FROM panel JOIN ids USING (exchange, coin)),
 pedge AS (SELECT s.ts, s.node_id AS src, d.node_id AS dst, s.price AS src_price, d.price AS dst_price, ((s.node_id * 7 + d.node_id * 13) % 11 - 3) * 1e-3 + abs(s.price - d.price) * 1e-3 AS weight, abs(s.price - d.price) * 1e-3 AS v
 FROM pnode s JOIN pnode d ON s.ts = d.ts AND s.node_id <> d.node_id)"""


@query("panel_edges", f"WITH {PANEL} SELECT ts, src, dst, 2e-3 + v AS weight FROM pedge")
def panel_edges(spark, d):
    n = simulate.panel_nodes(M.panel(spark, d), "ts", spread=True)
    return build.panel_edges(n, "ts").select("ts", "src", "dst", "weight")


def panel_layers(depth: int) -> str:
    out, before = [], "f0"
    for k in range(1, depth + 1):
        out.append(f"""f{k} AS (SELECT f.ts, start, s.dst AS node, cost + weight AS cost, list_append(path, s.dst) AS path FROM {before} f JOIN pstep s ON f.ts = s.ts AND node = src
 QUALIFY row_number() OVER (PARTITION BY f.ts, start, s.dst ORDER BY cost + weight, list_append(path, s.dst)) = 1)""")
        before = f"(SELECT * FROM f{k} WHERE node <> start)"
    return ",\n".join([*out, "ended AS (" + " UNION ALL ".join(f"SELECT * FROM f{k} WHERE node = start" for k in range(1, depth + 1)) + ")"])


BACKTEST = f"""WITH {PANEL}, pstep AS (SELECT * FROM pedge WHERE src_price - dst_price > weight), f0 AS (SELECT ts, node_id AS start, node_id AS node, 0e0 AS cost, [node_id] AS path FROM pnode),
{panel_layers(3)}, opp AS (SELECT e.ts, n.price - n.price * (1e0 + e.cost) AS profit, (SELECT count(*) FROM (SELECT DISTINCT unnest(e.path) AS p) x JOIN ids i ON i.node_id = x.p AND i.exchange <> n.exchange) AS k FROM ended e JOIN pnode n ON n.ts = e.ts AND n.node_id = e.start),
 perts AS (SELECT t.ts, CAST(coalesce(sum(CASE WHEN profit > 0 THEN k END), 0) AS BIGINT) AS num_opportunities, coalesce(sum(CASE WHEN profit > 0 THEN profit * k END), 0e0) AS total_profit, t.num_nodes FROM (SELECT ts, count(*) AS num_nodes FROM pnode GROUP BY ts) t LEFT JOIN opp o ON o.ts = t.ts GROUP BY t.ts, t.num_nodes)"""


def backtest(spark, d):
    p = M.panel(spark, d)
    return simulate.run_backtest(p, "ts", 3, M.edges(simulate.panel_nodes(p, "ts"), "ts"))


@query("backtest_per_ts", f"{BACKTEST} SELECT ts, num_opportunities, round(total_profit, 9) AS total_profit, num_nodes FROM perts")
def backtest_per_ts(spark, d):
    return backtest(spark, d).withColumn("total_profit", F.round("total_profit", 9))


@query("backtest_metrics", f"""{BACKTEST} SELECT count(*) AS timestamps, count(*) FILTER (num_opportunities > 0) AS timestamps_with_opportunities, CAST(sum(num_opportunities) AS BIGINT) AS total_opportunities, round(sum(total_profit), 8) AS total_profit,
 round(CAST(sum(num_opportunities) AS DOUBLE) / count(*), 9) AS avg_opportunities, round(CASE WHEN sum(num_opportunities) > 0 THEN sum(total_profit) / sum(num_opportunities) ELSE 0 END, 9) AS avg_profit FROM perts""")
def backtest_metrics(spark, d):
    return rounded(simulate.backtest_metrics(backtest(spark, d)), {"total_profit": 8, "avg_opportunities": 9, "avg_profit": 9})


def simulations(spark, d):
    o = M.table(spark, d, "orders")
    sims = o.select((F.col("o_custkey") % 40).cast("int").alias("sim_id")).distinct().unionByName(spark.range(40, 41).select(F.col("id").cast("int").alias("sim_id")))  # 40 is empty
    rows = o.select((F.col("o_custkey") % 40).cast("int").alias("sim_id"), ((F.col("o_totalprice") - 150000.0) / 1000.0).alias("net_profit"))
    return simulate.per_simulation(sims, rows)


SIM = """opp AS (SELECT CAST(o_custkey % 40 AS INTEGER) AS sim_id, (o_totalprice - 150000e0) / 1000e0 AS net_profit FROM orders),
 sim AS (SELECT s.sim_id, count(net_profit) AS num_opportunities, coalesce(sum(net_profit), 0e0) AS total_profit FROM (SELECT DISTINCT CAST(o_custkey % 40 AS INTEGER) AS sim_id FROM orders UNION ALL SELECT 40) s LEFT JOIN opp USING (sim_id) GROUP BY s.sim_id)"""


@query("backtest_graph_statistics", f"""WITH {PANEL}, e AS (SELECT ts, count(*) AS num_edges FROM pedge GROUP BY ts)
 SELECT CAST(p.ts AS TIMESTAMP) AS ts, count(*) AS num_nodes, coalesce(max(num_edges), 0) AS num_edges, count(DISTINCT exchange) AS num_exchanges, count(DISTINCT coin) AS num_coins, round(avg(price), 9) AS avg_price FROM pnode p LEFT JOIN e ON e.ts = p.ts GROUP BY p.ts""")
def backtest_graph_statistics(spark, d):
    nodes = simulate.panel_nodes(M.panel(spark, d), "ts")
    return rounded(simulate.snapshot_statistics(nodes, M.edges(nodes, "ts")), {"avg_price": 9})


@query("backtest_exact_astar")
def backtest_exact_astar(spark, d):
    p = M.panel(spark, d)
    return simulate.run_backtest(p, "ts", 3, M.edges(simulate.panel_nodes(p, "ts"), "ts"), "astar")


@query("mc_per_sim", f"WITH {SIM} SELECT sim_id, num_opportunities, round(total_profit, 4) AS total_profit, round(CASE WHEN num_opportunities > 0 THEN total_profit / num_opportunities ELSE 0 END, 6) AS avg_profit, num_opportunities > 0 AS has_opportunities FROM sim")
def mc_per_sim(spark, d):
    return rounded(simulations(spark, d), {"total_profit": 4, "avg_profit": 6})


@query("mc_statistics", f"""WITH {SIM}, ranked AS (SELECT total_profit, row_number() OVER (ORDER BY total_profit) - 1 AS i, count(*) OVER () AS n FROM sim)
 SELECT count(*) AS simulations, round((SELECT avg(CAST(num_opportunities > 0 AS INTEGER)) FROM sim), 9) AS success_rate, round(avg(total_profit), 4) AS avg_profit, (SELECT round(avg(num_opportunities), 6) FROM sim) AS avg_opportunities, round(sum(total_profit), 3) AS total_profit, round(max(total_profit), 4) AS max_profit, round(min(total_profit), 4) AS min_profit,
 round(max(CASE WHEN i = CAST(floor(n * 5e-2) AS BIGINT) AND n > 20 THEN total_profit END), 4) AS var_5, round(avg(CASE WHEN i < CAST(floor(n * 5e-2) AS BIGINT) THEN total_profit END), 4) AS expected_shortfall FROM ranked""")
def mc_statistics(spark, d):
    return rounded(simulate.statistics(simulations(spark, d)), {"success_rate": 9, "avg_profit": 4, "avg_opportunities": 6, "total_profit": 3, "max_profit": 4, "min_profit": 4, "var_5": 4, "expected_shortfall": 4})


# ---- sources


@query("json_quote_parse", """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Kraken' ELSE 'Coinbase' END AS exchange, 'C' || p_partkey AS coin, p_partkey + 5e-1 AS price FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0""")
def json_quote_parse(spark, d):
    return quotes.parse_quotes(M.quotes(spark, d))


@query("json_event_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_event_props(spark, d):
    return M.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("synthetic_graph")
def synthetic_graph(spark, d):
    return generate.synthetic_market(spark, seed=42)[1]


@query("adversarial_graph")
def adversarial_graph(spark, d):
    return generate.adversarial_market(spark, illiquid=True, seed=42)[1]


@query("historical_panel")
def historical_panel(spark, d):
    return generate.historical_panel(spark, 7, seed=42)


@query("mc_random_markets")
def mc_random_markets(spark, d):
    return simulate.statistics(runs.monte_carlo(spark, 50, seed=42))


@query("mc_stress_test")
def mc_stress_test(spark, d):
    return runs.stress_test(spark)


@query("algorithm_comparison")
def algorithm_comparison(spark, d):
    return runs.comparison_summary(runs.compare_algorithms(spark, markets=lambda s, e, c, seed: graph_of(s, d), runs=1, max_depth=4)).drop("avg_seconds")


@query("basic_experiment")
def basic_experiment(spark, d):
    return runs.basic_experiment(spark, markets=lambda s, e, c, seed: graph_of(s, d))


@query("adversarial_experiment")
def adversarial_experiment(spark, d):
    return texts(runs.adversarial_experiment(spark, markets=lambda s, e, c, seed: graph_of(s, d)))


@query("tick_days", """SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:00') AS hour, CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, CAST(date_diff('day', CAST(ts AS DATE), last_day(ts)) AS INTEGER) AS days_left, count(*) AS n FROM events GROUP BY ALL""")
def tick_days(spark, d):
    t = M.table(spark, d, "events")
    keys = [F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH:00").alias("hour"), F.dayofweek("ts").alias("weekday"), F.date_diff(F.last_day("ts"), F.to_date("ts")).alias("days_left")]
    return t.groupBy(*keys).agg(F.count("*").alias("n"))


@query("chart_points", "WITH a AS (SELECT o_orderpriority AS x, avg(o_totalprice) AS mean, max(o_totalprice) AS most FROM orders GROUP BY 1) SELECT x, 'mean' AS series, round(mean, 4) AS value FROM a UNION ALL SELECT x, 'most', round(most, 4) FROM a")
def chart_points(spark, d):
    a = M.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("most"))
    return rounded(files.chart_points(a, "o_orderpriority", "mean", "most"), {"value": 4})
