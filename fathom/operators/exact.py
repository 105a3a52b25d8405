"""Best-first search in exact order: start nodes, pairs or snapshots are dealt over tasks (Arrow).

Needed where the order of visits decides the result: the heuristic looks only at the last edge, so the cycle kept for
a (node, depth) need not be the cheapest. Entries are ordered by (priority, cost, place where the node was first met,
path), in astar_optimized by (priority, place, cost, path); the places make all ties definite.

A graph of up to MOST_EDGES edges (for cycles, of those that pass the gate) goes to every task. Of a larger one each search
gets its own part: the edges on walks of up to max_depth steps from its start to its target, found by layers of joins
from both ends. Nodes that no such walk passes can't take part in a result, and leaving them out changes neither the order
of the others nor the places' order, so both ways give the same rows. A task then holds one search's part at a time.

Edges may have a column ``factor``, the price risk's weight for steps along them (edge_factors() takes it from the rolling
volatility of the node that the step leaves); without it, or where it is null, ``factor`` of the call holds.
"""

from __future__ import annotations

import heapq
import warnings
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import TIME_RISK_PER_SECOND, VOLATILITY_FACTOR, admissible
from fathom.operators.tables import stored

ALGORITHMS = ("dijkstra", "astar", "weighted_astar", "astar_optimized")
WEIGHT = 1.5


def resolve(algorithm: str, strict: bool = False) -> str:
    """The algorithm of a name; unknown names mean Dijkstra. ``strict``: only 'astar' is not Dijkstra."""
    if strict:
        return "astar" if algorithm == "astar" else "dijkstra"
    if algorithm not in ALGORITHMS:
        warnings.warn(f"unknown algorithm {algorithm!r}, using dijkstra", stacklevel=2)
        return "dijkstra"
    return algorithm


def heuristic_share(algorithm: str, weight: float = WEIGHT) -> float:
    return {"dijkstra": 0.0, "weighted_astar": weight}.get(algorithm, 1.0)


def best_first(prices: dict, out_edges: dict, start: int, target: int | None, max_depth: int, share: float, indexed: bool = False) -> list[tuple]:
    """Cycles through ``start`` if ``target`` is None (gated, one for each depth), else the first path to ``target``:
    (depth, cost, path). ``out_edges``: for each node its (target, weight, time, factor) in order."""
    places, met = {start: 0}, [start]
    goal = start if target is None else target
    heap = [(0.0, (0, 0.0) if indexed else (0.0, 0), (0,))]
    closed, found = set(), []
    while heap:
        _, tie, path = heapq.heappop(heap)
        cost, node, depth = tie[indexed], met[path[-1]], len(path) - 1
        arrived = depth > 0 and node == goal
        if arrived and target is not None:
            return [(depth, cost, [met[i] for i in path])]
        if (node, depth) in closed:
            continue
        closed.add((node, depth))
        if arrived:
            found.append((depth, cost, [met[i] for i in path]))
        elif depth < max_depth:
            here = prices[node]
            for to, weight, time, factor in out_edges.get(node, ()):
                if target is None and not here - prices[to] > weight:
                    continue
                if to not in places:
                    places[to] = len(met)
                    met.append(to)
                ahead = prices[to if target is None else target]
                risk = time * TIME_RISK_PER_SECOND + abs(here - ahead) * factor
                spent, place = cost + weight, places[to]
                heapq.heappush(heap, (spent + share * risk, (place, spent) if indexed else (spent, place), (*path, place)))
    return found


ARC = ["edge_seq", "src", "dst", "weight", "transfer_time", "factor", "src_now", "dst_now"]


def edge_factors(edges: DataFrame, factors: DataFrame) -> DataFrame:
    """``edges`` with a column ``factor``: that of the node a step leaves, from rows of exchange, coin and factor; null without."""
    own = factors.select(F.col("exchange").alias("src_exchange"), F.col("coin").alias("src_coin"), "factor")
    return edges.drop("factor").join(own, ["src_exchange", "src_coin"], "left")


def _arcs(nodes: DataFrame, edges: DataFrame, keys: list[str], factor: float, gated: bool) -> DataFrame:
    """Edges in their order with both ends' present prices; ``gated``: those that a cycle may follow."""
    seq = F.col("edge_seq") if "edge_seq" in edges.columns else F.col("src").cast("long") * (1 << 31) + F.col("dst")
    own = F.coalesce(F.col("factor").cast("double"), F.lit(factor)) if "factor" in edges.columns else F.lit(factor)
    price = lambda at: nodes.select(*keys, F.col("node_id").alias(at), F.col("price").alias(f"{at}_now"))
    out = edges.select(*keys, seq.alias("edge_seq"), "src", "dst", "weight", "transfer_time", own.alias("factor"))
    out = out.join(price("src"), [*keys, "src"]).join(price("dst"), [*keys, "dst"])
    return (out.where(admissible("src_now", "dst_now", "weight")) if gated else out).select(*[F.col(k).alias(k) for k in keys], *ARC)  # columns of its own, for joins with ``nodes``


def _graph(arcs: pd.DataFrame) -> tuple[dict, dict]:
    prices = dict(zip(arcs["src"], arcs["src_now"])) | dict(zip(arcs["dst"], arcs["dst_now"]))
    out = defaultdict(list)
    for e in arcs.sort_values("edge_seq").itertuples():
        out[e.src].append((e.dst, e.weight, e.transfer_time, e.factor))
    return prices, out


def _reached(ends: DataFrame, arcs: DataFrame, keys: list[str], at: str, to: str, name: str, hops: int) -> DataFrame:
    """keys, end, node, hops of all nodes within so many steps of each end, with their least number; ``at`` and ``to`` are the
    edges' columns that a step leaves and enters."""
    step = arcs.select(*keys, F.col(at).alias("node"), F.col(to).alias("next")).distinct()
    seen = layer = ends.select(*keys, name, F.col(name).alias("node"), F.lit(0).alias(f"{name}_hops"))
    for k in range(1, hops + 1):
        new = layer.join(step, [*keys, "node"]).select(*keys, name, F.col("next").alias("node")).distinct()
        layer = stored(new.join(seen, [*keys, name, "node"], "left_anti").withColumn(f"{name}_hops", F.lit(k)), "search-layer")
        if not layer.take(1):
            break
        seen = seen.unionByName(layer)
    return seen


def _parts(pairs: DataFrame, arcs: DataFrame, keys: list[str], max_depth: int) -> DataFrame:
    """For each (start, target) of ``pairs`` the edges on walks of up to max_depth steps between them."""
    arcs = stored(arcs, "search-edges")
    pairs = stored(pairs, "search-pairs")
    fore = _reached(pairs.select(*keys, "start").distinct(), arcs, keys, "src", "dst", "start", max_depth - 1)
    back = _reached(pairs.select(*keys, "target").distinct(), arcs, keys, "dst", "src", "target", max_depth - 1)
    left = stored(pairs.join(fore, [*keys, "start"]).withColumnRenamed("node", "src"), "search-fore")
    on_way = left.join(arcs, [*keys, "src"]).join(back.withColumnRenamed("node", "dst"), [*keys, "target", "dst"])
    return on_way.where(F.col("start_hops") + F.col("target_hops") < max_depth).select(*keys, "start", "target", *ARC)


def _broadcast(arcs: DataFrame):
    """The graph, sent to each task, or None where it has over MOST_EDGES edges."""
    rows = arcs.limit(MOST_EDGES + 1).toPandas()
    return None if len(rows) > MOST_EDGES else arcs.sparkSession.sparkContext.broadcast(_graph(rows))


FOUND = "start int, depth int, total_cost double, net_profit double, path array<int>"
WAY = "start int, target int, depth int, total_cost double, path array<int>"


def exact_cycles(nodes: DataFrame, edges: DataFrame, algorithm: str = "astar", max_depth: int = 10, factor: float = VOLATILITY_FACTOR, weight: float = WEIGHT, snapshot: str | None = None, starts: list[int] | None = None) -> DataFrame:
    """[snapshot,] start, depth, total_cost, net_profit, path. Edges follow edge_seq, else (src, dst). Snapshots, or the starts of one
    graph, are dealt over tasks; the starts of larger graphs and snapshots with their own parts."""
    name, keys = resolve(algorithm), [snapshot] if snapshot else []
    options = (max_depth, heuristic_share(name, weight), name == "astar_optimized")
    fields = ", ".join([*(f"{k} {t}" for k, t in nodes.dtypes if k in keys), FOUND])
    wanted = nodes if starts is None else nodes.where(F.col("node_id").isin(starts))
    wanted = wanted.select(*keys, F.col("node_id").alias("start"), F.col("price").alias("start_price"))
    arcs = _arcs(nodes, edges, keys, factor, gated=True)
    names = [*keys, "start", "depth", "total_cost", "net_profit", "path"]

    def search(graph: tuple, begin, key: tuple = ()) -> list[tuple]:
        rows = []
        for start, price in begin:
            for depth, cost, path in best_first(graph[0] | {start: price}, graph[1], start, None, *options):
                profit = price - price * (1 + cost)
                if profit > 0:
                    rows.append((*key, start, depth, cost, profit, path))
        return rows

    if not snapshot:
        graph = _broadcast(arcs)
        if graph:

            def dealt(parts):
                for part in parts:
                    yield pd.DataFrame(search(graph.value, zip(part["start"], part["start_price"])), columns=names)

            parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            return wanted.repartition(parts, "start").mapInPandas(dealt, fields)
    elif (arcs.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= MOST_EDGES:

        def whole(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            left = left.sort_values("start")
            key = tuple(left[k].iloc[0] for k in keys) if len(left) else ()
            return pd.DataFrame(search(_graph(right), zip(left["start"], left["start_price"]), key), columns=names)

        return wanted.groupBy(*keys).cogroup(arcs.groupBy(*keys)).applyInPandas(whole, fields)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        key, start = tuple(part[k].iloc[0] for k in keys), part["start"].iloc[0]
        return pd.DataFrame(search(_graph(part), [(start, part["start_price"].iloc[0])], key), columns=names)

    parts = _parts(wanted.select(*keys, "start", F.col("start").alias("target")), arcs, keys, max_depth)
    return parts.join(wanted, [*keys, "start"]).groupBy(*keys, "start").applyInPandas(one, fields)


def exact_paths(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, algorithm: str = "astar", max_depth: int = 10, factor: float = VOLATILITY_FACTOR, weight: float = WEIGHT) -> DataFrame:
    """start, target, depth, total_cost, path for the pairs (start, target) that are connected. Pairs are dealt out, those of larger
    graphs with their own parts."""
    name = resolve(algorithm)
    options = (max_depth, heuristic_share(name, weight), name == "astar_optimized")
    arcs = _arcs(nodes, edges, [], factor, gated=False)
    pairs = pairs.select("start", "target")
    columns = ["start", "target", "depth", "total_cost", "path"]
    graph = _broadcast(arcs)
    if graph:

        def run(parts):
            prices, out_edges = graph.value
            for part in parts:
                rows = []
                for start, target in zip(part["start"], part["target"]):
                    if start in prices and target in prices:  # else no edge is there
                        rows += [(start, target, *x) for x in best_first(prices, out_edges, start, target, *options)]
                yield pd.DataFrame(rows, columns=columns)

        return pairs.mapInPandas(run, WAY)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        start, target, n = part["start"].iloc[0], part["target"].iloc[0], part["n"].iloc[0]
        rows = [(start, target, *x) for x in best_first(*_graph(part), start, target, *options)]
        return pd.DataFrame(rows * n, columns=columns)

    counted = pairs.groupBy("start", "target").agg(F.count("*").alias("n"))
    return _parts(counted.select("start", "target"), arcs, [], max_depth).join(counted, ["start", "target"]).groupBy("start", "target").applyInPandas(one, WAY)


MOST_EDGES = 2_000_000
