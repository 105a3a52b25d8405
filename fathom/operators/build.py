"""Edge builders: dense, sparse (top k by source), fiat bridges, snapshots of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import DEFAULT_FEE, DEFAULT_TIME, VOLATILITY_SCALE, edge_weight, is_fiat, volatility_cost
from fathom.operators.tables import dense_numbers

COLUMNS = ["src", "dst", "src_exchange", "src_coin", "src_price", "dst_exchange", "dst_coin", "dst_price"]
COSTS = ["fee", "volatility_cost", "transfer_time", "weight"]


def sides(nodes: DataFrame, snapshot: str | None = None) -> tuple[DataFrame, DataFrame]:
    keep = [snapshot] if snapshot else []
    a = nodes.select(*keep, *[F.col(c).alias(f"src_{c}") for c in ("exchange", "coin", "price")], F.col("node_id").alias("src"))
    b = nodes.select(*keep, *[F.col(c).alias(f"dst_{c}") for c in ("exchange", "coin", "price")], F.col("node_id").alias("dst"))
    return a, b


def node_pairs(nodes: DataFrame, snapshot: str | None = None) -> DataFrame:
    """Ordered pairs of different nodes, within a snapshot where there are several. The result is the complete graph,
    so its size is the product by definition; snapshots are joined by key."""
    a, b = sides(nodes, snapshot)
    out = a.join(b, snapshot) if snapshot else a.join(b, F.col("src") != F.col("dst"))
    return out.where("src <> dst").select(*([snapshot] if snapshot else []), *COLUMNS)


def with_costs(pairs: DataFrame, fee, volatility, time) -> DataFrame:
    out = pairs.withColumn("fee", fee).withColumn("volatility_cost", volatility).withColumn("transfer_time", time)
    return out.withColumn("weight", edge_weight())


def dense_edges(nodes: DataFrame, rules: DataFrame | None = None, fee: float = DEFAULT_FEE, scale: float = VOLATILITY_SCALE, time: float = DEFAULT_TIME) -> DataFrame:
    """All ordered pairs. ``rules`` (exchange, cross_fee, same_coin_time, cross_time): the source exchange's fees and
    times; exchanges without a rule get the defaults."""
    return standard_costs(node_pairs(nodes), rules, fee, scale, time)


def sparse_market(nodes: DataFrame, k: int = 10, listings: DataFrame | None = None, rules: DataFrame | None = None, fee: float = DEFAULT_FEE, scale: float = VOLATILITY_SCALE, time: float = DEFAULT_TIME) -> DataFrame:
    """dense_edges() cut by sparse_edges(), without the dense edges."""
    return standard_costs(sparse_pairs(nodes, k, listings), rules, fee, scale, time)


def standard_costs(pairs: DataFrame, rules: DataFrame | None, fee: float, scale: float, time: float) -> DataFrame:
    volatility = volatility_cost("src_price", "dst_price", scale)
    if rules is None:
        return with_costs(pairs, F.lit(fee), volatility, F.lit(time))
    r = rules.select(F.col("exchange").alias("src_exchange"), "cross_fee", "same_coin_time", "cross_time", F.lit(True).alias("ruled"))
    same = F.col("src_coin") == F.col("dst_coin")
    ruled = pairs.join(r, "src_exchange", "left")
    own_fee = F.when(F.col("ruled"), F.when(same, 0.0).otherwise(F.col("cross_fee"))).otherwise(F.lit(fee))
    own_time = F.when(F.col("ruled"), F.when(same, F.col("same_coin_time")).otherwise(F.col("cross_time"))).otherwise(F.lit(time))
    return with_costs(ruled, own_fee, volatility, own_time).select(*COLUMNS, *COSTS)


def feasible(pairs: DataFrame, listings: DataFrame) -> DataFrame:
    """Pairs on one exchange, to an exchange without listings, or to a coin that the target exchange lists."""
    known = listings.select(F.col("exchange").alias("dst_exchange")).distinct().withColumn("known", F.lit(True))
    listed = listings.select(F.col("exchange").alias("dst_exchange"), F.col("coin").alias("dst_coin")).distinct().withColumn("listed", F.lit(True))
    out = pairs.join(known, "dst_exchange", "left").join(listed, ["dst_exchange", "dst_coin"], "left")
    ok = (F.col("src_exchange") == F.col("dst_exchange")) | F.col("known").isNull() | F.col("listed").isNotNull()
    return out.where(ok).select(*pairs.columns)


def sparse_edges(edges: DataFrame, k: int = 10, listings: DataFrame | None = None) -> DataFrame:
    """At most k of the given edges from each source: the own exchange first, then in node order."""
    if listings is not None:
        edges = feasible(edges, listings)
    near = (F.col("src_exchange") == F.col("dst_exchange")).cast("int")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(near.desc(), "dst"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def sparse_pairs(nodes: DataFrame, k: int = 10, listings: DataFrame | None = None) -> DataFrame:
    """What sparse_edges() keeps of the complete graph, from the nodes alone: n k rows are made, never n^2.

    A source's targets are the first of its own exchange's nodes, then the first reachable nodes of other exchanges. Only the
    first k + 1 nodes of an exchange can be the former. Of the first 2 k reachable nodes at most one exchange has more than
    k, so all others find k foreign ones among them, and that one finds them among the first k reachable nodes that aren't
    its own: two lists of 2 k and k nodes serve all sources, whatever the number of nodes."""
    target = F.struct(F.col("node_id").alias("dst"), F.col("exchange").alias("dst_exchange"), F.col("coin").alias("dst_coin"), F.col("price").alias("dst_price"))
    salts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # Within its exchange: the lists are copied, as one exchange may have most of the sources.
    first = nodes.withColumn("place", F.row_number().over(Window.partitionBy("exchange").orderBy("node_id"))).where(F.col("place") <= k + 1)
    near = first.groupBy("exchange").agg(F.array_sort(F.collect_list(target)).alias("near")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    open_ = nodes if listings is None else reachable(nodes, listings)
    ahead = open_.orderBy("node_id").limit(2 * k)
    # The exchange with more than k of these, if there is one.
    crowd = ahead.groupBy("exchange").agg(F.count("*").alias("n")).where(F.col("n") > k).select("exchange")
    beyond = open_.join(F.broadcast(crowd), "exchange", "left_anti").orderBy("node_id").limit(k)
    as_list = lambda df, name: df.agg(F.array_sort(F.collect_list(target)).alias(name))
    lists = as_list(ahead, "ahead").join(as_list(beyond, "beyond"), F.lit(True)).join(crowd.agg(F.max("exchange").alias("crowd")), F.lit(True))
    sources = nodes.withColumn("salt", F.pmod(F.xxhash64("node_id"), F.lit(salts)).cast("int"))
    rows = sources.join(near, ["exchange", "salt"]).join(F.broadcast(lists), F.lit(True))
    own = F.slice(F.filter("near", lambda x: x["dst"] != F.col("node_id")), 1, k)
    foreign = F.filter(F.when(F.col("exchange") == F.col("crowd"), F.col("beyond")).otherwise(F.col("ahead")), lambda x: x["dst_exchange"] != F.col("exchange"))
    rows = rows.withColumn("own", own).select(F.col("node_id").alias("src"), F.col("exchange").alias("src_exchange"), F.col("coin").alias("src_coin"), F.col("price").alias("src_price"), F.inline(F.concat("own", F.slice(foreign, F.lit(1), F.lit(k) - F.size("own")))))
    return rows.select(*COLUMNS)


def reachable(nodes: DataFrame, listings: DataFrame) -> DataFrame:
    """Nodes that other exchanges can send to: their exchange has no listings, or lists their coin."""
    known = listings.select("exchange").distinct().withColumn("known", F.lit(True))
    listed = listings.select("exchange", "coin").distinct().withColumn("listed", F.lit(True))
    out = nodes.join(known, "exchange", "left").join(listed, ["exchange", "coin"], "left")
    return out.where(F.col("known").isNull() | F.col("listed").isNotNull()).select(*nodes.columns)


def fiat_nodes(nodes: DataFrame, supported: DataFrame | None = None, default: str = "USD", spread: bool = False) -> DataFrame:
    """``nodes`` and a node of price 1 for each fiat currency of an exchange: those of ``supported`` (exchange, fiat), the
    default for exchanges without a row there. New ids follow the highest, by exchange and currency."""
    key = ["exchange", "coin"]
    wanted = nodes.select("exchange").distinct().withColumn("coin", F.lit(default))
    if supported is not None:
        wanted = wanted.join(supported, "exchange", "left_anti").unionByName(supported.select("exchange", F.col("fiat").alias("coin")).distinct())
    known = nodes.join(wanted.withColumn("money", F.lit(True)), key, "left").withColumn("price", F.when(F.col("money"), 1.0).otherwise(F.col("price")))
    first = nodes.agg(F.coalesce(F.max("node_id") + 1, F.lit(0)).alias("first"))
    new = dense_numbers(wanted.join(nodes, key, "left_anti"), key, "place", spread).join(F.broadcast(first), F.lit(True))
    new = new.select((F.col("first") + F.col("place")).cast("int").alias("node_id"), *key, F.lit(1.0).alias("price"))
    return known.select("node_id", *key, "price").unionByName(new)


def fiat_edges(nodes: DataFrame, fee: float = DEFAULT_FEE, scale: float = VOLATILITY_SCALE, time: float = DEFAULT_TIME, conversion_fee: float = 0.001, fiat_fee: float = 0.0015, between_fiat: bool = True, fiat_volatility: float = 0.0001) -> DataFrame:
    """Coin to coin at constant cost; coin to fiat money and back on one exchange; one fiat currency between exchanges."""
    pairs = node_pairs(nodes).withColumn("src_fiat", is_fiat("src_coin")).withColumn("dst_fiat", is_fiat("dst_coin"))
    same_exchange, same_coin = F.col("src_exchange") == F.col("dst_exchange"), F.col("src_coin") == F.col("dst_coin")
    coins = ~F.col("src_fiat") & ~F.col("dst_fiat")
    convert = (F.col("src_fiat") != F.col("dst_fiat")) & same_exchange
    wire = F.col("src_fiat") & F.col("dst_fiat") & same_coin & ~same_exchange & F.lit(between_fiat)
    rows = pairs.where(coins | convert | wire)
    return with_costs(
        rows,
        F.when(coins, fee).when(convert, conversion_fee).otherwise(F.lit(fiat_fee)),
        F.when(coins, scale).otherwise(F.lit(fiat_volatility)),
        F.when(convert, 0.0).otherwise(F.lit(time)),
    ).select(*COLUMNS, *COSTS)


def fiat_bridge_paths(nodes: DataFrame, start_coin: str, target_coin: str, fiat: str = "USD") -> DataFrame:
    """start coin -> fiat money on one exchange -> fiat money on another -> target coin there. Nodes only."""
    n = nodes.select("exchange", "coin", "node_id")
    side = lambda c, who, at: n.where(F.col("coin") == c).select(F.col("exchange").alias(at), F.col("node_id").alias(who))
    left = side(start_coin, "a", "here").join(side(fiat, "b", "here"), "here")
    right = side(fiat, "c", "there").join(side(target_coin, "d", "there"), "there")
    return left.join(right, F.col("here") != F.col("there")).select(F.col("here").alias("src_exchange"), F.col("there").alias("dst_exchange"), F.array("a", "b", "c", "d").alias("path"))


def panel_edges(nodes: DataFrame, snapshot: str, fee: float = DEFAULT_FEE, scale: float = VOLATILITY_SCALE, time: float = DEFAULT_TIME) -> DataFrame:
    """Dense edges of every snapshot in one equi-join."""
    return with_costs(node_pairs(nodes, snapshot), F.lit(fee), volatility_cost("src_price", "dst_price", scale), F.lit(time))
