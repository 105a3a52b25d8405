"""Schemas of the engine's tables. Keys: a node is (exchange, coin); snapshot tables carry a snapshot column, too."""

from __future__ import annotations

NODES = "node_id int, exchange string, coin string, price double"
EDGES = "edge_seq long, src int, dst int, fee double, volatility_cost double, transfer_time double, weight double"
OPPORTUNITY = "start int, depth int, total_cost double, net_profit double, path array<int>"
TICKS = "seq long, exchange string, coin string, price double"
TRANSFERS = "seq long, src_exchange string, src_coin string, dst_exchange string, dst_coin string, actual_time double"
BALANCES = "exchange string, coin string, balance double"
FEE_TIERS = "exchange string, lower_bound double, rate double"
METRIC_OPPORTUNITY = (
    "timestamp timestamp_ntz, path_length int, exchanges string, coins string, predicted_profit double, predicted_cost double, "
    "actual_profit double, execution_time double, volatility double, roi double, algorithm string, search_time double, nodes_explored int"
)
METRIC_ALGORITHM = "timestamp timestamp_ntz, algorithm string, search_time double, nodes_explored int, opportunities_found int, graph_size int, exploration_rate double"
METRIC_MARKET = "timestamp timestamp_ntz, exchange string, coin string, price double, volatility double, spread double"
