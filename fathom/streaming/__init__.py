"""Rolling statistics of unbounded ticks and transfers: the last N values of each key as list state; nodes as keyed state.

The window counts rows, so there is no event time to wait for: rows of a micro-batch are taken in order of ``seq``,
batches in order of arrival. Over the same order the results equal those of operators.rolling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fathom.operators.rolling import DEFAULT_PERCENTILE, DEFAULT_VOLATILITY, LEAST_VOLATILITY, MARKET, PRICE_WINDOW, ROUTE, TRANSFER_WINDOW


def volatility_of(prices: np.ndarray) -> float:
    before, now = prices[:-1], prices[1:]
    good = before > 0
    returns = now[good] / before[good] - 1
    return DEFAULT_VOLATILITY if len(returns) < 2 else max(float(returns.std()), LEAST_VOLATILITY)


class LastValues(StatefulProcessor):
    """Keeps the last ``window`` values of a key; after each row gives ``figure`` of them."""

    def __init__(self, keys: list[str], value: str, window: int, figure: Callable[[np.ndarray], tuple]):
        self.keys, self.value, self.window, self.figure = keys, value, window, figure

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("last", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        held = [r[0] for r in self.state.get()] if self.state.exists() else []
        out = []
        for seq, value in zip(new["seq"], new[self.value]):
            held = [*held, float(value)][-self.window :]
            out.append((*key, seq, value, *self.figure(np.array(held))))
        self.state.put([(v,) for v in held])
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _run(rows: DataFrame, keys: list[str], value: str, window: int, figure, fields: str) -> DataFrame:
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"seq {types['seq']}", f"{value} double", fields])
    return rows.select(*keys, "seq", value).groupBy(*keys).transformWithStateInPandas(LastValues(keys, value, window, figure), outputStructType=schema, outputMode="Update", timeMode="None")


def streaming_volatility(ticks: DataFrame, window: int = PRICE_WINDOW, keys: list[str] | None = None) -> DataFrame:
    """Needs the RocksDB state store. Output mode update: a row for each tick."""
    return _run(ticks, keys or MARKET, "price", window, lambda x: (volatility_of(x),), "volatility double")


def streaming_transfer_estimates(transfers: DataFrame, percentile: float = DEFAULT_PERCENTILE, window: int = TRANSFER_WINDOW, keys: list[str] | None = None) -> DataFrame:
    return _run(transfers, keys or ROUTE, "actual_time", window, lambda x: (float(np.percentile(x, percentile)), float(x.mean())), "estimated_time double, average_time double")


class NodeState(StatefulProcessor):
    """One node for each (exchange, coin): its id and its price, which the last update by seq sets."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("node", "node_id int, price double, seq long")

    def handleInitialState(self, key, rows: pd.DataFrame, timerValues) -> None:
        for r in rows.itertuples():
            self.state.update((int(r.node_id), float(r.price), -(1 << 63)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).dropna(subset=["price"])
        if not self.state.exists() or new.empty:  # unknown keys are ignored
            return
        node, old, seq = self.state.get()
        last = new.sort_values("seq", kind="stable").iloc[-1]
        if last["seq"] < seq:  # an update that came late
            return
        self.state.update((node, float(last["price"]), int(last["seq"])))
        if last["price"] != old:
            yield pd.DataFrame([(node, *key, float(last["price"]), int(last["seq"]))])

    def close(self) -> None:
        pass


def streaming_prices(updates: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, exchange, coin, price, seq of every node whose price a batch of ``updates`` (seq long, exchange, coin, price) changed; over the
    same updates the last row of each node is that of graph.update_prices(). The state starts from ``nodes``, unknown keys are
    ignored, updates older than a node's last are, too. Needs the RocksDB state store; output mode update."""
    from fathom.operators.graph import KEY

    first = nodes.select(*KEY, "node_id", "price").groupBy(*KEY)
    keyed = updates.select(*KEY, F.col("seq").cast("long").alias("seq"), "price").groupBy(*KEY)
    return keyed.transformWithStateInPandas(NodeState(), outputStructType="node_id int, exchange string, coin string, price double, seq long", outputMode="Update", timeMode="None", initialState=first)


def changed_edges(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, new_price, seq and the columns of ``edges`` for the edges at changed nodes, either end: only these have to be searched again. Weights stay
    as they are, as in batches."""
    new = changed.select("node_id", F.col("price").alias("new_price"), "seq")
    out = new.join(edges, F.col("node_id") == F.col("src"))
    return out.unionByName(new.join(edges, F.col("node_id") == F.col("dst")))
