"""Column expressions: costs, gates, fee tiers, labels."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TIME_RISK_PER_SECOND = 0.001
VOLATILITY_FACTOR = 0.1
VOLATILITY_SCALE = 0.001
DEFAULT_FEE = 0.002
DEFAULT_TIME = 60.0
# Codes that count as fiat money.
FIAT_CODES = ("USD", "CAD", "EUR", "GBP", "JPY", "AUD", "CHF", "CNY", "HKD", "SGD", "NZD", "MXN", "BRL", "INR", "KRW", "TRY")
# Trading volume from which a rate holds.
DEFAULT_TIERS = ((0.0, 0.001), (1_000.0, 0.0005), (10_000.0, 0.0002), (100_000.0, 0.0001))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def edge_weight(fee="fee", volatility_cost="volatility_cost") -> Column:
    return col(fee) + col(volatility_cost)


def volatility_cost(source_price, target_price, scale: float = VOLATILITY_SCALE) -> Column:
    return F.abs(col(source_price) - col(target_price)) * F.lit(scale)


def heuristic(transfer_time, price, target_price, factor: float = VOLATILITY_FACTOR) -> Column:
    """Time risk of the edge plus price risk towards the target."""
    return col(transfer_time) * F.lit(TIME_RISK_PER_SECOND) + F.abs(col(price) - col(target_price)) * F.lit(factor)


def admissible(source_price, target_price, weight) -> Column:
    """The gate of cycle searches; a property of the edge alone."""
    return (col(source_price) - col(target_price)) > col(weight)


def cycle_profit(start_price, total_cost) -> Column:
    p = col(start_price)
    return p - p * (F.lit(1.0) + col(total_cost))


def ratio(above, below, otherwise: float = 0.0) -> Column:
    """above / below where below > 0, else ``otherwise``."""
    return F.when(col(below) > 0, col(above) / col(below)).otherwise(F.lit(otherwise))


def is_fiat(code) -> Column:
    return F.coalesce(F.upper(col(code)).isin(*FIAT_CODES), F.lit(False))


def label(exchange, coin) -> Column:
    return F.format_string("%s(%s)", col(exchange), col(coin))


def tier_rate(volume, tiers=DEFAULT_TIERS) -> Column:
    """The rate of the highest tier whose lower bound the volume reaches; below all tiers, the lowest tier's."""
    v, out = col(volume), None
    for bound, rate in sorted(tiers):
        out = F.lit(rate) if out is None else F.when(v >= bound, F.lit(rate)).otherwise(out)
    return out


def volatility_multiple(volatility, base: float = VOLATILITY_FACTOR, baseline: float = 0.01, least: float = 0.5) -> Column:
    """Adaptive risk factor: base times volatility over a baseline, floored, without an upper cap."""
    return F.lit(base) * F.greatest(col(volatility) / F.lit(baseline), F.lit(least))


def fee_schedule(rate_of: Callable[[float], float]) -> Callable[[Column], Column]:
    """A user's volume -> rate function as a column function, run over Arrow batches."""

    @F.pandas_udf("double")
    def apply(volume: pd.Series) -> pd.Series:
        return volume.map(rate_of, na_action="ignore").astype("float64")

    return apply
