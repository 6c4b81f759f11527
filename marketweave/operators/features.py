"""Strictly trailing price, volume and order-flow features: one shuffle by ticker for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.functions.scalars import safe_ratio
from marketweave.functions.windows import gated, series, trailing

BASE = ["dev_price", "dev_volume", "order_flow"]
EXTRA = ["dev_price_60", "ret_5", "vol_20", "clv_5", "amihud"]
FUNDAMENTAL = ["ebitda_growth", "nd_ebitda", "fcfe_to_ebitda"]
#: Features that are bounded by construction and never winsorised.
BOUNDED = {"order_flow", "clv_5"}
EPSILON = 1e-6


def feature_columns(extra: list[str] | None = None, fundamentals: bool = False) -> list[str]:
    """Active features in order; unknown extras raise."""
    unknown = set(extra or []) - set(EXTRA)
    if unknown:
        raise ValueError(f"unknown features {sorted(unknown)}")
    return [*BASE, *(extra or []), *(FUNDAMENTAL if fundamentals else [])]


def winsor_columns(active: list[str]) -> list[str]:
    return [c for c in active if c not in BOUNDED]


def rolling_vwap(n: int) -> Column:
    """Volume-weighted average close of the n bars before."""
    value = F.col("close") * F.col("volume")
    return safe_ratio(gated(F.sum, value, n), gated(F.sum, F.col("volume"), n))


def dev_price(n: int) -> Column:
    vwap = rolling_vwap(n)
    return safe_ratio(F.col("close") - vwap, vwap) * 100.0


def dev_volume(n: int = 20) -> Column:
    """Log of the volume over the trailing median, both raised by a millionth of the trailing mean."""
    v = F.col("volume")
    eps = EPSILON * gated(F.avg, v, n)
    ratio = safe_ratio(v + eps, gated(lambda x: F.percentile(x, 0.5), v, n) + eps)
    return F.when(ratio > 0, F.ln(ratio))


def clv() -> Column:
    """Close location in the bar's range, in [-1, 1]."""
    return safe_ratio(2.0 * F.col("close") - F.col("high") - F.col("low"), F.col("high") - F.col("low") + EPSILON)


def tick() -> Column:
    return F.signum(F.col("close") - F.lag("close").over(series()))


def order_flow(mode: str = "hybrid") -> Column:
    if mode == "clv":
        return clv()
    if mode == "tick":
        return tick()
    if mode != "hybrid":
        raise ValueError("mode must be clv, tick or hybrid")
    return F.when(F.col("high") > F.col("low"), clv()).otherwise(tick())


def ret_1() -> Column:
    return safe_ratio(F.col("close"), F.lag("close").over(series())) - 1.0


def compute_features(bars: DataFrame, mode: str = "hybrid") -> DataFrame:
    """bars: ticker, date, open, high, low, close, volume -> ticker, date, close, volume and all features."""
    first = bars.withColumn("ret_1", ret_1()).withColumn("clv_now", clv())
    lag = lambda k: F.lag("close", k).over(series())
    illiquid = safe_ratio(F.abs(F.col("ret_1")), F.col("close") * F.col("volume"))
    return first.select(
        "ticker", "date", "close", "volume",
        dev_price(20).alias("dev_price"), dev_volume().alias("dev_volume"), order_flow(mode).alias("order_flow"), dev_price(60).alias("dev_price_60"),
        ((safe_ratio(lag(1), lag(6)) - 1.0) * 100.0).alias("ret_5"),
        (gated(F.stddev_samp, F.col("ret_1"), 20) * 100.0).alias("vol_20"),
        gated(F.avg, F.col("clv_now"), 5).alias("clv_5"),
        (gated(F.avg, illiquid, 20) * 1e6).alias("amihud"),
    )


def first_trading_day(panel: DataFrame, unit: str = "month") -> DataFrame:
    """Rows of the first date of each month in the whole panel."""
    days = panel.groupBy(F.date_trunc(unit, "date").alias("_m")).agg(F.min("date").alias("date")).select("date")
    return panel.join(days, "date", "left_semi")


__all__ = ["BASE", "EXTRA", "FUNDAMENTAL", "clv", "compute_features", "dev_price", "dev_volume", "feature_columns", "first_trading_day", "order_flow", "ret_1", "rolling_vwap", "tick", "trailing", "winsor_columns"]
