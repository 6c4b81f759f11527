"""Forward excess returns, labels, winsor limits and the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.scalars import bounded_label, clip, safe_ratio
from marketweave.functions.windows import average_rank, cumulative, gated, series
from marketweave.operators.features import compute_features, winsor_columns
from marketweave.operators.fundamentals import attach_fundamentals, fill_fundamentals

HORIZONS = [5, 21, 30, 63, 252]


def target_horizons(horizons: list[int], primary: int) -> list[int]:
    return sorted({*horizons, primary})


def dividend_sums(dividends: DataFrame, horizons: list[int], by_paper: bool = False) -> DataFrame:
    """ticker, date, div_{h}: dividends with ex_date < date <= ex_date + h calendar days.

    Each dividend is laid on the days it reaches, once for all horizons, so that the interval join becomes an equi-join. `by_paper`
    turns the direction round: those that fall into (date, date + h].
    """
    k = F.explode(F.sequence(F.lit(1), F.lit(max(horizons)))).alias("k")
    laid = dividends.where("ex_date is not null").select("ticker", "ex_date", "dividend", k)
    day = F.date_sub("ex_date", F.col("k")) if by_paper else F.date_add("ex_date", F.col("k"))
    return laid.groupBy("ticker", day.alias("date")).agg(*[F.sum(F.when(F.col("k") <= h, F.col("dividend"))).alias(f"div_{h}") for h in horizons])


def compute_target(features: DataFrame, rates: DataFrame, dividends: DataFrame | None, horizons: list[int] | None = None) -> DataFrame:
    """features with rf_daily and R{h}: (close in h bars + dividends - close) / close less the next h rates; a missing rate empties its window."""
    horizons = horizons or HORIZONS
    df = features.join(rates.select("date", "rf_daily"), "date", "left")
    if dividends is not None:
        df = df.join(dividend_sums(dividends, horizons), ["ticker", "date"], "left")
    def forward(h: int) -> Column:
        paid = F.coalesce(F.col(f"div_{h}"), F.lit(0.0)) if dividends is not None else F.lit(0.0)
        rf = gated(F.sum, F.col("rf_daily"), h, series().rowsBetween(1, h))
        return safe_ratio(F.lead("close", h).over(series()) + paid - F.col("close"), F.col("close")) - rf
    return df.withColumns({f"R{h}": forward(h) for h in horizons}).drop(*[f"div_{h}" for h in horizons])


def pre_meeting(panel: DataFrame, meetings: DataFrame, days: int = 45) -> DataFrame:
    """panel with pre_agm: 1.0 in the `days` calendar days before one of the ticker's meetings. Meetings are laid on their days: an equi-join."""
    laid = meetings.select("ticker", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("k"), "agm_date")
    armed = laid.select("ticker", F.date_sub("agm_date", F.col("k")).alias("date")).distinct().withColumn("pre_agm", F.lit(1.0))
    return panel.join(armed, ["ticker", "date"], "left").withColumn("pre_agm", F.coalesce("pre_agm", F.lit(0.0)))


def between(start: str, end: str) -> Column:
    return F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def train_stats(panel: DataFrame, col: str, train: tuple[str, str]) -> DataFrame:
    """One row: mean, population std and n of the finite train values."""
    rows = panel.where(between(*train) & F.col(col).isNotNull() & ~F.isnan(col))
    return rows.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.count(col).alias("n"))


def winsor_limits(panel: DataFrame, columns: list[str], train: tuple[str, str], low: float = 1.0, high: float = 99.0) -> DataFrame:
    """One row: {column}_lo and {column}_hi, interpolated percentiles of the train window."""
    pct = lambda c, q, s: F.percentile(F.col(c), F.lit(q / 100.0)).alias(f"{c}_{s}")
    return panel.where(between(*train)).agg(*[pct(c, q, s) for c in columns for q, s in ((low, "lo"), (high, "hi"))])


def winsorise(panel: DataFrame, columns: list[str], train: tuple[str, str], low: float = 1.0, high: float = 99.0) -> DataFrame:
    """Columns clipped to their train percentiles; the limits are one row, so its broadcast has a fixed size."""
    limits = winsor_limits(panel, columns, train, low, high)
    out = panel.crossJoin(F.broadcast(limits)).withColumns({c: clip(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi")) for c in columns})
    return out.drop(*[f"{c}_{s}" for c in columns for s in ("lo", "hi")])


def tanh_labels(panel: DataFrame, columns: dict[str, str], train: tuple[str, str], scale: float = 15.0, peer_relative: bool = False, z_of: str | None = None) -> DataFrame:
    """columns: return -> label name. Bounded labels with the train window's moments, all from one aggregate row; z_of: a return whose z is kept as Z30."""
    values = {c: F.col(c) - F.avg(c).over(Window.partitionBy("date")) if peer_relative else F.col(c) for c in columns}
    df = panel.withColumns({f"_v_{c}": v for c, v in values.items()})
    stats = df.where(between(*train)).agg(*[f(F.col(f"_v_{c}")).alias(f"_{n}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    df = df.crossJoin(F.broadcast(stats))
    z = lambda c: (F.col(f"_v_{c}") - F.coalesce(f"_m_{c}", F.lit(0.0))) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    df = df.withColumns({label: bounded_label(z(c), scale) for c, label in columns.items()} | ({"Z30": z(z_of)} if z_of else {}))
    return df.drop(*[f"_{n}_{c}" for c in columns for n in "vms"])


def rank_label(panel: DataFrame, col: str, train: tuple[str, str]) -> DataFrame:
    """label: percentile of the value among the date's, in (0, 100]; on dates with fewer than two, its place among all train values."""
    count = F.count(col).over(Window.partitionBy("date"))
    df = panel.withColumn("_n", count).withColumn("label", average_rank(F.col(col), "date") / F.nullif(F.col("_n"), F.lit(0)) * 100.0)
    lone = df.where(F.col("_n") < 2).where(F.col(col).isNotNull()).select("ticker", "date", F.col(col).alias("x"), F.lit(0).cast("long").alias("w"))
    ref = panel.where(between(*train) & F.col(col).isNotNull()).groupBy(F.col(col).alias("x")).agg(F.count(F.lit(1)).alias("w"))
    place = ref.select(F.lit(None).cast("string").alias("ticker"), F.lit(None).cast("date").alias("date"), "x", "w").unionByName(lone)
    upto = cumulative(place, "x", "w", "c").where("ticker is not null")
    total = ref.agg(F.sum("w").alias("total"))
    ecdf = upto.crossJoin(F.broadcast(total)).select("ticker", "date", (F.coalesce("c", F.lit(0)) / F.col("total") * 100.0).alias("_fallback"))
    out = df.join(ecdf, ["ticker", "date"], "left")
    missing = F.when(F.col(col).isNull(), 100.0).otherwise(F.coalesce("_fallback", F.lit(50.0)))
    return out.withColumn("label", F.when(F.col("_n") >= 2, F.col("label")).otherwise(missing)).drop("_n", "_fallback")


def raw_panel(
    bars: DataFrame, rates: DataFrame, dividends: DataFrame | None, meetings: DataFrame, disclosures: DataFrame | None = None, horizons: list[int] | None = None, mode: str = "hybrid", lag_days: int = 90,
) -> DataFrame:
    """All features, targets, fundamentals and the flag: what panels of any active features are finished from."""
    df = compute_target(compute_features(bars, mode), rates, dividends, horizons or HORIZONS)
    if disclosures is not None:
        df = attach_fundamentals(df, disclosures, lag_days)
    return pre_meeting(df, meetings)


def finish_panel(df: DataFrame, train: tuple[str, str], split: tuple[str, str] | None = None, active: list[str] | None = None, fundamentals: bool = False, horizons: list[int] | None = None, winsor: bool = True) -> DataFrame:
    """Complete rows of a raw panel, fill, winsor, labels, then the split."""
    horizons = horizons or HORIZONS
    active = active or ["dev_price", "dev_volume", "order_flow"]
    df = df.na.drop(subset=[c for c in active if c not in ("ebitda_growth", "nd_ebitda", "fcfe_to_ebitda")])
    if fundamentals:
        df = fill_fundamentals(df)
    if winsor:
        df = winsorise(df, winsor_columns(active), train)
    primary = 30 if 30 in horizons else horizons[0]
    df = tanh_labels(df, {f"R{h}": f"Y_target_{h}" for h in horizons}, train, z_of=f"R{primary}").withColumn("Y_target", F.col(f"Y_target_{primary}"))
    return df.where(between(*split)) if split else df


def build_panel(
    bars: DataFrame, rates: DataFrame, dividends: DataFrame | None, meetings: DataFrame, train: tuple[str, str], split: tuple[str, str] | None = None,
    active: list[str] | None = None, disclosures: DataFrame | None = None, horizons: list[int] | None = None, mode: str = "hybrid", winsor: bool = True, lag_days: int = 90,
) -> DataFrame:
    """Features, targets, fundamentals, flag, complete rows, fill, winsor, labels, then the split: one lazy plan."""
    raw = raw_panel(bars, rates, dividends, meetings, disclosures, horizons, mode, lag_days)
    return finish_panel(raw, train, split, active, disclosures is not None, horizons, winsor)
