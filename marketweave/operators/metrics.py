"""Rank correlations, period marks, portfolios and cost-adjusted Sharpe ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.windows import average_rank, global_rank
from marketweave.operators.features import first_trading_day

UNITS = {"w": "week", "m": "month", "q": "quarter", "y": "year", "weekly": "week", "monthly": "month", "quarterly": "quarter", "annual": "year"}
MARK_HORIZON = {"week": 5, "month": 21, "quarter": 63, "year": 252}


def unit_of(freq: str) -> str:
    return UNITS.get(freq.lower(), freq.lower())


def _finite(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c))
    return df


def _correlation(x: Column, y: Column) -> Column:
    """Pearson's r, NULL with fewer than three rows or a constant side."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(F.lit(1)) >= 3, F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def rank_ic(df: DataFrame, score: str = "score", ret: str = "R30", by: list[str] | None = None) -> DataFrame:
    """Spearman's correlation with ties averaged over finite pairs: one row of each group (all rows without `by`): keys, n, ic."""
    rows = _finite(df, score, ret)
    if by:
        ranked = rows.withColumn("_x", average_rank(F.col(score), *by)).withColumn("_y", average_rank(F.col(ret), *by))
        return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _correlation(F.col("_x"), F.col("_y")).alias("ic"))
    ranked = global_rank(global_rank(rows, score, "_x"), ret, "_y")
    return ranked.agg(F.count(F.lit(1)).alias("n"), _correlation(F.col("_x"), F.col("_y")).alias("ic"))


def mean_and_error(series: DataFrame, col: str = "ic") -> DataFrame:
    """One row: n, mean and standard error of the non-missing values."""
    return series.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), (F.stddev_samp(col) / F.sqrt(F.nullif(F.count(col), F.lit(0)))).alias("se"))


def monthly_rank_ic(df: DataFrame, score: str = "score", ret: str = "R30") -> DataFrame:
    """date, ic on each month's first trading day, if three tickers have a row then."""
    days = first_trading_day(df)
    wide = days.groupBy("date").agg(F.countDistinct("ticker").alias("k")).where("k >= 3").select("date")
    return rank_ic(days.join(wide, "date", "left_semi"), score, ret, ["date"]).where("ic is not null").select("date", "ic")


def ewma_last(values: Column, span: int = 21) -> Column:
    """Last exponentially weighted mean of an ordered array, starting at its first value."""
    alpha = 2.0 / (span + 1)
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.try_element_at(values, F.lit(1)), lambda a, x: a * (1 - alpha) + x * alpha)


def period_marks(df: DataFrame, freq: str = "month", agg: str = "mean", score: str = "score", span: int = 21) -> DataFrame:
    """ticker, period (its first day), mark."""
    rows = df.where(F.col(score).isNotNull()).withColumn("period", F.date_trunc(unit_of(freq), "date").cast("date"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("date", F.col(score).alias("s")))), lambda r: r["s"])
    marks = {"mean": F.avg(score), "median": F.median(score), "last": F.max_by(score, "date"), "ewma": ewma_last(ordered, span)}
    if agg not in marks:
        raise ValueError(f"agg must be one of {sorted(marks)}")
    return rows.groupBy("ticker", "period").agg(marks[agg].alias("mark"))


def mark_forward(df: DataFrame, freq: str = "quarter", horizon: int | None = None, agg: str = "mean", score: str = "score") -> DataFrame:
    """ticker, period, mark, fwd: the mark and the first return of the period after."""
    unit = unit_of(freq)
    ret = f"R{horizon or MARK_HORIZON[unit]}"
    if ret not in df.columns:
        raise KeyError(ret)
    period = F.date_trunc(unit, "date").cast("date")
    before = {"week": F.date_sub(period, 7), "month": F.add_months(period, -1), "quarter": F.add_months(period, -3), "year": F.add_months(period, -12)}[unit]
    first = df.where(F.col(ret).isNotNull()).groupBy("ticker", before.alias("period")).agg(F.min_by(ret, "date").alias("fwd"))
    return period_marks(df, unit, agg, score).join(first, ["ticker", "period"])


def mark_rank_ic(df: DataFrame, freq: str = "quarter", horizon: int | None = None, agg: str = "mean", score: str = "score") -> DataFrame:
    """period, ic over periods with three tickers."""
    pairs = mark_forward(df, freq, horizon, agg, score)
    wide = pairs.groupBy("period").agg(F.countDistinct("ticker").alias("k")).where("k >= 3").select("period")
    return rank_ic(pairs.join(wide, "period", "left_semi"), "mark", "fwd", ["period"]).where("ic is not null").select("period", "ic")


def top_n_portfolio(df: DataFrame, top_n: int = 3, score: str = "score", ret: str = "R30", order: str = "ticker") -> DataFrame:
    """date, portfolio_return, n_picks, picks: the best of each month's first trading day; ties go by `order`; short months are left out."""
    days = first_trading_day(df).where(F.col(ret).isNotNull() & F.col(score).isNotNull())
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.col(score).desc(), F.col(order)))
    picks = days.withColumn("_k", place).where(F.col("_k") <= top_n)
    out = picks.groupBy("date").agg(F.avg(ret).alias("portfolio_return"), F.count(F.lit(1)).alias("n_picks"), F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("picks"), F.countDistinct("ticker").alias("_d"))
    return out.where(F.col("_d") >= top_n).drop("_d")


def net_sharpe(portfolio: DataFrame, costs: list[float], turnover_annual: float | None = None, by: list[str] | None = None, order: str = "date") -> DataFrame:
    """cost_bps, turnover_annual, sharpe of each cost tier (and group): yearly, after turnover costs; NULL without spread."""
    held = F.split("picks", ",")
    keys = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    last = F.lag("held").over(keys.orderBy(order))
    change = (F.size(F.array_except("held", "last")) + F.size(F.array_except("last", "held"))) / F.greatest(F.size("held"), F.lit(1))
    rows = portfolio.withColumn("held", held).withColumn("last", last).withColumn("change", F.when(F.col("last").isNotNull(), change))
    turnover = F.lit(turnover_annual) if turnover_annual is not None else F.coalesce(F.avg("change"), F.lit(0.0)) / 2.0 * 12.0
    stats = rows.groupBy(*(by or [])).agg(turnover.alias("turnover_annual"), F.avg("portfolio_return").alias("_m"), F.stddev_samp("portfolio_return").alias("_s"))
    cost = F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("cost_bps")
    tiers = stats.select(*(by or []), cost, "turnover_annual", "_m", "_s")
    excess = F.col("_m") - F.col("turnover_annual") / 12.0 * F.col("cost_bps") / 1e4
    return tiers.select(*(by or []), "cost_bps", "turnover_annual", F.when(F.col("_s") > 0, excess / F.col("_s") * F.sqrt(F.lit(12.0))).alias("sharpe"))


def fit_metrics(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """n, rmse, mae and dir_acc (share of rows on the same side of 50) of labelled rows; NULLs without any."""
    rows = _finite(df, score, label)
    e = F.col(score) - F.col(label)
    same = (F.signum(F.col(score) - 50.0) == F.signum(F.col(label) - 50.0)).cast("double")
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(same).alias("dir_acc"))
