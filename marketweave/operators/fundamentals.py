"""Point-in-time fundamentals: a backward as-of join by one window, imputation and the latest disclosure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.scalars import safe_ratio
from marketweave.operators.features import FUNDAMENTAL


def asof_backward(left: DataFrame, right: DataFrame, right_time: str, values: list[str]) -> DataFrame:
    """left (ticker, date) with the values of the ticker's last right row at or before the date: union and one window, no range join.

    The whole last row counts, NULLs included.
    """
    marker = F.struct(*values)
    events = right.select("ticker", F.col(right_time).alias("date"), F.lit(0).alias("_side"), marker.alias("_r"), *[F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in ("ticker", "date")])
    rows = left.withColumn("_side", F.lit(1)).withColumn("_r", F.lit(None).cast(events.schema["_r"].dataType))
    seen = Window.partitionBy("ticker").orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = events.unionByName(rows).withColumn("_r", F.last("_r", ignorenulls=True).over(seen)).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_r.{v}").alias(v) for v in values])


def effective_disclosures(disclosures: DataFrame, lag_days: int = 90) -> DataFrame:
    """One row per ticker and effective date (period end + lag), the annual one if several; with the ratios."""
    rows = disclosures.where("period_end is not null").withColumn("effective", F.date_add("period_end", lag_days))
    last = rows.groupBy("ticker", "effective").agg(F.max_by(F.struct("ebitda", "net_debt", "fcfe", "is_annual"), F.col("is_annual")).alias("r")).select("ticker", "effective", "r.*")
    return last.withColumn("nd_ebitda", safe_ratio(F.col("net_debt"), F.col("ebitda"))).withColumn("fcfe_to_ebitda", safe_ratio(F.col("fcfe"), F.col("ebitda")))


def annual_growth(effective: DataFrame) -> DataFrame:
    """ticker, effective, ebitda_growth over the annual row before."""
    before = F.lag("ebitda").over(Window.partitionBy("ticker").orderBy("effective"))
    return effective.where("is_annual").select("ticker", "effective", (safe_ratio(F.col("ebitda"), before) - 1.0).alias("ebitda_growth"))


def attach_fundamentals(panel: DataFrame, disclosures: DataFrame, lag_days: int = 90) -> DataFrame:
    effective = effective_disclosures(disclosures, lag_days)
    out = asof_backward(panel, effective, "effective", ["nd_ebitda", "fcfe_to_ebitda"])
    return asof_backward(out, annual_growth(effective), "effective", ["ebitda_growth"])


def fill_fundamentals(panel: DataFrame) -> DataFrame:
    """Gaps take the date's median, then the median of all, then 0."""
    by_date = panel.withColumns({c: F.coalesce(F.col(c), F.median(c).over(Window.partitionBy("date"))) for c in FUNDAMENTAL})
    overall = by_date.agg(*[F.median(c).alias(f"_{c}") for c in FUNDAMENTAL])
    out = by_date.crossJoin(F.broadcast(overall)).withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(0.0)) for c in FUNDAMENTAL})
    return out.drop(*[f"_{c}" for c in FUNDAMENTAL])


def latest_disclosures(disclosures: DataFrame) -> DataFrame:
    """Each ticker's last row by period end, an annual one over others."""
    cols = [c for c in disclosures.columns if c != "ticker"]
    last = F.max_by(F.struct(*cols), F.struct("period_end", "is_annual")).alias("r")
    return disclosures.groupBy("ticker").agg(last).select("ticker", "r.*")
