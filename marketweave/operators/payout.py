"""Payout ratios from the latest disclosures and mean scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.functions.scalars import appetite, capacity, safe_ratio
from marketweave.operators.fundamentals import latest_disclosures


def mean_scores(scored: DataFrame, score: str = "score") -> DataFrame:
    return scored.groupBy("ticker").agg(F.avg(score).alias("Y_attr"))


def payout_table(disclosures: DataFrame, scores: DataFrame, kappa: float = 3.0, tau: float = 1.0) -> DataFrame:
    """ticker, fcfe, ND_EBITDA, Y_attr, PR_target and PR_target_pct (one decimal); NULL without a leverage."""
    both = latest_disclosures(disclosures).join(scores, "ticker").withColumn("ND_EBITDA", safe_ratio(F.col("net_debt"), F.col("ebitda")))
    target = appetite(F.col("Y_attr")) * capacity(F.col("ND_EBITDA"), F.col("fcfe"), kappa, tau)
    return both.select("ticker", "fcfe", "ND_EBITDA", "Y_attr", target.alias("PR_target")).withColumn("PR_target_pct", F.round(100.0 * F.col("PR_target"), 1))
