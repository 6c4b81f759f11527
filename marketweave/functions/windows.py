"""Window helpers. A trailing window covers the n rows before the current one and counts only if none of its values is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("ticker",))).orderBy("date")


def trailing(n: int) -> WindowSpec:
    return series().rowsBetween(-n, -1)


def gated(agg: Callable[[Column], Column], x: Column, n: int, frame: WindowSpec | None = None) -> Column:
    """agg(x) over n rows, NULL if any of them is missing."""
    frame = frame or trailing(n)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def average_rank(x: Column, *keys: str) -> Column:
    """Rank with ties averaged; rows with a NULL x have none."""
    over = Window.partitionBy(*keys, x.isNull()) if keys else Window.partitionBy(x.isNull())
    tied = Window.partitionBy(*keys, x)
    return F.when(x.isNotNull(), F.rank().over(over.orderBy(x)) + (F.count(F.lit(1)).over(tied) - 1) / 2.0)


#: Distinct values of a slice, about, and the most slices.
SLICE_VALUES, SLICES = 1 << 18, 1024


def _slice(values: DataFrame, col: str) -> Column:
    """The slice of the value range a distinct value falls into: their number grows with the values, and each has about as many."""
    n = max(8, min(SLICES, -(-values.count() // SLICE_VALUES)))
    cuts = sorted(set(values.approxQuantile(col, [i / n for i in range(1, n)], 0.25 / n)))
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(col))) if cuts else F.lit(0)


def cumulative(df: DataFrame, col: str, weight: str, name: str, own: str | None = None) -> DataFrame:
    """df with the sum of weights of all rows whose col isn't larger, and as `own` that of rows with the same value; NULLs in col have neither.

    Weights are summed by value first, so a value that most rows share is one row from then on and no task sees all values: their range is cut
    into slices with a window each, and the slices' totals are summed apart. Rows meet their value's sums in a plain join, which adaptive execution may
    split. The table of values is read several times and persisted (to disk where memory ends).
    """
    values = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_value")).agg(F.sum(weight).alias("_w")).persist()
    cut = values.withColumn("_slice", _slice(values, "_value"))
    ahead = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("_slice").agg(F.sum("_w").alias("_w")).select("_slice", F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_before"))
    inside = F.sum("_w").over(Window.partitionBy("_slice").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    sums = cut.withColumn("_in", inside).join(F.broadcast(before), "_slice").select("_value", (F.col("_before") + F.col("_in")).alias(name), *([F.col("_w").alias(own)] if own else []))
    return df.join(sums, F.col(col) == F.col("_value"), "left").drop("_value")


def global_rank(df: DataFrame, col: str, name: str) -> DataFrame:
    """df with the rank of col among all rows, ties averaged, without one window over everything; NULLs have none."""
    out = cumulative(df.withColumn("_one", F.lit(1).cast("long")), col, "_one", "_upto", "_ties")
    return out.withColumn(name, F.col("_upto") - (F.col("_ties") - 1) / 2.0).drop("_one", "_upto", "_ties")
