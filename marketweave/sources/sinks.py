"""Writers: JSON files for models and reports, DataFrame writers for tables, and a keyed upsert."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.scalars import bounded_label
from marketweave.sources.files import read_text, write_text


def write_json(path: str, value: dict[str, Any]) -> None:
    write_text(path, json.dumps(value, indent=2, ensure_ascii=False))


def read_json(path: str) -> dict[str, Any]:
    return json.loads(read_text(path))


def write_features(panel: DataFrame, by_ticker: str, pooled: str) -> None:
    """One folder per ticker, and one pooled CSV sorted by date and ticker."""
    panel.write.mode("overwrite").partitionBy("ticker").parquet(by_ticker)
    panel.orderBy("date", "ticker").write.mode("overwrite").option("header", True).csv(pooled)


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if kind == "csv" else getattr(writer, kind))(path)


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key isn't in new, and those of new. Write the result to another path than the one old is read from."""
    return new if old is None else old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def ticker_figure(scored: DataFrame, ticker: str | None = None, scale: float = 15.0) -> DataFrame:
    """ticker, date, day (1, 2, ...), score, return and its bounded label (a missing one counts as average)."""
    rows = scored if ticker is None else scored.where(F.col("ticker") == ticker)
    day = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    return rows.select("ticker", "date", day.alias("day"), F.col("score").alias("Y_attr"), bounded_label(F.coalesce("Z30", F.lit(0.0)), scale).alias("R30_scaled"), "R30", "pre_agm")
