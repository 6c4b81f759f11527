"""Readers for price bars, rates, disclosures, dividends, models and configuration."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.functions.scalars import is_annual, parse_number, parse_volume, period_end, year_in
from marketweave.sources.files import exists, read_text

DIVIDENDS = "ticker string, ex_date date, dividend double"
#: Column headings of the disclosure files.
DISCLOSURE_COLUMNS = {
    "Тикер": "ticker",
    "Квартал / Полугодие": "period",
    "EBITDA (млн KZT)": "ebitda",
    "Net Debt / Чистый долг (млн KZT)": "net_debt",
    "FCFE / Свободный поток (млн KZT)": "fcfe",
}


def load_config(path: str) -> dict[str, Any]:
    """A YAML or JSON configuration as a nested dict."""
    text = read_text(path)
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def _trimmed(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])


def tidy_bars(raw: DataFrame, ticker: str | None = None) -> DataFrame:
    """date, ticker, open, high, low, close, volume from the columns Date, Price, Open, High, Low and Vol. or Volume; rows without a valid date go."""
    volume = next((c for c in ("Vol.", "Volume") if c in raw.columns), None)
    number = lambda c: parse_number(F.col(f"`{c}`")).alias(c.lower())
    name = F.lit(ticker) if ticker is not None else F.col("ticker")
    rows = raw.select(
        F.try_to_date(F.trim("Date"), "MM/dd/yyyy").alias("date"), name.alias("ticker"), number("Open"), number("High"), number("Low"),
        number("Price").alias("close"), (parse_volume(F.col(f"`{volume}`")) if volume else F.lit(None).cast("double")).alias("volume"),
    )
    return rows.where(F.col("date").isNotNull())


def load_bars(spark: SparkSession, paths: str | list[str], ticker: str | None = None) -> DataFrame:
    """Bars of one or many CSV files in one scan; without `ticker` it is that of the folder (ticker=...) or the file's name."""
    raw = _trimmed(spark.read.option("header", True).csv(paths))
    if ticker is None and "ticker" not in raw.columns:
        raw = raw.withColumn("ticker", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    return tidy_bars(raw, ticker)


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """; if the header has more of it than of the comma."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return ";" if line.count(";") > line.count(",") else ","


def disclosure_paths(pattern: str, years: list[int], legacy: str | None = None) -> dict[int, str]:
    """Files that exist for the {year} pattern; else the legacy file as the last year; else an error."""
    found = {y: pattern.format(year=y) for y in years if exists(pattern.format(year=y))}
    if not found and legacy and exists(legacy):
        found = {max(years): legacy}
    if not found:
        raise FileNotFoundError(pattern)
    return found


def tidy_disclosures(raw: DataFrame, year: int) -> DataFrame:
    """ticker, period, period_end, ebitda, net_debt, fcfe, is_annual, period_year of a file whose rows are of `year` unless their label says otherwise."""
    missing = [c for c in DISCLOSURE_COLUMNS if c not in raw.columns]
    if missing:
        raise KeyError(f"unrecognised column(s) {missing}")
    df = raw.select([F.col(f"`{c}`").alias(n) for c, n in DISCLOSURE_COLUMNS.items()])
    df = df.withColumn("period", F.trim("period")).withColumn("period_year", F.coalesce(year_in(F.col("period")), F.lit(year)))
    return df.select(
        F.upper(F.trim("ticker")).alias("ticker"), "period", period_end(F.col("period"), F.col("period_year")).alias("period_end"),
        *[F.trim(c).try_cast("double").alias(c) for c in ("ebitda", "net_debt", "fcfe")], is_annual(F.col("period")).alias("is_annual"), "period_year",
    )


def load_disclosures(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """All years' rows that have a period end."""
    parts = [tidy_disclosures(_trimmed(spark.read.option("header", True).option("sep", detect_delimiter(spark, p)).csv(p)), y) for y, p in sorted(paths.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("period_end").isNotNull())


def header_row(rows: list[list[Any]], marker: str, scan: int = 10) -> int:
    """Index of the first of `scan` rows with a cell that holds the marker; 0 if none has."""
    return next((i for i, r in enumerate(rows[:scan]) if any(marker in str(c) for c in r)), 0)


def load_dated_series(spark: SparkSession, path: str, date_col: str, value_col: str, date_format: str, name: str) -> DataFrame:
    """date and one value from CSV or parquet, or from xlsx where openpyxl is installed (one sheet, read on the driver)."""
    if path.endswith(".xlsx"):
        import openpyxl

        rows = [list(r) for r in openpyxl.load_workbook(path, read_only=True).active.iter_rows(values_only=True)]
        top = header_row(rows, date_col)
        at = [str(c).strip() for c in rows[top]]
        picked = [(str(r[at.index(date_col)]), str(r[at.index(value_col)])) for r in rows[top + 1 :]]
        raw = spark.createDataFrame(picked, f"`{date_col}` string, `{value_col}` string")
    else:
        raw = spark.read.parquet(path) if path.endswith(".parquet") else _trimmed(spark.read.option("header", True).csv(path))
    df = raw.select(F.try_to_date(F.trim(F.col(f"`{date_col}`").cast("string")), date_format).alias("date"), parse_number(F.col(f"`{value_col}`").cast("string")).alias(name))
    return df.where(F.col("date").isNotNull())


def load_rate(spark: SparkSession, path: str) -> DataFrame:
    """date, tonia (percent a year) and rf_daily."""
    return load_dated_series(spark, path, "Дата", "Закрытие", "dd.MM.yy", "tonia").withColumn("rf_daily", F.col("tonia") / 100.0 / 252.0)


def load_fx(spark: SparkSession, path: str) -> DataFrame:
    return load_dated_series(spark, path, "Дата", "USD", "dd.MM.yyyy", "usd_kzt")


def load_dividends(spark: SparkSession, path: str | None) -> DataFrame:
    """Typed dividends; an empty table if there is no file."""
    if not path or not exists(path):
        return spark.createDataFrame([], DIVIDENDS)
    raw = _trimmed(spark.read.option("header", True).csv(path))
    return raw.select(F.upper(F.trim("ticker")).alias("ticker"), F.try_to_date(F.trim("ex_date"), "yyyy-MM-dd").alias("ex_date"), parse_number(F.col("dividend")).alias("dividend")).where("ex_date is not null")


def load_grid(path: str) -> dict[str, list]:
    """A tuning grid from JSON."""
    return json.loads(read_text(path))
