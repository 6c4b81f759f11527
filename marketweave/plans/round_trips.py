"""Queries that write given tables as files of the published formats, dirty as those are, and read them back with the library's readers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.operators import training as Z
from marketweave.operators.features import BASE, compute_features
from marketweave.operators.fuzzy import FuzzyModel
from marketweave.plans import tables as B
from marketweave.plans.queries import INPUTS, MODEL, QUERIES, SQL, SQL_EPOCH, panel, q, query, r, with_scored
from marketweave.plans.tables import TEST, TRAIN, with_
from marketweave.sources import readers, sinks
from marketweave.sources.scratch import new_folder

MARK = "﻿"


def _grouped(c: str, digits: int) -> Column:
    """With thousands commas and blanks around, as exports have it; a missing number is a dash."""
    return F.coalesce(F.concat(F.lit(" "), F.format_number(c, digits)), F.lit("-"))


@query("s2_load_bars", with_("bars") + f" SELECT ticker, date, {', '.join(f'{q(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, {q('volume', 2)} AS volume FROM bars")
def _(s, d):
    """Bars as one folder of CSV files per ticker: byte-order mark, month first, thousands commas, volumes in thousands, a row without a date in each."""
    bars = B.bars(s, d)
    price = [_grouped(c, 9).alias(n) for c, n in (("close", "Price"), ("open", "Open"), ("high", "High"), ("low", "Low"))]
    rows = bars.select("ticker", F.date_format("date", "MM/dd/yyyy").alias(f"{MARK}Date"), *price, F.concat(F.format_string("%.5f", F.col("volume") / 1000), F.lit("K")).alias("Vol."), F.lit("0.1%").alias("Change %"))
    bad = bars.select("ticker").distinct().select("ticker", F.lit("n/a").alias(f"{MARK}Date"), *[F.lit("1").alias(n) for n in ("Price", "Open", "High", "Low", "Vol.", "Change %")])
    folder = new_folder(s)
    rows.unionByName(bad).write.partitionBy("ticker").option("header", True).csv(folder)
    got = readers.load_bars(s, folder)
    return got.select("ticker", "date", *[r(c).alias(c) for c in ("open", "high", "low", "close")], r("volume", 2).alias("volume"))


@query("s7_load_disclosures", with_("disclosures") + f" SELECT upper(ticker) AS ticker, period, period_end, {', '.join(f'{q(c, 5)} AS {c}' for c in ('ebitda', 'net_debt', 'fcfe'))}, is_annual, period_year FROM disclosures")
def _(s, d):
    """Disclosures as a folder per year with semicolons and the published headings; years without a file are skipped, labels that name no period go."""
    rows = B.disclosures(s, d)
    number = [F.format_string(" %.8f", F.col(c)).alias(h) for h, c in readers.DISCLOSURE_COLUMNS.items() if c in ("ebitda", "net_debt", "fcfe")]
    heads = {c: h for h, c in readers.DISCLOSURE_COLUMNS.items()}
    dirty = rows.select("period_year", F.concat(F.lit(" "), F.lower("ticker")).alias(f"{MARK}{heads['ticker']}"), F.col("period").alias(heads["period"]), *number)
    dirty = dirty.unionByName(dirty.limit(1).withColumn(heads["period"], F.lit("??")))
    folder = new_folder(s)
    dirty.write.partitionBy("period_year").options(header=True, sep=";").csv(folder)
    got = readers.load_disclosures(s, readers.disclosure_paths(f"{folder}/period_year={{year}}", list(range(1985, 2010))))
    return got.select("ticker", "period", "period_end", *[r(c, 5).alias(c) for c in ("ebitda", "net_debt", "fcfe")], "is_annual", "period_year")


def _series(s, rows: DataFrame, heads: tuple[str, str], date_format: str, digits: int) -> str:
    folder = new_folder(s)
    rows = rows.select(F.date_format("date", date_format).alias(f"{MARK}{heads[0]}"), _grouped("value", digits).alias(heads[1]))
    rows.unionByName(rows.limit(1).withColumn(f"{MARK}{heads[0]}", F.lit("total"))).write.option("header", True).csv(folder)
    return folder


@query("s9_load_rate", with_("rates") + f" SELECT CAST(date + INTERVAL 20 YEAR AS DATE) AS date, {q('tonia', 4)} AS tonia, {q('tonia / 100 / 252', 9)} AS rf_daily FROM rates")
def _(s, d):
    """Rates with the published headings and two-digit years (20 years on)."""
    rows = B.rates(B.bars(s, d)).select(F.add_months("date", 240).alias("date"), F.col("tonia").alias("value"))
    return readers.load_rate(s, _series(s, rows, ("Дата", "Закрытие"), "dd.MM.yy", 4)).select("date", r("tonia", 4).alias("tonia"), r("rf_daily", 9).alias("rf_daily"))


@query("s10_load_fx", with_("bars") + f" SELECT date, {q('max(close)')} AS usd_kzt FROM bars WHERE day(date) != 13 GROUP BY date")
def _(s, d):
    rows = B.bars(s, d).where(F.dayofmonth("date") != 13).groupBy("date").agg(F.max("close").alias("value"))
    return readers.load_fx(s, _series(s, rows, ("Дата", "USD"), "dd.MM.yyyy", 9)).select("date", r("usd_kzt").alias("usd_kzt"))


@query("s11_load_dividends", with_("dividends") + f" SELECT upper(ticker) AS ticker, ex_date, {q('dividend', 2)} AS dividend FROM dividends")
def _(s, d):
    rows = B.dividends(s, d).select(F.concat(F.lower("ticker"), F.lit(" ")).alias("ticker"), F.col("ex_date").cast("string").alias("ex_date"), _grouped("dividend", 2).alias("dividend"))
    folder = new_folder(s)
    rows.write.option("header", True).csv(folder)
    return readers.load_dividends(s, folder).select("ticker", "ex_date", r("dividend", 2).alias("dividend"))


@query("s12_model_file", with_scored() + " SELECT ticker, date, score FROM scored")
def _(s, d):
    """Scores of a model that was written as JSON and read back."""
    path = f"{new_folder(s)}/model.json"
    MODEL.save(path)
    return FuzzyModel.load(path).with_score(panel(s, d, TEST), INPUTS).select("ticker", "date", r("score").alias("score"))


@query("s13_checkpoint", SQL_EPOCH)
def _(s, d):
    """One epoch's history from a checkpoint that was written and read back, as a CSV table."""
    m = replace(MODEL, consequents=[list(b) for b in MODEL.consequents], metadata={})
    path = new_folder(s)
    Z.save_checkpoint(f"{path}/checkpoint.json", m, Z.train(m, panel(s, d, TRAIN), INPUTS, "Y_target", epochs=1))
    table = Z.load_checkpoint(f"{path}/checkpoint.json")[1].to_df(s)
    sinks.write_table(table, f"{path}/history")
    back = s.read.option("header", True).schema(table.schema).csv(f"{path}/history")
    return back.select("epoch", r("train_loss", 1).alias("train_loss"), r("gradient_norm", 1).alias("gradient_norm"), "learning_rate")


@query("k3_feature_files", with_("features") + " SELECT ticker, date, " + ", ".join(f"{q(c)} AS {c}" for c in BASE) + " FROM features")
def _(s, d):
    """Features as a folder per ticker and as one sorted CSV table; what both have alike comes back."""
    features = compute_features(B.bars(s, d)).select("ticker", "date", *BASE)
    folder = new_folder(s)
    sinks.write_features(features, f"{folder}/by_ticker", f"{folder}/pooled")
    pooled = s.read.option("header", True).schema(features.schema).csv(f"{folder}/pooled")
    own = s.read.parquet(f"{folder}/by_ticker").select(*features.columns)
    return own.join(pooled.select("ticker", "date"), ["ticker", "date"]).select("ticker", "date", *[r(c).alias(c) for c in BASE])


@query("k4_score_files", with_scored() + f" SELECT ticker, date, score, {q('R30')} AS R30, pre_agm FROM scored")
def _(s, d):
    rows = MODEL.with_score(panel(s, d, TEST), INPUTS).select("ticker", "date", r("score").alias("score"), "R30", "pre_agm")
    folder = new_folder(s)
    sinks.write_table(rows, folder)
    return s.read.option("header", True).schema(rows.schema).csv(folder).select("ticker", "date", "score", r("R30").alias("R30"), "pre_agm")


@query("k5_report_file", SQL["a17_counts"])
def _(s, d):
    """The counts of a report that was written as JSON and read back."""
    found = QUERIES["a17_counts"](s, d)
    path = f"{new_folder(s)}/report.json"
    sinks.write_json(path, {"counts": found.first().asDict()})
    return s.createDataFrame([tuple(sinks.read_json(path)["counts"][c] for c in found.columns)], found.schema)
