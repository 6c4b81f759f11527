"""Market tables derived from the driver's tables, as DataFrames and as DuckDB text with the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN, TEST = ("1995-01-01", "1998-12-31"), ("1999-01-01", "2001-12-31")
MEETINGS = ["1996-06-28", "1997-06-27", "1999-06-25", "2000-06-30"]
#: The date without a rate.
NO_RATE = "1996-02-29"
LAG_DAYS = 90


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of 25 brands: trades are order lines at price per unit, in order of their keys."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    line = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ok"))
    return line.join(part, "l_partkey").groupBy("ticker", "date").agg(
        F.min_by("price", "ok").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ok").alias("close"), F.sum("l_quantity").alias("volume"))


def rates(bar_rows: DataFrame) -> DataFrame:
    days = bar_rows.select("date").distinct().where(F.col("date") != F.lit(NO_RATE).cast("date"))
    return days.withColumn("tonia", 10.0 + F.dayofmonth("date") % 5).withColumn("rf_daily", F.col("tonia") / 100.0 / 252.0)


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker"), number.alias("num")).distinct()


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.explode(F.sequence(F.lit(1993), F.lit(2001))).alias("y")
    rows = brands(spark, sf_dir).select("ticker", "num", year)
    return rows.select("ticker", F.make_date("y", F.lit(6), F.lit(15)).alias("ex_date"), (F.col("num") + (F.col("y") - 1990) * 2.5).alias("dividend"))


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands(spark, sf_dir).select("ticker", F.explode(F.array(*[F.lit(d).cast("date") for d in MEETINGS])).alias("agm_date"))


def disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand-quarter sums of order lines, and yearly ones."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("d"), "l_extendedprice", "l_discount", "l_tax").join(part, "l_partkey")
    num = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    def sums(unit: str, annual: bool) -> DataFrame:
        start = F.date_trunc(unit, "d").cast("date")
        end = F.date_sub(F.add_months(start, 12 if annual else 3), 1)
        label = F.concat(F.lit("ЗА "), F.year(start).cast("string")) if annual else F.concat(F.lit("Q"), F.quarter(start).cast("string"))
        ebitda = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
        rows = line.groupBy("ticker", start.alias("start")).agg(ebitda.alias("ebitda"), F.sum(F.col("l_extendedprice") * (F.col("l_tax") - F.col("l_discount"))).alias("fcfe"))
        end, label = F.date_sub(F.add_months("start", 12 if annual else 3), 1), (F.concat(F.lit("ЗА "), F.year("start").cast("string")) if annual else F.concat(F.lit("Q"), F.quarter("start").cast("string")))
        return rows.select("ticker", label.alias("period"), end.alias("period_end"), "ebitda", (F.col("ebitda") * ((num % 7) - 3) / 2.0).alias("net_debt"), "fcfe", F.lit(annual).alias("is_annual"), F.year("start").alias("period_year"))
    return sums("quarter", False).unionByName(sums("year", True))


#: The same tables as common table expressions; a query picks what it needs with `with_()`.
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": ((), """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, arg_min(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS open, max(l_extendedprice / l_quantity) AS high,
        min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS close, sum(l_quantity) AS volume
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"""),
    "rates": (("bars",), "SELECT DISTINCT date, (10.0 + day(date) % 5)::DOUBLE AS tonia, (10.0 + day(date) % 5)::DOUBLE / 100.0::DOUBLE / 252.0::DOUBLE AS rf_daily FROM bars WHERE date != DATE '1996-02-29'"),
    "brands": ((), r"SELECT DISTINCT p_brand AS ticker, CAST(regexp_extract(p_brand, '(\d+)', 1) AS INT) AS num FROM part"),
    "dividends": (("brands",), "SELECT ticker, make_date(y, 6, 15) AS ex_date, (num + (y - 1990) * 2.5)::DOUBLE AS dividend FROM brands, range(1993, 2002) t(y)"),
    "meetings": (("brands",), "SELECT ticker, CAST(d AS DATE) AS agm_date FROM brands, unnest(['1996-06-28', '1997-06-27', '1999-06-25', '2000-06-30']) t(d)"),
    "sums": ((), """SELECT p_brand AS ticker, u, date_trunc(u, l_shipdate)::DATE AS start, sum(l_extendedprice * (1 - l_discount)) AS ebitda, sum(l_extendedprice * (l_tax - l_discount)) AS fcfe
        FROM lineitem JOIN part ON l_partkey = p_partkey, unnest(['quarter', 'year']) t(u) GROUP BY ALL"""),
    "disclosures": (("sums",), r"""SELECT ticker, CASE u WHEN 'year' THEN 'ЗА ' || year(start) ELSE 'Q' || quarter(start) END AS period,
        CAST(start + CASE u WHEN 'year' THEN INTERVAL 12 MONTH ELSE INTERVAL 3 MONTH END - INTERVAL 1 DAY AS DATE) AS period_end, ebitda,
        ebitda * ((CAST(regexp_extract(ticker, '(\d+)', 1) AS INT) % 7) - 3) / 2.0::DOUBLE AS net_debt, fcfe, u = 'year' AS is_annual, CAST(year(start) AS INT) AS period_year FROM sums"""),
    "f1": (("bars",), """SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret_1, (2 * close - high - low) / (high - low + 1e-6::DOUBLE) AS clv_now, sign(close - lag(close) OVER w)::DOUBLE AS tick_now, row_number() OVER w AS rn
        FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)"""),
    "features": (("f1",), """SELECT ticker, date, close, volume, rn,
        CASE WHEN count(close * volume) OVER w20 = 20 THEN sum(close * volume) OVER w20 / nullif(sum(volume) OVER w20, 0) END AS vwap20,
        CASE WHEN count(close * volume) OVER w60 = 60 THEN sum(close * volume) OVER w60 / nullif(sum(volume) OVER w60, 0) END AS vwap60,
        (close - vwap20) / nullif(vwap20, 0) * 100 AS dev_price,
        CASE WHEN count(volume) OVER w20 = 20 THEN ln((volume + 1e-6::DOUBLE * avg(volume) OVER w20) / nullif(median(volume) OVER w20 + 1e-6::DOUBLE * avg(volume) OVER w20, 0)) END AS dev_volume,
        CASE WHEN high > low THEN clv_now ELSE tick_now END AS order_flow,
        (close - vwap60) / nullif(vwap60, 0) * 100 AS dev_price_60,
        (lag(close, 1) OVER w / nullif(lag(close, 6) OVER w, 0) - 1) * 100 AS ret_5,
        CASE WHEN count(ret_1) OVER w20 = 20 THEN stddev_samp(ret_1) OVER w20 * 100 END AS vol_20,
        CASE WHEN count(clv_now) OVER w5 = 5 THEN avg(clv_now) OVER w5 END AS clv_5,
        CASE WHEN count(abs(ret_1) / nullif(close * volume, 0)) OVER w20 = 20 THEN avg(abs(ret_1) / nullif(close * volume, 0)) OVER w20 * 1e6::DOUBLE END AS amihud
        FROM f1 WINDOW w AS (PARTITION BY ticker ORDER BY date), w5 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
        w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), w60 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"""),
    "paid": (("features", "dividends"), """SELECT f.ticker, f.date, """ + ", ".join(f"sum(CASE WHEN f.date <= ex_date + {h} THEN dividend END) AS div_{h}" for h in (5, 21, 30, 63, 252)) + """
        FROM features f JOIN dividends d ON d.ticker = f.ticker AND d.ex_date < f.date AND f.date <= d.ex_date + 252 GROUP BY ALL"""),
    "targets": (("features", "rates", "paid"), "SELECT f.*, rf_daily, " + ", ".join(
        f"(lead(close, {h}) OVER w + coalesce(div_{h}, 0) - close) / nullif(close, 0) - CASE WHEN count(rf_daily) OVER w{h} = {h} THEN sum(rf_daily) OVER w{h} END AS R{h}" for h in (5, 21, 30, 63, 252))
        + " FROM features f LEFT JOIN rates USING (date) LEFT JOIN paid USING (ticker, date) WINDOW w AS (PARTITION BY ticker ORDER BY date), "
        + ", ".join(f"w{h} AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in (5, 21, 30, 63, 252))),
    "flagged": (("targets", "meetings"), "SELECT t.*, CASE WHEN EXISTS (SELECT 1 FROM meetings m WHERE m.ticker = t.ticker AND t.date >= m.agm_date - 45 AND t.date < m.agm_date) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pre_agm FROM targets t"),
    "complete": (("flagged",), "SELECT * FROM flagged WHERE dev_price IS NOT NULL AND dev_volume IS NOT NULL AND order_flow IS NOT NULL"),
    "limits": (("complete",), "SELECT " + ", ".join(f"quantile_cont({c}, {q}) AS {c}_{s}" for c in ("dev_price", "dev_volume") for q, s in ((0.01, "lo"), (0.99, "hi"))) + " FROM complete WHERE date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'"),
    "clipped": (("complete", "limits"), "SELECT c.* REPLACE (" + ", ".join(f"CASE WHEN c.{c} < {c}_lo THEN {c}_lo WHEN c.{c} > {c}_hi THEN {c}_hi ELSE c.{c} END AS {c}" for c in ("dev_price", "dev_volume")) + ") FROM complete c, limits"),
    "stats": (("clipped",), "SELECT " + ", ".join(f"avg(R{h}) AS m{h}, CASE WHEN stddev_pop(R{h}) > 0 THEN stddev_pop(R{h}) ELSE 1 END AS s{h}" for h in (5, 21, 30, 63, 252)) + " FROM clipped WHERE date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'"),
    "panel": (("clipped", "stats"), "SELECT c.*, (R30 - m30) / s30 AS Z30, " + ", ".join(f"50 * (1 + tanh(0.3::DOUBLE * ((R{h} - m{h}) / s{h}))) AS Y_target_{h}" for h in (5, 21, 30, 63, 252)) + ", Y_target_30 AS Y_target FROM clipped c, stats"),
    "tested": (("panel",), "SELECT * FROM panel WHERE date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31'"),
}


def with_(*names: str) -> str:
    """WITH clause of the named tables and all they need, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTE[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order)
