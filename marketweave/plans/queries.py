"""Registered queries of the market engine over the driver's tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.functions import scalars as S
from marketweave.functions.windows import average_rank, gated, series
from marketweave.operators import experiments as X
from marketweave.operators import features as A
from marketweave.operators import fundamentals as P
from marketweave.operators import metrics as M
from marketweave.operators import targets as T
from marketweave.operators import training as Z
from marketweave.operators.fuzzy import FuzzyModel, mask_weight
from marketweave.operators.payout import mean_scores, payout_table
from marketweave.plans import tables as B
from marketweave.plans.tables import TEST, TRAIN, with_
from marketweave.sources.scratch import written
from marketweave.sources.sinks import ticker_figure, upsert

INPUTS = A.BASE
#: A fixed model of three rules, so that scores can be checked against SQL.
MODEL = FuzzyModel(
    centers=[[-40.0, -0.5, -0.6], [0.0, 0.0, 0.0], [60.0, 0.6, 0.7]], sigmas=[[60.0, 1.2, 0.9], [45.0, 0.8, 0.7], [90.0, 1.4, 0.8]],
    consequents=[[42.0, 0.15, -3.0, 5.0], [50.0, 0.1, 4.0, -6.0], [61.0, -0.05, 2.5, 3.0]], firing_floor=1e-3)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison between engines, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def q(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE"


def panel(spark: SparkSession, d: str, split: tuple[str, str] | None = None) -> DataFrame:
    # The panel reads its bars for features, rates, winsor limits and labels: order lines are summed up once for all of them.
    b = written(B.bars(spark, d))
    return T.build_panel(b, B.rates(b), B.dividends(spark, d), B.meetings(spark, d), TRAIN, split)


def scored(spark: SparkSession, d: str, split: tuple[str, str] | None = TEST) -> DataFrame:
    return MODEL.with_score(panel(spark, d, split), INPUTS).withColumn("score", r("score", 6))


def scored_once(spark: SparkSession, d: str) -> DataFrame:
    """The scored test window for queries that read it more than once."""
    return written(scored(spark, d).select("ticker", "date", "score", "R30", "R63", "Y_target", "pre_agm"))


def _sql_total(parts: list[str]) -> str:
    return "(" + " + ".join(parts) + ")"


def sql_firing(k: int, model: FuzzyModel = MODEL) -> str:
    return f"exp(-0.5::DOUBLE * {_sql_total([f'(({x} - ({c}::DOUBLE)) / {s}::DOUBLE) * (({x} - ({c}::DOUBLE)) / {s}::DOUBLE)' for x, c, s in zip(INPUTS, model.centers[k], model.sigmas[k], strict=True)])})"


def sql_output(k: int, clipped: bool = True, model: FuzzyModel = MODEL) -> str:
    b = model.consequents[k]
    y = _sql_total([f"{b[0]}::DOUBLE", *[f"({w}::DOUBLE) * {x}" for w, x in zip(b[1:], INPUTS, strict=True)]])
    return f"least(greatest({y}, 0.0::DOUBLE), 100.0::DOUBLE)" if clipped else y


K = range(MODEL.n_rules)
SQL_FIRED = _sql_total([sql_firing(k) for k in K])
SQL_SCORE = f"CASE WHEN {SQL_FIRED} < 1e-3 THEN 50.0::DOUBLE ELSE least(greatest({_sql_total([f'{sql_firing(k)} * {sql_output(k)}' for k in K])} / {SQL_FIRED}, 0.0::DOUBLE), 100.0::DOUBLE) END"
SQL_MEAN = f"({_sql_total([f'{sql_firing(k)} * {sql_output(k)}' for k in K])} / {SQL_FIRED})"


def with_scored(*more: str, split: str = "tested") -> str:
    return with_(split, *more) + f",\nscored AS (SELECT *, {q(SQL_SCORE)} AS score FROM {split})"


def sql_ic(source: str, x: str, y: str, by: str = "") -> str:
    """Spearman's correlation with ties averaged by groups; the same guarded formula."""
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    rank = lambda v: f"rank() OVER ({part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {cols}{v}) - 1) / 2.0::DOUBLE"
    return (f"SELECT {cols}count(*) AS n, CASE WHEN count(*) >= 3 THEN {q('covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)')} END AS ic FROM "
            f"(SELECT {cols}{rank(x)} AS x, {rank(y)} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) {'GROUP BY ' + by if by else ''}")


# --- bars and features -------------------------------------------------------------------------------------------


@query("s0_bars", with_("bars") + f" SELECT ticker, date, {q('open')} AS open, {q('high')} AS high, {q('low')} AS low, {q('close')} AS close, volume FROM bars")
def _(s, d):
    return B.bars(s, d).select("ticker", "date", *[r(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


def _feature(name: str, expr: Callable[[], Column], sql: str, digits: int = 6) -> None:
    def run(s, d):
        base = B.bars(s, d).withColumn("ret_1", A.ret_1()).withColumn("clv_now", A.clv())
        return base.select("ticker", "date", r(expr(), digits).alias("value"))

    query(name, with_("features") + f" SELECT ticker, date, {q(sql, digits)} AS value FROM features")(run)


_feature("w1_vwap20", lambda: A.rolling_vwap(20), "vwap20")
_feature("w1_vwap60", lambda: A.rolling_vwap(60), "vwap60")
_feature("w2_dev_price", lambda: A.dev_price(20), "dev_price")
_feature("w2_dev_price_60", lambda: A.dev_price(60), "dev_price_60")
_feature("w3_dev_volume", A.dev_volume, "dev_volume")
_feature("w4_hybrid", A.order_flow, "order_flow")


@query("w4_clv", with_("f1") + f" SELECT ticker, date, {q('clv_now')} AS value FROM f1")
def _(s, d):
    return B.bars(s, d).select("ticker", "date", r(A.order_flow("clv")).alias("value"))


@query("w4_tick", with_("f1") + " SELECT ticker, date, tick_now + 0.0::DOUBLE AS value FROM f1")
def _(s, d):
    return B.bars(s, d).select("ticker", "date", (A.order_flow("tick") + 0.0).alias("value"))


@query("p1_features", with_("features") + " SELECT ticker, date, " + ", ".join(f"{q(c, 6)} AS {c}" for c in [*A.BASE, *A.EXTRA]) + " FROM features")
def _(s, d):
    return A.compute_features(B.bars(s, d)).select("ticker", "date", *[r(c, 6).alias(c) for c in [*A.BASE, *A.EXTRA]])


for _name, _col, _digits in (("w5_ret5", "ret_5", 6), ("w6_vol20", "vol_20", 6), ("w7_clv5", "clv_5", 6), ("w8_amihud", "amihud", 6)):
    query(_name, with_("features") + f" SELECT ticker, date, {q(_col, _digits)} AS value FROM features")(
        lambda s, d, c=_col, n=_digits: A.compute_features(B.bars(s, d)).select("ticker", "date", r(c, n).alias("value")))


# --- targets, joins, panel ---------------------------------------------------------------------------------------


def _targets(s, d) -> DataFrame:
    b = B.bars(s, d)
    return T.compute_target(A.compute_features(b), B.rates(b), B.dividends(s, d))


for _h in T.HORIZONS:
    query(f"w9_fwd_{_h}", with_("targets") + f" SELECT ticker, date, {q(f'R{_h}')} AS value FROM targets")(lambda s, d, h=_h: _targets(s, d).select("ticker", "date", r(f"R{h}").alias("value")))


@query("j1_rf_left", with_("bars", "rates") + f" SELECT ticker, date, {q('rf_daily', 9)} AS rf_daily FROM bars LEFT JOIN rates USING (date)")
def _(s, d):
    b = B.bars(s, d)
    return b.join(B.rates(b), "date", "left").select("ticker", "date", r("rf_daily", 9).alias("rf_daily"))


@query("j6_dividend_range", with_("bars", "dividends") + """ SELECT b.ticker, b.date, sum(dividend) AS paid FROM bars b JOIN dividends d ON d.ticker = b.ticker AND d.ex_date < b.date AND b.date <= d.ex_date + 30 GROUP BY ALL""")
def _(s, d):
    return B.bars(s, d).join(T.dividend_sums(B.dividends(s, d), [30]), ["ticker", "date"]).select("ticker", "date", F.col("div_30").alias("paid"))


@query("f7_pre_agm", with_("flagged") + " SELECT ticker, date, pre_agm FROM flagged")
def _(s, d):
    return T.pre_meeting(B.bars(s, d).select("ticker", "date"), B.meetings(s, d))


@query("f1_split", with_("bars") + " SELECT ticker, date, volume FROM bars WHERE date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31'")
def _(s, d):
    return B.bars(s, d).where(T.between(*TEST)).select("ticker", "date", "volume")


@query("f2_complete_rows", with_("complete") + " SELECT ticker, count(*) AS n, min(date) AS first_date FROM complete GROUP BY ticker")
def _(s, d):
    return A.compute_features(B.bars(s, d)).na.drop(subset=INPUTS).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"))


@query("f3_labelled", with_("panel") + " SELECT ticker, count(*) AS n FROM panel WHERE Y_target IS NOT NULL AND date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' GROUP BY ticker")
def _(s, d):
    return panel(s, d, TRAIN).where(F.col("Y_target").isNotNull()).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("f4_ticker", with_("bars") + " SELECT date, volume FROM bars WHERE ticker = 'Brand#12'")
def _(s, d):
    return B.bars(s, d).where("ticker = 'Brand#12'").select("date", "volume")


@query("f9_dropout", with_("bars") + " SELECT ticker, date FROM bars WHERE (('0x' || substr(md5('7|' || ticker || '|' || date), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE >= 0.3")
def _(s, d):
    return B.bars(s, d).where(S.keyed_uniform("7", F.col("ticker"), F.col("date").cast("string")) >= 0.3).select("ticker", "date")


@query("j9_first_day_semi", with_("bars") + " SELECT ticker, date FROM bars WHERE date IN (SELECT min(date) FROM bars GROUP BY date_trunc('month', date))")
def _(s, d):
    return A.first_trading_day(B.bars(s, d)).select("ticker", "date")


@query("a1_zstats", with_("clipped") + f" SELECT {q('avg(R30)')} AS mean, {q('stddev_pop(R30)')} AS std, count(R30) AS n FROM clipped WHERE date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'")
def _(s, d):
    return T.train_stats(panel(s, d), "R30", TRAIN).select(r("mean").alias("mean"), r("std").alias("std"), "n")


@query("a2_winsor_limits", with_("limits") + " SELECT " + ", ".join(f"{q(f'{c}_{x}', 5)} AS {c}_{x}" for c in ("dev_price", "dev_volume") for x in ("lo", "hi")) + " FROM limits")
def _(s, d):
    full = A.compute_features(B.bars(s, d)).na.drop(subset=INPUTS)
    limits = T.winsor_limits(full, A.winsor_columns(INPUTS), TRAIN)
    return limits.select(*[r(c, 5).alias(c) for c in limits.columns])


@query("c6_winsor_clip", with_("clipped") + f" SELECT ticker, date, {q('dev_price', 4)} AS dev_price, {q('dev_volume', 4)} AS dev_volume FROM clipped")
def _(s, d):
    full = A.compute_features(B.bars(s, d)).na.drop(subset=INPUTS)
    return T.winsorise(full, A.winsor_columns(INPUTS), TRAIN).select("ticker", "date", r("dev_price", 4).alias("dev_price"), r("dev_volume", 4).alias("dev_volume"))


@query("a3_peer_demean", with_("targets") + f" SELECT ticker, date, {q('R30 - avg(R30) OVER (PARTITION BY date)')} AS value FROM targets")
def _(s, d):
    from pyspark.sql import Window

    return _targets(s, d).select("ticker", "date", r(F.col("R30") - F.avg("R30").over(Window.partitionBy("date"))).alias("value"))


@query("a3_median_impute", with_("features") + f" SELECT ticker, date, {q('coalesce(dev_price_60, median(dev_price_60) OVER (PARTITION BY date))', 4)} AS value FROM features")
def _(s, d):
    from pyspark.sql import Window

    return A.compute_features(B.bars(s, d)).select("ticker", "date", r(F.coalesce("dev_price_60", F.median("dev_price_60").over(Window.partitionBy("date"))), 4).alias("value"))


@query("p3_tanh_label", with_("panel") + f" SELECT ticker, date, {q('Y_target', 5)} AS label FROM panel")
def _(s, d):
    return panel(s, d).select("ticker", "date", r("Y_target", 5).alias("label"))


@query("p3_peer_label", with_("targets") + f""", v AS (SELECT ticker, date, R30 - avg(R30) OVER (PARTITION BY date) AS v FROM targets),
    m AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM v WHERE date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31')
    SELECT ticker, date, {q('50 * (1 + tanh(0.3::DOUBLE * ((v - m) / s)))', 5)} AS label FROM v, m""")
def _(s, d):
    return T.tanh_labels(_targets(s, d), {"R30": "label"}, TRAIN, peer_relative=True).select("ticker", "date", r("label", 5).alias("label"))


@query("p3_rank_label", with_("targets") + f""", v AS (SELECT ticker, date, {q('R30', 9)} AS v FROM targets),
    n AS (SELECT *, count(v) OVER (PARTITION BY date) AS n, rank() OVER (PARTITION BY date, v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0 AS k FROM v),
    ref AS (SELECT v FROM v WHERE v IS NOT NULL AND date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'),
    lone AS (SELECT ticker, date, (SELECT count(*) FROM ref WHERE ref.v <= n.v) / (SELECT count(*) FROM ref) * 100.0 AS f FROM n WHERE n < 2 AND v IS NOT NULL)
    SELECT n.ticker, n.date, {q("CASE WHEN n >= 2 THEN CASE WHEN v IS NOT NULL THEN k / n * 100.0 END WHEN v IS NULL THEN 100.0 ELSE f END", 5)} AS label FROM n LEFT JOIN lone USING (ticker, date)""")
def _(s, d):
    return T.rank_label(_targets(s, d).withColumn("R30", r("R30", 9)), "R30", TRAIN).select("ticker", "date", r("label", 5).alias("label"))


@query("p4_standardised", with_("panel") + " SELECT ticker, date, " + ", ".join(f"{q(c, 5)} AS {c}" for c in ("Z30", *[f"Y_target_{h}" for h in T.HORIZONS])) + " FROM panel")
def _(s, d):
    return panel(s, d).select("ticker", "date", *[r(c, 5).alias(c) for c in ("Z30", *[f"Y_target_{h}" for h in T.HORIZONS])])


@query("p7_panel", with_("tested") + " SELECT ticker, date, " + ", ".join(f"{q(c, 4)} AS {c}" for c in (*INPUTS, "R30", "Y_target", "pre_agm")) + " FROM tested")
def _(s, d):
    return panel(s, d, TEST).select("ticker", "date", *[r(c, 4).alias(c) for c in (*INPUTS, "R30", "Y_target", "pre_agm")])


# --- fundamentals and payout -------------------------------------------------------------------------------------

_EFFECTIVE = """, e AS (SELECT ticker, period_end + 90 AS effective, arg_max({'ebitda': ebitda, 'net_debt': net_debt, 'fcfe': fcfe, 'is_annual': is_annual}, is_annual::INT) AS r FROM disclosures GROUP BY ALL),
    eff AS (SELECT ticker, effective, r.is_annual AS is_annual, r.ebitda AS ebitda, r.net_debt / nullif(r.ebitda, 0) AS nd_ebitda, r.fcfe / nullif(r.ebitda, 0) AS fcfe_to_ebitda FROM e)"""
_GROWTH = ", g AS (SELECT ticker, effective, ebitda / nullif(lag(ebitda) OVER (PARTITION BY ticker ORDER BY effective), 0) - 1 AS ebitda_growth FROM eff WHERE is_annual)"
_ATTACHED = ", att AS (SELECT b.ticker, b.date, ebitda_growth, nd_ebitda, fcfe_to_ebitda FROM bars b ASOF LEFT JOIN eff ON b.ticker = eff.ticker AND b.date >= eff.effective ASOF LEFT JOIN g ON b.ticker = g.ticker AND b.date >= g.effective)"


@query("u2_dedupe", with_("disclosures") + _EFFECTIVE + f" SELECT ticker, effective, is_annual, {q('ebitda', 2)} AS ebitda, {q('nd_ebitda')} AS nd_ebitda FROM eff")
def _(s, d):
    return P.effective_disclosures(B.disclosures(s, d), B.LAG_DAYS).select("ticker", "effective", "is_annual", r("ebitda", 2).alias("ebitda"), r("nd_ebitda").alias("nd_ebitda"))


@query("w13_growth", with_("disclosures") + _EFFECTIVE + _GROWTH + f" SELECT ticker, effective, {q('ebitda_growth')} AS ebitda_growth FROM g")
def _(s, d):
    return P.annual_growth(P.effective_disclosures(B.disclosures(s, d), B.LAG_DAYS)).select("ticker", "effective", r("ebitda_growth").alias("ebitda_growth"))


@query("j3_asof", with_("bars", "disclosures") + _EFFECTIVE + f" SELECT b.ticker, b.date, {q('nd_ebitda')} AS nd_ebitda, {q('fcfe_to_ebitda')} AS fcfe_to_ebitda FROM bars b ASOF LEFT JOIN eff ON b.ticker = eff.ticker AND b.date >= eff.effective")
def _(s, d):
    out = P.asof_backward(B.bars(s, d).select("ticker", "date"), P.effective_disclosures(B.disclosures(s, d), B.LAG_DAYS), "effective", ["nd_ebitda", "fcfe_to_ebitda"])
    return out.select("ticker", "date", r("nd_ebitda").alias("nd_ebitda"), r("fcfe_to_ebitda").alias("fcfe_to_ebitda"))


@query("p5_fundamentals", with_("bars", "disclosures") + _EFFECTIVE + _GROWTH + _ATTACHED + " SELECT ticker, date, " + ", ".join(f"{q(c)} AS {c}" for c in A.FUNDAMENTAL) + " FROM att")
def _(s, d):
    out = P.attach_fundamentals(B.bars(s, d).select("ticker", "date"), B.disclosures(s, d), B.LAG_DAYS)
    return out.select("ticker", "date", *[r(c).alias(c) for c in A.FUNDAMENTAL])


@query("p6_fill", with_("bars", "disclosures") + _EFFECTIVE + _GROWTH + _ATTACHED + ", dm AS (SELECT ticker, date, " + ", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY date)) AS {c}" for c in A.FUNDAMENTAL)
       + " FROM att) SELECT ticker, date, " + ", ".join(f"{q(f'coalesce({c}, (SELECT median({c}) FROM dm), 0.0)')} AS {c}" for c in A.FUNDAMENTAL) + " FROM dm")
def _(s, d):
    out = P.fill_fundamentals(P.attach_fundamentals(B.bars(s, d).select("ticker", "date"), B.disclosures(s, d), B.LAG_DAYS))
    return out.select("ticker", "date", *[r(c).alias(c) for c in A.FUNDAMENTAL])


@query("a11_latest", with_("disclosures") + f" SELECT ticker, arg_max(period, (period_end, is_annual)) AS period, max(period_end) AS period_end, {q('arg_max(ebitda, (period_end, is_annual))', 2)} AS ebitda FROM disclosures GROUP BY ticker")
def _(s, d):
    return P.latest_disclosures(B.disclosures(s, d)).select("ticker", "period", "period_end", r("ebitda", 2).alias("ebitda"))


@query("s7_period_parse", with_("disclosures") + " SELECT ticker, period, period_year, is_annual, period_end AS parsed_end FROM disclosures")
def _(s, d):
    rows = B.disclosures(s, d)
    return rows.select("ticker", "period", "period_year", S.is_annual(F.col("period")).alias("is_annual"), S.period_end(F.col("period"), F.col("period_year")).alias("parsed_end"))


@query("a13_mean_score", with_scored() + f" SELECT ticker, {q('avg(score)', 9)} AS Y_attr FROM scored GROUP BY ticker")
def a13_mean_score(s, d):
    return mean_scores(scored(s, d)).select("ticker", r("Y_attr", 9).alias("Y_attr"))


@query("p8_payout", with_scored("disclosures") + f""", y AS (SELECT ticker, {q('avg(score)', 9)} AS Y_attr FROM scored GROUP BY ticker),
    l AS (SELECT ticker, arg_max(fcfe, (period_end, is_annual)) AS fcfe, arg_max(net_debt / nullif(ebitda, 0), (period_end, is_annual)) AS lev FROM disclosures GROUP BY ticker)
    SELECT ticker, {q('fcfe', 2)} AS fcfe, {q('lev')} AS ND_EBITDA, Y_attr, {q("least(greatest(Y_attr / 100, 0), 1) * CASE WHEN fcfe > 0 THEN 1 / (1 + exp(3.0::DOUBLE * (lev - 1))) ELSE 0 END")} AS PR_target FROM l JOIN y USING (ticker)""")
def _(s, d):
    return payout_table(B.disclosures(s, d), a13_mean_score(s, d)).select("ticker", r("fcfe", 2).alias("fcfe"), r("ND_EBITDA").alias("ND_EBITDA"), "Y_attr", r("PR_target").alias("PR_target"))


# --- scalar parsers over text made from the tables ---------------------------------------------------------------

_NUMBERS = "CASE o_orderkey % 6 WHEN 0 THEN '-' WHEN 1 THEN ' N/A ' WHEN 2 THEN 'abc' WHEN 3 THEN format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '.5' WHEN 4 THEN ' ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) ELSE '' END"


@query("c1_parse_number", f"""WITH t AS (SELECT o_orderkey, {_NUMBERS} AS txt FROM orders)
    SELECT o_orderkey, TRY_CAST(CASE WHEN trim(replace(txt, ',', '')) NOT IN ('', '-', 'N/A', 'NA', 'nan') THEN trim(replace(txt, ',', '')) END AS DOUBLE) AS value FROM t""")
def _(s, d):
    key, price = F.col("o_orderkey") % 6, F.floor("o_totalprice")
    txt = F.when(key == 0, "-").when(key == 1, " N/A ").when(key == 2, "abc").when(key == 3, F.concat(F.format_number(price, 0), F.lit(".5"))).when(key == 4, F.concat(F.lit(" "), price.cast("string"))).otherwise("")
    return B.table(s, d, "orders").select("o_orderkey", S.parse_number(txt).alias("value"))


@query("c2_parse_volume", """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '-' WHEN 1 THEN n || 'K' WHEN 2 THEN n || 'm' WHEN 3 THEN n || ' B' ELSE n END AS txt
    FROM (SELECT o_orderkey, CAST(o_orderkey % 1000 AS VARCHAR) || '.25' AS n FROM orders)),
    p AS (SELECT o_orderkey, upper(regexp_extract(txt, '^([0-9.]+)\\s*([KMBkmb]?)$', 2)) AS u, TRY_CAST(regexp_extract(txt, '^([0-9.]+)\\s*([KMBkmb]?)$', 1) AS DOUBLE) AS n FROM t)
    SELECT o_orderkey, n * CASE u WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END::DOUBLE AS value FROM p""")
def _(s, d):
    n, key = F.concat((F.col("o_orderkey") % 1000).cast("string"), F.lit(".25")), F.col("o_orderkey") % 5
    txt = F.when(key == 0, "-").when(key == 1, F.concat(n, F.lit("K"))).when(key == 2, F.concat(n, F.lit("m"))).when(key == 3, F.concat(n, F.lit(" B"))).otherwise(n)
    return B.table(s, d, "orders").select("o_orderkey", S.parse_volume(txt).alias("value"))


@query("c8_c9_payout_terms", f"""SELECT c_custkey, {q('least(greatest(c_acctbal / 100, 0), 1)')} AS psi, {q('CASE WHEN c_acctbal > 0 THEN 1 / (1 + exp(3.0::DOUBLE * (c_acctbal / 5000 - 1))) ELSE 0 END')} AS phi FROM customer""")
def _(s, d):
    c = F.col("c_acctbal")
    return B.table(s, d, "customer").select("c_custkey", r(S.appetite(c)).alias("psi"), r(S.capacity(c / 5000, c)).alias("phi"))


@query("c12_calendar", with_("bars") + """ SELECT DISTINCT date, date_trunc('week', date)::DATE AS week, date_trunc('month', date)::DATE AS month, date_trunc('quarter', date)::DATE AS quarter, date_trunc('year', date)::DATE AS year,
    CAST(date_trunc('quarter', date) - INTERVAL 3 MONTH AS DATE) AS quarter_before FROM bars""")
def _(s, d):
    unit = lambda u: F.date_trunc(u, "date").cast("date")
    return B.bars(s, d).select("date").distinct().select("date", *[unit(u).alias(u) for u in ("week", "month", "quarter", "year")], F.add_months(unit("quarter"), -3).alias("quarter_before"))


# --- metrics -----------------------------------------------------------------------------------------------------


@query("w11_avg_rank", with_("tested") + " SELECT ticker, date, CASE WHEN R30 IS NOT NULL THEN rank() OVER (PARTITION BY date, R30 IS NULL ORDER BY R30) + (count(*) OVER (PARTITION BY date, R30) - 1) / 2.0::DOUBLE END AS rank FROM tested")
def _(s, d):
    return panel(s, d, TEST).select("ticker", "date", average_rank(F.col("R30"), "date").alias("rank"))


@query("w11_pct_rank", with_("tested") + f" SELECT ticker, date, CASE WHEN R30 IS NOT NULL THEN {q('(rank() OVER (PARTITION BY date, R30 IS NULL ORDER BY R30) + (count(*) OVER (PARTITION BY date, R30) - 1) / 2.0::DOUBLE) / count(R30) OVER (PARTITION BY date)')} END AS pct FROM tested")
def _(s, d):
    from pyspark.sql import Window

    return panel(s, d, TEST).select("ticker", "date", r(average_rank(F.col("R30"), "date") / F.nullif(F.count("R30").over(Window.partitionBy("date")), F.lit(0))).alias("pct"))


@query("m1_pooled_ic", with_scored() + " " + sql_ic("scored", "score", "R30"))
def _(s, d):
    return M.rank_ic(scored_once(s, d)).select("n", r("ic").alias("ic"))


@query("a5_ic_per_asset", with_scored() + " " + sql_ic("scored", "score", "R30", "ticker"))
def _(s, d):
    return M.rank_ic(scored_once(s, d), by=["ticker"]).select("ticker", "n", r("ic").alias("ic"))


_FIRST = ", days AS (SELECT min(date) AS date FROM scored GROUP BY date_trunc('month', date)), fd AS (SELECT * FROM scored WHERE date IN (FROM days))"
_MONTHLY = _FIRST + ", wide AS (SELECT date FROM fd GROUP BY date HAVING count(DISTINCT ticker) >= 3), ic AS (" + sql_ic("(SELECT * FROM fd WHERE date IN (FROM wide))", "score", "R30", "date") + ")"


@query("a7_monthly_ic", with_scored() + _MONTHLY + " SELECT date, ic FROM ic WHERE ic IS NOT NULL")
def _(s, d):
    return M.monthly_rank_ic(scored_once(s, d)).select("date", r("ic").alias("ic"))


@query("a7_monthly_ic_mean", with_scored() + _MONTHLY + f" SELECT count(ic) AS n, {q('avg(ic)', 5)} AS mean, {q('stddev_samp(ic) / sqrt(count(ic))', 5)} AS se FROM ic")
def _(s, d):
    return M.mean_and_error(M.monthly_rank_ic(scored_once(s, d)).select(r("ic").alias("ic"))).select("n", r("mean", 5).alias("mean"), r("se", 5).alias("se"))


for _agg, _fn in (("mean", "avg(score)"), ("median", "median(score)"), ("last", "arg_max(score, date)")):
    for _unit in ("week", "month", "quarter", "year"):
        query(f"a8_mark_{_agg}_{_unit}", with_scored() + f" SELECT ticker, date_trunc('{_unit}', date)::DATE AS period, {q(_fn, 9)} AS mark FROM scored GROUP BY ALL")(
            lambda s, d, a=_agg, u=_unit: M.period_marks(scored(s, d), u, a).select("ticker", "period", r("mark", 9).alias("mark")))


@query("w10_ewma_mark", with_scored() + f""", l AS (SELECT ticker, date_trunc('quarter', date)::DATE AS period, list(score ORDER BY date) AS v FROM scored WHERE score IS NOT NULL GROUP BY ALL)
    SELECT ticker, period, {q("list_reduce(v, lambda a, x: a * (1 - 2.0::DOUBLE / 22) + x * (2.0::DOUBLE / 22))", 5)} AS mark FROM l""")
def _(s, d):
    return M.period_marks(scored(s, d), "quarter", "ewma").select("ticker", "period", r("mark", 5).alias("mark"))


_MARKS = """, mk AS (SELECT ticker, date_trunc('quarter', date)::DATE AS period, avg(score) AS mark FROM scored GROUP BY ALL),
    fw AS (SELECT ticker, CAST(date_trunc('quarter', date) - INTERVAL 3 MONTH AS DATE) AS period, arg_min(R63, date) AS fwd FROM scored WHERE R63 IS NOT NULL GROUP BY ALL),
    mf AS (SELECT ticker, period, mark, fwd FROM mk JOIN fw USING (ticker, period))"""


@query("j7_mark_forward", with_scored() + _MARKS + f" SELECT ticker, period, {q('mark', 9)} AS mark, {q('fwd', 9)} AS fwd FROM mf")
def _(s, d):
    return M.mark_forward(scored_once(s, d), "quarter").select("ticker", "period", r("mark", 9).alias("mark"), r("fwd", 9).alias("fwd"))


@query("a9_mark_ic", with_scored() + _MARKS + ", wide AS (SELECT period FROM mf GROUP BY period HAVING count(DISTINCT ticker) >= 3), ic AS (" + sql_ic("(SELECT * FROM mf WHERE period IN (FROM wide))", "mark", "fwd", "period") + ") SELECT period, ic FROM ic WHERE ic IS NOT NULL")
def _(s, d):
    return M.mark_rank_ic(scored_once(s, d), "quarter").select("period", r("ic").alias("ic"))


_TOP = _FIRST + """, pk AS (SELECT date, ticker, R30 FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS k FROM fd WHERE R30 IS NOT NULL AND score IS NOT NULL) WHERE k <= 3),
    pf AS (SELECT date, avg(R30) AS portfolio_return, count(*) AS n_picks, string_agg(ticker, ',' ORDER BY ticker) AS picks FROM pk GROUP BY date HAVING count(*) >= 3)"""


@query("t2_topn", with_scored() + _TOP + f" SELECT date, {q('portfolio_return')} AS portfolio_return, n_picks, picks FROM pf")
def _(s, d):
    return M.top_n_portfolio(scored_once(s, d)).select("date", r("portfolio_return").alias("portfolio_return"), "n_picks", "picks")


@query("a10_net_sharpe", with_scored() + _TOP + f""", h AS (SELECT *, string_split(picks, ',') AS a, string_split(lag(picks) OVER (ORDER BY date), ',') AS b FROM pf),
    ch AS (SELECT *, CASE WHEN b IS NOT NULL THEN (len(list_filter(a, lambda x: NOT list_contains(b, x))) + len(list_filter(b, lambda x: NOT list_contains(a, x)))) / greatest(len(a), 1) END AS c FROM h),
    st AS (SELECT coalesce(avg(c), 0) / 2 * 12 AS t, avg(portfolio_return) AS m, stddev_samp(portfolio_return) AS s FROM ch)
    SELECT cost::DOUBLE AS cost_bps, {q('t')} AS turnover_annual, CASE WHEN s > 0 THEN {q('(m - t / 12 * cost / 1e4::DOUBLE) / s * sqrt(12.0)', 5)} END AS sharpe FROM st, unnest([15, 25, 35, 50]) u(cost)""")
def _(s, d):
    return M.net_sharpe(M.top_n_portfolio(scored_once(s, d)), [15, 25, 35, 50]).select("cost_bps", r("turnover_annual").alias("turnover_annual"), r("sharpe", 5).alias("sharpe"))


_FIT = "count(*) AS n, " + ", ".join(f"{q(e, 5)} AS {n}" for n, e in (("rmse", "sqrt(avg((score - Y_target) * (score - Y_target)))"), ("mae", "avg(abs(score - Y_target))"), ("dir_acc", "avg((sign(score - 50) = sign(Y_target - 50))::INT)")))


@query("a15_fit_metrics", with_scored() + f" SELECT {_FIT} FROM scored WHERE score IS NOT NULL AND Y_target IS NOT NULL")
def _(s, d):
    return M.fit_metrics(scored(s, d), "score", "Y_target").select("n", *[r(c, 5).alias(c) for c in ("rmse", "mae", "dir_acc")])


@query("a19_fit_per_ticker", with_scored() + f" SELECT ticker, {_FIT} FROM scored WHERE score IS NOT NULL AND Y_target IS NOT NULL GROUP BY ticker")
def _(s, d):
    return M.fit_metrics(scored(s, d), "score", "Y_target", ["ticker"]).select("ticker", "n", *[r(c, 5).alias(c) for c in ("rmse", "mae", "dir_acc")])


@query("a17_counts", with_("tested") + " SELECT count(*) AS n, count(DISTINCT date) AS n_dates, count(DISTINCT ticker) AS n_tickers, count(Y_target) AS n_labelled FROM tested")
def _(s, d):
    return panel(s, d, TEST).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("date").alias("n_dates"), F.countDistinct("ticker").alias("n_tickers"), F.count("Y_target").alias("n_labelled"))


@query("k7_figure", with_scored() + f" SELECT ticker, date, CAST(row_number() OVER (PARTITION BY ticker ORDER BY date) AS INT) AS day, score AS Y_attr, {q('50 * (1 + tanh(0.3::DOUBLE * coalesce(Z30, 0)))', 5)} AS R30_scaled, {q('R30')} AS R30, pre_agm FROM scored")
def _(s, d):
    f = ticker_figure(scored(s, d))
    return f.select("ticker", "date", "day", "Y_attr", r("R30_scaled", 5).alias("R30_scaled"), r("R30").alias("R30"), "pre_agm")


@query("k6_upsert", with_("bars") + ", o AS (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker) SELECT ticker, CASE WHEN ticker IN ('Brand#11', 'Brand#12') THEN -1 ELSE n END AS n FROM o")
def _(s, d):
    old = B.bars(s, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return upsert(old, B.brands(s, d).where("ticker in ('Brand#11', 'Brand#12')").select("ticker", F.lit(-1).cast("long").alias("n")), ["ticker"])


# --- fuzzy scorer ------------------------------------------------------------------------------------------------

_XS = [F.col, INPUTS]


def _xs() -> list[Column]:
    return [F.col(c) for c in INPUTS]


@query("z7_firing", with_("tested") + " SELECT ticker, date, " + ", ".join(f"{q(sql_firing(k))} AS w{k}, {q(f'{sql_firing(k)} / {SQL_FIRED}', 5)} AS n{k}" for k in K) + " FROM tested")
def _(s, d):
    raw, norm = MODEL.firing(_xs()), MODEL.weights(_xs())
    return panel(s, d, TEST).select("ticker", "date", *[c for k in K for c in (r(raw[k]).alias(f"w{k}"), r(norm[k], 5).alias(f"n{k}"))])


@query("z8_rule_outputs", with_("tested") + " SELECT ticker, date, " + ", ".join(f"{q(sql_output(k, False), 4)} AS y{k}, {q(sql_output(k), 4)} AS c{k}" for k in K) + " FROM tested")
def _(s, d):
    y, c = MODEL.rule_outputs(_xs()), MODEL.rule_outputs(_xs(), True)
    return panel(s, d, TEST).select("ticker", "date", *[x for k in K for x in (r(y[k], 4).alias(f"y{k}"), r(c[k], 4).alias(f"c{k}"))])


@query("z9_predict", with_("tested") + f" SELECT ticker, date, {q(_sql_total([f'{sql_firing(k)} * {sql_output(k, False)}' for k in K]) + ' / ' + SQL_FIRED, 4)} AS yhat FROM tested")
def _(s, d):
    return panel(s, d, TEST).select("ticker", "date", r(MODEL.predict(_xs()), 4).alias("yhat"))


@query("z10_score", with_scored() + " SELECT ticker, date, score FROM scored")
def z10_score(s, d):
    return scored(s, d).select("ticker", "date", "score")


@query("z20_expected_mask", with_("tested") + f" SELECT ticker, date, {q(f'{SQL_MEAN} - 0.000625::DOUBLE * ' + _sql_total([f'({sql_firing(k)} / {SQL_FIRED}) * ({sql_firing(k)} / {SQL_FIRED}) * ({sql_output(k)} - {SQL_MEAN})' for k in K]), 4)} AS y FROM tested")
def _(s, d):
    return panel(s, d, TEST).select("ticker", "date", r(MODEL.expected_masked(_xs()), 4).alias("y"))


def _sql_noise(k: int, seed: str = "42") -> str:
    u = lambda t, x: f"((('0x' || substr(md5('{seed}|' || ticker || '|' || date || '|{k}|{t}{x}'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    tries = ", ".join(f"sqrt(-2.0::DOUBLE * ln({u(t, 'a')})) * cos(2 * 3.141592653589793::DOUBLE * {u(t, 'b')}) * 0.025::DOUBLE" for t in range(8))
    return f"coalesce(list_filter([{tries}], lambda x: abs(x) <= 0.05)[1], 0.0)"


_NOISE = ", nz AS (SELECT *, " + ", ".join(f"{_sql_noise(k)} AS z{k}" for k in K) + " FROM tested)"
_MASKED = [f"greatest({sql_firing(k)} * (1 + z{k}), 0.0::DOUBLE)" for k in K]


@query("z16_truncated_normal", with_("bars") + f" SELECT ticker, date, {q(_sql_noise(0), 8)} AS z FROM bars")
def _(s, d):
    return B.bars(s, d).select("ticker", "date", r(S.keyed_truncated_normal(0.05, ["42", F.col("ticker"), F.col("date").cast("string"), "0"]), 8).alias("z"))


@query("z17_mask", with_("tested") + _NOISE + " SELECT ticker, date, " + ", ".join(f"{q(m)} AS m{k}" for k, m in enumerate(_MASKED)) + " FROM nz")
def _(s, d):
    noise = [S.keyed_truncated_normal(0.05, ["42", F.col("ticker"), F.col("date").cast("string"), str(k)]) for k in K]
    return panel(s, d, TEST).select("ticker", "date", *[r(mask_weight(w, z)).alias(f"m{k}") for k, (w, z) in enumerate(zip(MODEL.firing(_xs()), noise, strict=True))])


_MASKED_SCORE = f"CASE WHEN {_sql_total(_MASKED)} > 1e-3 THEN least(greatest({_sql_total([f'{m} * {sql_output(k)}' for k, m in enumerate(_MASKED)])} / nullif({_sql_total(_MASKED)}, 0), 0.0::DOUBLE), 100.0::DOUBLE) ELSE 50.0::DOUBLE END"


@query("z18_masked_firing", with_("tested") + _NOISE + f" SELECT ticker, date, {q(_MASKED_SCORE, 4)} AS y FROM nz")
def _(s, d):
    return panel(s, d, TEST).select("ticker", "date", r(MODEL.deployed_score(_xs(), None, 0.05, ["42", F.col("ticker"), F.col("date").cast("string")]), 4).alias("y"))


@query("z19_masked_scores", with_("tested") + _NOISE + f" SELECT ticker, date, CASE WHEN pre_agm > 0 THEN {q(_MASKED_SCORE, 4)} ELSE {q(SQL_SCORE, 4)} END AS y FROM nz")
def _(s, d):
    return panel(s, d, TEST).select("ticker", "date", r(MODEL.deployed_score(_xs(), F.col("pre_agm"), 0.05, ["42", F.col("ticker"), F.col("date").cast("string")]), 4).alias("y"))


_SPREAD = ", sp AS (SELECT *, " + ", ".join(f"{sql_output(k)} AS f{k}" for k in K) + f", {SQL_MEAN} AS m FROM tested)"


@query("a16_conditioning", with_("tested") + _SPREAD + f" SELECT {q('max(greatest(' + ', '.join(f'abs(f{k})' for k in K) + '))', 4)} AS max_abs, {q('avg((' + ' + '.join(f'abs(f{k})' for k in K) + f') / {MODEL.n_rules})', 4)} AS mean_abs, {q('max(greatest(' + ', '.join(f'abs(f{k} - m)' for k in K) + '))', 4)} AS c FROM sp")
def _(s, d):
    return X.conditioning(MODEL, panel(s, d, TEST), INPUTS).select(*[r(c, 4).alias(c) for c in ("max_abs", "mean_abs", "c")])


_A = ["1.0::DOUBLE", *INPUTS]


@query("a18_gram", with_("panel") + " SELECT " + ", ".join(f"round(sum({_A[i]} * {_A[j]}), 2) + 0.0::DOUBLE AS g{i}{j}" for i in range(4) for j in range(i, 4)) + " FROM panel WHERE Y_target IS NOT NULL AND date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'")
def _(s, d):
    a, _, _ = Z.gram(panel(s, d, TRAIN).where(F.col("Y_target").isNotNull()), [F.lit(1.0), *_xs()], F.col("Y_target"))
    return s.range(1).select(*[r(F.lit(float(a[i][j])), 2).alias(f"g{i}{j}") for i in range(4) for j in range(i, 4)])


_DESIGN = [f"({sql_firing(k)} / {SQL_FIRED}) * {x}" for k in K for x in ["1.0::DOUBLE", *INPUTS]]


@query("z12_gram", with_("panel") + ", dm AS (SELECT Y_target AS y, " + ", ".join(f"{x} AS d{i}" for i, x in enumerate(_DESIGN)) + " FROM panel WHERE Y_target IS NOT NULL AND date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31') SELECT "
       + ", ".join(f"round(sum(d{i} * d{j}), 1) + 0.0::DOUBLE AS g{i}_{j}" for i in range(12) for j in range(i, 12)) + ", " + ", ".join(f"round(sum(d{i} * y), 1) + 0.0::DOUBLE AS b{i}" for i in range(12)) + " FROM dm")
def _(s, d):
    a, b, _ = Z.gram(panel(s, d, TRAIN).where(F.col("Y_target").isNotNull()), MODEL.design(_xs()), F.col("Y_target"))
    return s.range(1).select(*[r(F.lit(float(a[i][j])), 1).alias(f"g{i}_{j}") for i in range(12) for j in range(i, 12)], *[r(F.lit(float(b[i])), 1).alias(f"b{i}") for i in range(12)])


def sql_ols(label: str, test: str, name: str = "ols") -> str:
    """Common table expressions that end in `name`: the rows of `test` with the least-squares prediction `ols`, by orthogonalised inputs."""
    train = f"SELECT dev_price AS x1, dev_volume AS x2, order_flow AS x3, {label} AS y FROM panel WHERE {label} IS NOT NULL AND date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'"
    return f"""{name}_t AS ({train}),
    {name}_a AS (SELECT regr_slope(x2, x1) AS s2, regr_intercept(x2, x1) AS i2, regr_slope(x3, x1) AS s3, regr_intercept(x3, x1) AS i3, regr_slope(y, x1) AS b1, regr_intercept(y, x1) AS b0 FROM {name}_t),
    {name}_e AS (SELECT y, x2 - i2 - s2 * x1 AS e2, x3 - i3 - s3 * x1 AS r3 FROM {name}_t, {name}_a),
    {name}_b AS (SELECT regr_slope(r3, e2) AS s32, regr_slope(y, e2) AS b2 FROM {name}_e),
    {name}_c AS (SELECT regr_slope(y, r3 - s32 * e2) AS b3 FROM {name}_e, {name}_b),
    {name} AS (SELECT q.*, b0 + b1 * dev_price + b2 * (dev_volume - i2 - s2 * dev_price) + b3 * (order_flow - i3 - s3 * dev_price - s32 * (dev_volume - i2 - s2 * dev_price)) AS ols FROM {test} q, {name}_a, {name}_b, {name}_c)"""


@query("m5_ols_predict", with_("tested") + ", " + sql_ols("Y_target", "tested") + f" SELECT ticker, date, {q('ols', 4)} AS score FROM ols")
def _(s, d):
    p = panel(s, d).cache()
    b = Z.least_squares(p.where(T.between(*TRAIN)), INPUTS, "Y_target")
    return p.where(T.between(*TEST)).select("ticker", "date", r(Z.linear_score(b, INPUTS), 4).alias("score"))


HORIZONS = [5, 21, 30, 63, 252]


def _sql_horizon(h: int) -> str:
    return (f"SELECT {h} AS horizon_days, f.*, p.ic AS pooled_rank_ic, a.ic AS per_asset_mean_rank_ic, o.ic AS ols_pooled_rank_ic FROM "
            f"(SELECT count(*) AS n_labelled, {q(f'sqrt(avg((score - Y_target_{h}) * (score - Y_target_{h})))', 4)} AS rmse, {q(f'avg(abs(score - Y_target_{h}))', 4)} AS mae FROM scored WHERE Y_target_{h} IS NOT NULL) f, "
            f"({sql_ic('scored', 'score', f'R{h}')}) p, (SELECT {q('avg(ic)', 5)} AS ic FROM ({sql_ic(f'(SELECT * FROM scored WHERE Y_target_{h} IS NOT NULL)', 'score', f'R{h}', 'ticker')})) a, ({sql_ic(f'o{h}', 'ols', f'R{h}')}) o")


@query("m1_horizons", with_scored() + ", " + ", ".join(sql_ols(f"Y_target_{h}", "scored", f"o{h}") for h in HORIZONS) + " " + " UNION ALL ".join(_sql_horizon(h) for h in HORIZONS))
def _(s, d):
    p = written(panel(s, d))
    tested = written(MODEL.with_score(p.where(T.between(*TEST)), INPUTS).withColumn("score", r("score", 6)))
    out = X.horizon_table(tested, p.where(T.between(*TRAIN)), INPUTS, HORIZONS)
    return out.select("horizon_days", "n_labelled", *[r(c, k).alias(c) for c, k in (("rmse", 4), ("mae", 4), ("pooled_rank_ic", 6), ("per_asset_mean_rank_ic", 5), ("ols_pooled_rank_ic", 6))])


_PREDICTED = _sql_total([f"{sql_firing(k)} * {sql_output(k, False)}" for k in K]) + " / " + SQL_FIRED


@query("a14_evaluate", with_("tested") + f""", pr AS (SELECT *, {_PREDICTED} AS yhat FROM tested WHERE Y_target IS NOT NULL)
    SELECT f.*, i.ic AS rank_ic FROM (SELECT count(*) AS n, {q('sqrt(avg((yhat - Y_target) * (yhat - Y_target)))', 4)} AS rmse, {q('avg(abs(yhat - Y_target))', 4)} AS mae, {q('avg((sign(yhat - 50) = sign(Y_target - 50))::INT)', 5)} AS dir_acc FROM pr WHERE yhat IS NOT NULL) f,
    ({sql_ic('pr', 'yhat', 'Y_target')}) i""")
def _(s, d):
    out = X.evaluate(panel(s, d, TEST), INPUTS, MODEL, "Y_target")
    return out.select("n", *[r(c, k).alias(c) for c, k in (("rmse", 4), ("mae", 4), ("dir_acc", 5), ("rank_ic", 6))])


@query("f8_finite", with_("tested") + " SELECT ticker, date FROM tested WHERE dev_price IS NOT NULL AND dev_volume IS NOT NULL AND order_flow IS NOT NULL AND Y_target IS NOT NULL AND isfinite(Y_target)")
def _(s, d):
    return Z.finite_rows(panel(s, d, TEST), INPUTS, "Y_target").select("ticker", "date")


@query("c3_year", with_("bars") + r" SELECT ticker, date, try_cast(regexp_extract('rep_' || ticker || '_' || (year(date) + 4) || '_v2019.csv', '20\d{2}') AS INT) AS y FROM bars")
def _(s, d):
    return B.bars(s, d).select("ticker", "date", S.year_in(F.concat(F.lit("rep_"), "ticker", F.lit("_"), (F.year("date") + 4).cast("string"), F.lit("_v2019.csv"))).alias("y"))


@query("f5_ratio", with_("bars") + f" SELECT ticker, date, {q('(close - open) / nullif(high - low, 0)')} AS x FROM bars")
def _(s, d):
    return B.bars(s, d).select("ticker", "date", r(S.safe_ratio(F.col("close") - F.col("open"), F.col("high") - F.col("low"))).alias("x"))


@query("c10_bias_bound", f"SELECT round(c * 0.000625::DOUBLE, 8) + 0.0::DOUBLE AS bound FROM ({SQL['a16_conditioning']})")
def _(s, d):
    return X.conditioning(MODEL, panel(s, d, TEST), INPUTS).select(r(r("c", 4) * S.bias_bound(0.05, 1.0), 8).alias("bound"))


_SCALED = FuzzyModel(MODEL.centers, MODEL.sigmas, MODEL.consequents, scale_lo=[-50.0, -1.0, -1.0], scale_span=[100.0, 2.0, 2.0])


@query("z4_scaled", with_("tested") + " SELECT ticker, date, " + ", ".join(f"{q(f'({x} - ({lo}::DOUBLE)) / {span}::DOUBLE')} AS x{i}" for i, (x, lo, span) in enumerate(zip(INPUTS, _SCALED.scale_lo, _SCALED.scale_span))) + " FROM tested")
def _(s, d):
    return panel(s, d, TEST).select("ticker", "date", *[r(x).alias(f"x{i}") for i, x in enumerate(_SCALED.scaled(_xs()))])


@query("z11_design", with_("tested") + " SELECT ticker, date, " + ", ".join(f"{q(f'({sql_firing(k)} / {SQL_FIRED}) * {x}', 4)} AS d{k}{i}" for k in K for i, x in enumerate(["1.0::DOUBLE", *INPUTS])) + " FROM tested")
def _(s, d):
    return panel(s, d, TEST).select("ticker", "date", *[r(c, 4).alias(f"d{n // 4}{n % 4}") for n, c in enumerate(MODEL.design(_xs()))])


@query("z15_counts", with_("panel") + " SELECT ticker, count(*) AS n_train, 21 AS free, 30 AS total, round(count(*) / 21.0::DOUBLE, 6) AS rows_per_parameter FROM panel WHERE Y_target IS NOT NULL AND date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' GROUP BY ticker")
def _(s, d):
    """Parameters of a fixed model against the rows that each ticker has to fit them."""
    c = MODEL.counts()
    rows = panel(s, d, TRAIN).where(F.col("Y_target").isNotNull()).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_train"))
    return rows.select("ticker", "n_train", F.lit(c["free"]).alias("free"), F.lit(c["total"]).alias("total"), r(F.col("n_train") / c["free"]).alias("rows_per_parameter"))


@query("m5_simple_regression", with_("panel") + f", b AS (SELECT regr_slope(Y_target, dev_volume) AS k, regr_intercept(Y_target, dev_volume) AS i FROM panel WHERE date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' AND Y_target IS NOT NULL) SELECT ticker, date, {q('i + k * dev_volume', 4)} AS score FROM tested, b".replace("FROM tested, b", "FROM panel, b WHERE date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31'"))
def _(s, d):
    p = panel(s, d).cache()
    b = Z.least_squares(p.where(T.between(*TRAIN)), ["dev_volume"], "Y_target")
    return p.where(T.between(*TEST)).select("ticker", "date", r(Z.linear_score(b, ["dev_volume"]), 4).alias("score"))


# --- training ----------------------------------------------------------------------------------------------------


def sql_solved(name: str, source: str, p: int, keys: str = "") -> str:
    """Common table expressions that end in `name` (keys, beta): the solutions of source's systems (keys, m: p rows of p + 1 numbers), by elimination without
    pivots, which a ridge makes safe."""
    cols = f"{keys}, " if keys else ""
    row = "list_transform(range(1, {0}), lambda j: m[i][j] - m[i][k + 1] / m[k + 1][k + 1] * m[k + 1][j])".format(p + 2)
    pivot = f"list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1])"
    return (f"{name}_e AS (SELECT {cols}0 AS k, m FROM {source} UNION ALL SELECT {cols}k + 1, list_transform(range(1, {p + 1}), lambda i: CASE WHEN i = k + 1 THEN {pivot} ELSE {row} END) FROM {name}_e WHERE k < {p}), "
            f"{name} AS (SELECT {cols}list_transform(m, lambda r: r[{p + 1}]) AS beta FROM {name}_e WHERE k = {p})")


def sql_system(columns: list[str], y: str, ridge: float) -> str:
    """The ridge regression's system of the aggregated rows: a list of rows, the right-hand side last."""
    p = range(len(columns))
    return "[" + ", ".join("[" + ", ".join([*[f"sum({columns[i]} * {columns[j]})" + (f" + {ridge}::DOUBLE" if i == j else "") for j in p], f"sum({columns[i]} * {y})"]) + "]" for i in p) + "]"


_TRAINED = "FROM panel WHERE Y_target IS NOT NULL AND date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'"
_SPREADS = [(k, i, f"(({x} - ({c}::DOUBLE)) / {w}::DOUBLE)", w) for k in K for i, (x, c, w) in enumerate(zip(INPUTS, MODEL.centers[k], MODEL.sigmas[k], strict=True))]


@query("z13_gradients", with_("panel") + ", g AS (SELECT *, Y_target AS y, " + ", ".join(f"{sql_firing(k)} / {SQL_FIRED} AS w{k}, {sql_output(k, False)} AS f{k}" for k in K) + f" {_TRAINED}), p AS (SELECT *, w0 * f0 + w1 * f1 + w2 * f2 AS p FROM g)"
       + " SELECT " + ", ".join(f"{q(f'sum((p - y) * w{k} * (f{k} - p) * {s} * {s})', 1)} AS width_{k}{i}, {q(f'sum((p - y) * w{k} * (f{k} - p) * {s}) / {w}::DOUBLE', 2)} AS center_{k}{i}" for k, i, s, w in _SPREADS) + f", {q('sum(0.5::DOUBLE * (p - y) * (p - y))', 1)} AS loss FROM p")
def _(s, d):
    """Premise gradients of a fixed model by log widths and by centres, and half its squared error."""
    width, center, loss = Z.width_gradient(MODEL, Z.finite_rows(panel(s, d, TRAIN), INPUTS, "Y_target"), INPUTS, "Y_target")
    found = [(f"{n}_{k}{i}", r(F.lit(float(g[k][i])), e)) for n, g, e in (("width", width, 1), ("center", center, 2)) for k in K for i in range(len(INPUTS))]
    return s.range(1).select(*[c.alias(n) for n, c in found], r(F.lit(loss), 1).alias("loss"))


#: Training of the fixed model's premises for one epoch, in SQL: regression, gradient, clipped step, loss at the new widths with the old outputs.
_NEW = [f"exp(greatest(ln({w}::DOUBLE) - 1e-3::DOUBLE * least(1.0::DOUBLE, 5.0::DOUBLE / norm) * g{k}{i}, ln(1e-4::DOUBLE)))" for k, i, _, w in _SPREADS]
_BETA = [f"(beta[{4 * k + 1}] + beta[{4 * k + 2}] * dev_price + beta[{4 * k + 3}] * dev_volume + beta[{4 * k + 4}] * order_flow)" for k in K]
_REFIRED = [f"exp(-0.5::DOUBLE * ({' + '.join(f'pow(({x} - ({c}::DOUBLE)) / s{k}{i}, 2)' for i, (x, c) in enumerate(zip(INPUTS, MODEL.centers[k], strict=True)))}))" for k in K]
SQL_EPOCH = (with_("panel") + ", t AS (SELECT *, Y_target AS y, " + ", ".join(f"{x} AS d{i}" for i, x in enumerate(f"({sql_firing(k)} / {SQL_FIRED}) * {x}" for k in K for x in ["1.0::DOUBLE", *INPUTS])) + f" {_TRAINED}), "
             + f"sy AS (SELECT {sql_system([f'd{i}' for i in range(12)], 'y', 10.0)} AS m FROM t), " + sql_solved("so", "sy", 12)
             + ", f AS (SELECT t.*, " + ", ".join(f"d{4 * k} AS w{k}, {_BETA[k]} AS f{k}" for k in K) + " FROM t, so), p AS (SELECT *, w0 * f0 + w1 * f1 + w2 * f2 AS p FROM f)"
             + ", g AS (SELECT " + ", ".join(f"sum((p - y) * w{k} * (f{k} - p) * {s} * {s}) AS g{k}{i}" for k, i, s, _ in _SPREADS) + " FROM p)"
             + ", n AS (SELECT *, sqrt(" + " + ".join(f"g{k}{i} * g{k}{i}" for k, i, _, _ in _SPREADS) + ") AS norm FROM g)"
             + ", e AS (SELECT norm, " + ", ".join(f"{v} AS s{k}{i}" for v, (k, i, _, _) in zip(_NEW, _SPREADS, strict=True)) + " FROM n)"
             + ", l AS (SELECT any_value(norm) AS norm, sum(0.5::DOUBLE * pow((e0 * f0 + e1 * f1 + e2 * f2) / (e0 + e1 + e2) - y, 2)) AS loss FROM (SELECT norm, y, f0, f1, f2, " + ", ".join(f"{x} AS e{k}" for k, x in zip(K, _REFIRED, strict=True)) + " FROM p, e))"
             + f" SELECT 0 AS epoch, {q('loss', 1)} AS train_loss, {q('norm', 1)} AS gradient_norm, 0.001::DOUBLE AS learning_rate FROM l").replace("WITH ", "WITH RECURSIVE ", 1)


@query("z14_epoch", SQL_EPOCH)
def _(s, d):
    """One epoch of training from the fixed model's premises."""
    m = replace(MODEL, consequents=[list(b) for b in MODEL.consequents], metadata={})
    history = Z.train(m, panel(s, d, TRAIN), INPUTS, "Y_target", epochs=1).to_df(s)
    return history.select("epoch", r("train_loss", 1).alias("train_loss"), r("gradient_norm", 1).alias("gradient_norm"), "learning_rate")


#: Fitted models of three cells of a grid; the last leaves rule outputs unbounded, so its C may be over 100.
CELLS = [MODEL, FuzzyModel(MODEL.centers, MODEL.sigmas, [[50.0, -0.2, 1.0, 2.0], [48.0, 0.05, -2.0, 1.0], [55.0, 0.1, 0.5, -4.0]]), FuzzyModel(MODEL.centers, MODEL.sigmas, [[50.0, 2.5, 1.0, 2.0], [50.0, 2.0, 4.0, 6.0], [50.0, 3.0, 0.5, 4.0]], clip_rule_outputs=False)]


def _sql_cell(k: int, m: FuzzyModel) -> str:
    w = [f"({sql_firing(j, m)} / {_sql_total([sql_firing(i, m) for i in K])})" for j in K]
    mean = lambda clipped: _sql_total([f"{w[j]} * {sql_output(j, clipped, m)}" for j in K])
    used = [sql_output(j, m.clip_rule_outputs, m) for j in K]
    return f"SELECT {k} AS cell, Y_target AS y, {mean(False)} AS prediction, greatest({', '.join(f'abs({u} - {mean(m.clip_rule_outputs)})' for u in used)}) AS far FROM panel WHERE Y_target IS NOT NULL AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"


_CELLS = with_("panel") + ", c AS (" + " UNION ALL ".join(_sql_cell(k, m) for k, m in enumerate(CELLS)) + f"), ic AS ({sql_ic('c', 'prediction', 'y', 'cell')}), v AS (SELECT cell, ic.ic AS val_rank_ic, m.* EXCLUDE (cell) FROM ic JOIN (SELECT cell, {q('sqrt(avg((prediction - y) * (prediction - y)))', 4)} AS val_rmse, {q('avg(abs(prediction - y))', 4)} AS val_mae, {q('max(far)', 4)} AS empirical_C FROM c GROUP BY cell) m USING (cell))"
SECOND = ("1997-01-01", "1998-12-31")


def _validated(s, d) -> DataFrame:
    out = X.validate(CELLS, panel(s, d, SECOND), INPUTS, "Y_target")
    return out.select("cell", *[r(c, e).alias(c) for c, e in (("val_rank_ic", 6), ("val_rmse", 4), ("val_mae", 4), ("empirical_C", 4))])


@query("z21_validation", _CELLS + " SELECT * FROM v")
def _(s, d):
    """Validation metrics of fitted cells, on the second half of the train window."""
    return _validated(s, d)


@query("t3_tuning_head", _CELLS + " SELECT * FROM v ORDER BY val_rank_ic DESC NULLS LAST, cell LIMIT 2")
def _(s, d):
    return X.tuning_head(_validated(s, d), 2)


@query("f13_best_cell", _CELLS + " SELECT * FROM v ORDER BY coalesce(empirical_C <= 100, false) DESC, val_rank_ic DESC NULLS LAST, cell LIMIT 1")
def _(s, d):
    return X.best_cell(_validated(s, d))


# --- training, bootstraps, adversary: no SQL ---------------------------------------------------------------------


def _train_rows(s, d) -> DataFrame:
    return written(panel(s, d, TRAIN).select("ticker", "date", *INPUTS, "Y_target", "R30", "pre_agm"))


def _sql_centers(rules: int, passes: int) -> str:
    """Common table expressions that end in cs (i, x): subtractive clustering of tr (x1, x2, x3) by all pairs, in at most `passes` passes; the radius starts at 0.5."""
    radii = [0.5, 0.5 * 0.7, 0.5 * 0.7 * 0.7][:passes]
    gap = "((a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2) + (a.z3 - b.z3) * (a.z3 - b.z3))"
    near = "((z1 - c.z1) * (z1 - c.z1) + (z2 - c.z2) * (z2 - c.z2) + (z3 - c.z3) * (z3 - c.z3))"
    beta = "[" + ", ".join(f"{4 / (1.25 * v) ** 2!r}::DOUBLE" for v in radii) + "][pass]"
    left = f"list_reduce(taken, lambda v, c: CASE WHEN c.x1 = x1 AND c.x2 = x2 AND c.x3 = x3 THEN 0.0::DOUBLE ELSE greatest(v - c.p * (0.5::DOUBLE + exp(-({beta}) * {near})), 0.0::DOUBLE) END, p[pass])"
    kind = "STRUCT(x1 DOUBLE, x2 DOUBLE, x3 DOUBLE, z1 DOUBLE, z2 DOUBLE, z3 DOUBLE, p DOUBLE)[]"
    return (
        "en AS (SELECT " + ", ".join(f"min(x{k}) AS lo{k}, CASE WHEN max(x{k}) > min(x{k}) THEN max(x{k}) - min(x{k}) ELSE 1 END AS sp{k}" for k in (1, 2, 3)) + " FROM tr), "
        "pt AS (SELECT x1, x2, x3, " + ", ".join(f"any_value((x{k} - lo{k}) / sp{k}) AS z{k}" for k in (1, 2, 3)) + ", count(*)::DOUBLE AS n, row_number() OVER () AS id FROM tr, en GROUP BY x1, x2, x3), "
        f"po AS (SELECT a.*, u.p FROM pt a JOIN (SELECT a.id, [{', '.join(f'round(sum(b.n * exp(-({4 / v**2!r}::DOUBLE) * {gap})), 9)' for v in radii)}] AS p FROM pt a, pt b GROUP BY a.id) u USING (id)), "
        f"ch AS (SELECT 0 AS step, 1 AS pass, []::{kind} AS taken, []::{kind} AS found UNION ALL "
        "SELECT step + 1, CASE WHEN t.p > 0 THEN pass ELSE pass + 1 END, CASE WHEN t.p > 0 THEN taken || [t] ELSE [] END, CASE WHEN t.p > 0 THEN found || [t] ELSE found END "
        "FROM (SELECT step, pass, taken, found, arg_max(t, (t.p, -t.x1, -t.x2, -t.x3)) AS t FROM "
        f"(SELECT step, pass, taken, found, struct_pack(x1, x2, x3, z1, z2, z3, p := {left}) AS t FROM ch, po WHERE len(found) < {rules} AND pass <= {passes}) GROUP BY step, pass, taken, found)), "
        f"cs AS (SELECT i - 1 AS i, found[i] AS x FROM (SELECT arg_max(found, step) AS found FROM ch), range(1, {rules + 1}) r(i) WHERE i <= len(found))")


_ALL_ROWS = ", tr AS MATERIALIZED (SELECT dev_price AS x1, dev_volume AS x2, order_flow AS x3, Y_target AS y FROM panel WHERE date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31')"
_WIDTHS = ", wd AS (SELECT " + ", ".join(f"greatest(0.75::DOUBLE * stddev_pop(x{k}), 4e-4::DOUBLE) AS w{k}" for k in (1, 2, 3)) + " FROM tr)"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("z1_centers")  # its SQL, three passes over all pairs of rows, is too slow; z12_consequents checks two
def _(s, d):
    """Centres and widths of the initial model, from all rows of the train window."""
    m = Z.initial_model(_train_rows(s, d), INPUTS)
    rows = [(k, *[float(v) for pair in zip(c, w, strict=True) for v in pair]) for k, (c, w) in enumerate(zip(m.centers, m.sigmas, strict=True))]
    names = [f"{n}{k}" for k in (1, 2, 3) for n in "cw"]
    return s.createDataFrame(rows, "rule int, " + ", ".join(f"{n} double" for n in names)).select("rule", *[r(n, 4).alias(n) for n in names])


_FIRED = "exp(-0.5::DOUBLE * (" + " + ".join(f"pow((t.x{k} - found[{{0}}].x{k}) / w{k}, 2)" for k in (1, 2, 3)) + "))"
_WEIGHED = [f"({_FIRED.format(j)}) / ({' + '.join(_FIRED.format(i) for i in (1, 2, 3))})" for j in (1, 2, 3)]


@query("z12_consequents", recursive(with_("panel") + _ALL_ROWS + ", " + _sql_centers(3, 2) + _WIDTHS + ", fs AS (SELECT list(x ORDER BY i) AS found FROM cs), "
       + "dz AS (SELECT y, " + ", ".join(f"{w} * {x} AS d{4 * j + i}" for j, w in enumerate(_WEIGHED) for i, x in enumerate(["1.0::DOUBLE", "t.x1", "t.x2", "t.x3"])) + " FROM tr t, fs, wd WHERE y IS NOT NULL), "
       + f"sy AS (SELECT {sql_system([f'd{i}' for i in range(12)], 'y', 10.0)} AS m FROM dz), " + sql_solved("so", "sy", 12)
       + " SELECT i::INT AS i, " + q("beta[i + 1]", 3) + " AS beta FROM so, range(12) r(i)"))
def _(s, d):
    """Rule outputs of the initial model of three rules: clustering, widths, regression sums and elimination, all on whole tables."""
    rows = _train_rows(s, d)
    m = Z.initial_model(rows, INPUTS, rules=3)
    sums = Z.gram_rows(m.staged(Z.finite_rows(rows, INPUTS, "Y_target"), INPUTS, False), [F.col(f"_w{k}") * x for k in range(m.n_rules) for x in [F.lit(1.0), *_xs()]], F.col("Y_target"))
    return Z.solve_rows(sums, 10.0).select(F.posexplode("beta").alias("i", "beta")).select("i", r("beta", 3).alias("beta"))


@query("z14_history")
def _(s, d):
    """Training at its published length."""
    rows = _train_rows(s, d)
    return Z.train(Z.initial_model(rows, INPUTS), rows, INPUTS, "Y_target", epochs=200).to_df(s)


@query("z21_tuning")
def _(s, d):
    """All 36 cells, fitted on the first half of the train window and measured on the second."""
    rows = _train_rows(s, d)
    cut = F.col("date") < F.lit(SECOND[0]).cast("date")
    return X.tune(rows.where(cut), rows.where(~cut), INPUTS, "Y_target")


#: Extra features, fundamentals and input scaling of the compared sets.
FEATURE_SETS = {
    "baseline": ([], False, "raw"), "microstructure": (A.EXTRA, False, "minmax"),
    "fundamentals": ([], True, "minmax"), "all": (A.EXTRA, True, "minmax"),
}


@query("z22_feature_sets")
def _(s, d):
    """All four sets with five rules, trained at the published length."""
    b, horizons, panels = written(B.bars(s, d)), [21, 30, 63], {}
    raw = written(T.raw_panel(b, B.rates(b), B.dividends(s, d), B.meetings(s, d), B.disclosures(s, d), horizons))
    for name, (extra, fundamental, scaling) in FEATURE_SETS.items():
        inputs = A.feature_columns(extra, fundamental)
        p = T.finish_panel(raw, TRAIN, active=inputs, fundamentals=fundamental, horizons=horizons)
        p = written(p.select("ticker", "date", *inputs, "R21", "R30", "R63", "Y_target"))
        panels[name] = (p.where(T.between(*TRAIN)), p.where(T.between(*TEST)), inputs, scaling)
    return X.compare_feature_sets(panels, rules=5, epochs=200)


@query("z23_per_ticker")
def _(s, d):
    return X.train_per_ticker(_train_rows(s, d), INPUTS, "Y_target")


@query("z23_consequents", recursive(with_("panel") + ", dz AS (SELECT ticker, Y_target AS y, " + ", ".join(f"{x} AS d{i}" for i, x in enumerate(_DESIGN)) + f" {_TRAINED}), sy AS (SELECT ticker, {sql_system([f'd{i}' for i in range(12)], 'y', 10.0)} AS m FROM dz GROUP BY ticker), "
       + sql_solved("so", "sy", 12, "ticker") + " SELECT ticker, i::INT AS i, " + q("beta[i + 1]", 3) + " AS beta FROM so, range(12) r(i)"))
def _(s, d):
    """Rule outputs of each ticker's own model with the fixed model's premises: keyed sums and elimination, without Python."""
    rows = panel(s, d, TRAIN).where(F.col("Y_target").isNotNull()).select("ticker", *INPUTS, "Y_target")
    sums = Z.gram_rows(MODEL.staged(rows, INPUTS, False), [F.col(f"_w{k}") * x for k in K for x in [F.lit(1.0), *_xs()]], F.col("Y_target"), ["ticker"])
    return Z.solve_rows(sums, 10.0).select("ticker", F.posexplode("beta").alias("i", "beta")).select("ticker", "i", r("beta", 3).alias("beta"))


_DRAWN = ", nz AS (SELECT *, " + ", ".join(f"{_sql_noise(k, chr(39).join(['0|', ' || draw || ', '']))} AS z{k}" for k in K) + f" FROM (SELECT *, {SQL_SCORE} AS score FROM tested), range(25) t(draw)), md AS (SELECT *, CASE WHEN pre_agm > 0 THEN {_MASKED_SCORE} ELSE score END AS masked FROM nz)"


@query("a20_masked_draws", with_("tested") + _DRAWN + f""" SELECT draw::INT AS draw, count(masked - score) AS n_masked, {q('avg(abs(masked - score))', 5)} AS mean_abs_delta, {q('avg(masked - score)', 5)} AS mean_delta,
    {q('sqrt(avg((masked - Y_target) * (masked - Y_target)))', 4)} AS rmse FROM md WHERE pre_agm > 0 GROUP BY draw""")
def _(s, d):
    many = X.masked_draws(MODEL, panel(s, d, TEST), INPUTS).where("pre_agm > 0")
    delta = many.groupBy("draw").agg(F.count("delta").alias("n_masked"), F.avg(F.abs("delta")).alias("a"), F.avg("delta").alias("m"), F.sqrt(F.avg((F.col("masked") - F.col("Y_target")) ** 2)).alias("e"))
    return delta.select("draw", "n_masked", r("a", 5).alias("mean_abs_delta"), r("m", 5).alias("mean_delta"), r("e", 4).alias("rmse"))


_REPORT = with_("tested") + _DRAWN + """, de AS (SELECT draw, count(masked - score) AS n_masked, avg(abs(masked - score)) AS mean_abs_delta, avg(masked - score) AS mean_delta FROM md WHERE pre_agm > 0 GROUP BY draw),
    ft AS (SELECT draw, sqrt(avg((masked - Y_target) * (masked - Y_target))) AS rmse FROM md WHERE masked IS NOT NULL AND Y_target IS NOT NULL GROUP BY draw),
    pk AS (SELECT draw, date, ticker, R30, row_number() OVER (PARTITION BY draw, date ORDER BY masked DESC, ticker) AS k FROM md WHERE R30 IS NOT NULL AND masked IS NOT NULL AND date IN (SELECT min(date) FROM md GROUP BY date_trunc('month', date))),
    pf AS (SELECT draw, date, avg(R30) AS ret, list(ticker ORDER BY ticker) AS a FROM pk WHERE k <= 3 GROUP BY draw, date HAVING count(*) >= 3),
    hl AS (SELECT *, lag(a) OVER (PARTITION BY draw ORDER BY date) AS b FROM pf),
    cg AS (SELECT *, CASE WHEN b IS NOT NULL THEN (len(list_filter(a, lambda x: NOT list_contains(b, x))) + len(list_filter(b, lambda x: NOT list_contains(a, x)))) / greatest(len(a), 1) END AS c FROM hl),
    st AS (SELECT draw, coalesce(avg(c), 0) / 2 * 12 AS t, avg(ret) AS m, stddev_samp(ret) AS s FROM cg GROUP BY draw),
    sh AS (SELECT draw, CASE WHEN s > 0 THEN (m - t / 12 * 15 / 1e4::DOUBLE) / s * sqrt(12.0) END AS sharpe FROM st),
    ci AS (""" + sql_ic("(SELECT draw, round(masked, 6) AS masked, R30 FROM md)", "masked", "R30", "draw") + f"""),
    rp AS (SELECT draw::INT AS draw, {q('ic', 4)} AS ic, {q('rmse', 4)} AS rmse, n_masked, {q('mean_abs_delta', 4)} AS mean_abs_delta, {q('mean_delta', 4)} AS mean_delta, {q('sharpe', 3)} AS sharpe FROM ci LEFT JOIN ft USING (draw) LEFT JOIN de USING (draw) LEFT JOIN sh USING (draw))"""
_REPORT_DIGITS = {"ic": 4, "rmse": 4, "mean_abs_delta": 4, "mean_delta": 4, "sharpe": 3}


@query("a20_masked_report", _REPORT + " SELECT * FROM rp")
def a20_masked_report(s, d):
    out = X.masked_report(MODEL, panel(s, d, TEST), INPUTS)
    return out.select("draw", "n_masked", *[r(c, e).alias(c) for c, e in _REPORT_DIGITS.items()])


@query("a20_masked_summary", _REPORT + f" SELECT count(*) AS draws, max(n_masked) AS n_masked, {q('avg(mean_abs_delta)', 4)} AS mean_abs_delta, {q('avg(mean_delta)', 4)} AS mean_delta, {q('avg(abs(mean_delta))', 4)} AS mean_abs_bias, " + ", ".join(f"{q(f'{f}({c})', 3)} AS {c}_{n}" for c in ("ic", "rmse", "sharpe") for n, f in (("mean", "avg"), ("sd", "stddev_samp"))) + " FROM rp")
def _(s, d):
    out = X.masked_summary(a20_masked_report(s, d))
    return out.select("draws", "n_masked", *[r(c, 4).alias(c) for c in ("mean_abs_delta", "mean_delta", "mean_abs_bias")], *[r(f"{c}_{n}", 3).alias(f"{c}_{n}") for c in ("ic", "rmse", "sharpe") for n in ("mean", "sd")])


def _sql_draws(source: str, draws: int, block: int) -> str:
    """b, pos, i of moving blocks over the n rows of a numbered source."""
    u = "((('0x' || substr(md5('0|' || b || '|' || j), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    return (f"(SELECT b, j * {block} + k AS pos, floor({u} * (n - {block} + 1))::BIGINT + k AS i FROM range({draws}) x(b), (SELECT count(*) AS n FROM {source}), range(10000) y(j), range({block}) z(k) "
            f"WHERE n >= {block} AND j * {block} < n AND j * {block} + k < n)")


def _sql_interval(col: str, digits: int = 5) -> str:
    return f"count({col}) AS n, {q(f'quantile_cont({col}, 0.025)', digits)} AS low, {q(f'quantile_cont({col}, 0.975)', digits)} AS high"


@query("m2_bootstrap_ci", f"""WITH sr AS (SELECT ic, row_number() OVER (ORDER BY date) - 1 AS i FROM ({SQL['a7_monthly_ic']})),
    ms AS (SELECT b, avg(ic) AS m FROM {_sql_draws('sr', 5000, 6)} JOIN sr USING (i) GROUP BY b)
    SELECT (SELECT count(*) FROM sr) AS n, (SELECT {q('avg(ic)', 5)} FROM sr) AS mean, {q('quantile_cont(m, 0.025)', 5)} AS low, {q('quantile_cont(m, 0.975)', 5)} AS high FROM ms""")
def _(s, d):
    ic = M.monthly_rank_ic(scored_once(s, d)).select("date", r("ic").alias("ic")).cache()
    return X.block_bootstrap(ic, "ic", 5000, 6).select("n", *[r(c, 5).alias(c) for c in ("mean", "low", "high")])


#: Draws of the pooled panel.
PANEL_DRAWS = 5000


def _sql_ranked_draws(lo: int, hi: int) -> str:
    """Moments of the weighted ranks of draws lo to hi, so few at a time that they stay in memory."""
    return f"""SELECT b, sum(w)::DOUBLE AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * y)::DOUBLE AS xy, sum(w * x * x)::DOUBLE AS xx, sum(w * y * y)::DOUBLE AS yy FROM
        (SELECT b, w, sum(w) OVER (PARTITION BY b ORDER BY score) - (sum(w) OVER (PARTITION BY b, score) - 1) / 2.0::DOUBLE AS x, sum(w) OVER (PARTITION BY b ORDER BY R30) - (sum(w) OVER (PARTITION BY b, R30) - 1) / 2.0::DOUBLE AS y
         FROM dw JOIN rw USING (i) WHERE b >= {lo} AND b < {hi}) GROUP BY b"""


@query("m3_panel_bootstrap", with_scored() + f""", dy AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM scored)),
    rw AS MATERIALIZED (SELECT i, score, R30 FROM scored JOIN dy USING (date) WHERE score IS NOT NULL AND R30 IS NOT NULL), dw AS MATERIALIZED (SELECT b, i, count(*) AS w FROM {_sql_draws('dy', PANEL_DRAWS, 30)} GROUP BY ALL),
    mo AS ({' UNION ALL '.join(_sql_ranked_draws(lo, lo + 250) for lo in range(0, PANEL_DRAWS, 250))}),
    ic AS (SELECT CASE WHEN n >= 3 THEN {q('(xy - n * mx * my) / nullif(sqrt((xx - n * mx * mx) * (yy - n * my * my)), 0)')} END AS ic FROM mo) SELECT {_sql_interval('ic')} FROM ic""")
def _(s, d):
    out = X.interval(X.panel_bootstrap(scored(s, d).select("date", "score", "R30"), draws=PANEL_DRAWS).withColumn("ic", r("ic")), "ic")
    return out.select("n", r("low", 5).alias("low"), r("high", 5).alias("high"))


@query("m4_sharpe_ci", with_scored() + _TOP + f""", nb AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i FROM pf),
    h AS (SELECT *, string_split(picks, ',') AS a, string_split(lag(picks) OVER (PARTITION BY b ORDER BY pos), ',') AS l FROM {_sql_draws('nb', 2000, 1)} JOIN nb USING (i)),
    ch AS (SELECT *, CASE WHEN l IS NOT NULL THEN (len(list_filter(a, lambda x: NOT list_contains(l, x))) + len(list_filter(l, lambda x: NOT list_contains(a, x)))) / greatest(len(a), 1) END AS c FROM h),
    st AS (SELECT b, coalesce(avg(c), 0) / 2 * 12 AS t, avg(portfolio_return) AS m, stddev_samp(portfolio_return) AS s FROM ch GROUP BY b),
    sh AS (SELECT CASE WHEN s > 0 THEN {q('(m - t / 12 * 15 / 1e4::DOUBLE) / s * sqrt(12.0)', 5)} END AS sharpe FROM st) SELECT {_sql_interval('sharpe', 4)} FROM sh""")
def _(s, d):
    out = X.interval(X.sharpe_bootstrap(M.top_n_portfolio(scored_once(s, d)).cache(), 15.0).withColumn("sharpe", r("sharpe", 5)), "sharpe")
    return out.select("n", r("low", 4).alias("low"), r("high", 4).alias("high"))


@query("m6_svr_r2")
def _(s, d):
    rows = scored(s, d, None).where("pre_agm > 0").cache()
    return X.reconstruction_r2(rows.where(T.between(*TRAIN)), rows.where(T.between(*TEST)), INPUTS, "score")


@query("m7_svr_shuffled")
def _(s, d):
    rows = scored(s, d, None).where("pre_agm > 0").cache()
    return X.reconstruction_r2(rows.where(T.between(*TRAIN)), rows.where(T.between(*TEST)), INPUTS, "score", shuffled=True)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each ticker in the test window, from raw trades to the fuzzy scorer."""
    return a13_mean_score(spark, sf_dir)


from marketweave.plans import round_trips  # noqa: E402, F401  registers its queries

__all__ = ["QUERIES", "SQL", "flagship", "gated", "series"]
