"""The market engine against pandas and NumPy on small seeded frames, with NULLs, ties and constants."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketweave.functions import scalars as S
from marketweave.functions.windows import global_rank
from marketweave.operators import experiments as X
from marketweave.operators import features as A
from marketweave.operators import fundamentals as P
from marketweave.operators import metrics as M
from marketweave.operators import targets as T
from marketweave.operators import training as Z
from marketweave.operators.fuzzy import FuzzyModel
from marketweave.operators.payout import payout_table
from marketweave.sources import readers, sinks


def make_bars(n=90, tickers=("AA", "BB", "CC", "DD"), seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k, t in enumerate(tickers):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        high, low = close * (1 + rng.uniform(0, 0.02, n)), close * (1 - rng.uniform(0, 0.02, n))
        high[5], low[5] = close[5], close[5]
        volume = rng.integers(100, 1000, n).astype(float)
        out.append(pd.DataFrame({"ticker": t, "date": pd.bdate_range("2024-01-01", periods=n).date, "open": close, "high": high, "low": low, "close": close, "volume": volume}))
    df = pd.concat(out, ignore_index=True)
    df.loc[30, "volume"] = np.nan
    return df


@pytest.fixture(scope="module")
def bars(spark):
    df = make_bars()
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.itertuples(index=False)]
    return df, spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double").cache()


def test_features_match_pandas(bars):
    pdf, sdf = bars
    got = A.compute_features(sdf).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    for t, g in pdf.groupby("ticker"):
        c, v = g.close, g.volume
        vwap = (c * v).rolling(20).sum().shift(1) / v.rolling(20).sum().shift(1)
        eps = 1e-6 * v.rolling(20).mean().shift(1)
        clv = (2 * c - g.high - g.low) / (g.high - g.low + 1e-6)
        flow = np.where(g.high > g.low, clv, np.sign(c.diff()))
        ret = c / c.shift(1) - 1
        want = {
            "dev_price": (c - vwap) / vwap * 100, "dev_volume": np.log((v + eps) / (v.rolling(20).median().shift(1) + eps)), "order_flow": pd.Series(flow, g.index),
            "ret_5": (c.shift(1) / c.shift(6) - 1) * 100, "vol_20": ret.rolling(20).std().shift(1) * 100, "clv_5": clv.rolling(5).mean().shift(1),
            "amihud": (ret.abs() / (c * v)).rolling(20).mean().shift(1) * 1e6,
        }
        mine = got[got.ticker == t]
        for name, series in want.items():
            np.testing.assert_allclose(mine[name].to_numpy(float), series.to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=f"{t} {name}")


def test_no_lookahead(spark, bars):
    pdf, sdf = bars
    cut = sorted(pdf.date.unique())[60]
    later = sdf.withColumn("close", F.when(F.col("date") > F.lit(cut), F.col("close") * 3).otherwise(F.col("close")))
    a, b = (A.compute_features(x).where(F.col("date") <= F.lit(cut)).orderBy("ticker", "date").toPandas() for x in (sdf, later))
    pd.testing.assert_frame_equal(a, b)


def test_order_flow_modes(spark):
    with pytest.raises(ValueError):
        A.order_flow("other")
    with pytest.raises(ValueError):
        A.feature_columns(["nope"])
    assert A.feature_columns(["ret_5"], True) == [*A.BASE, "ret_5", *A.FUNDAMENTAL]
    assert A.winsor_columns(["dev_price", "order_flow", "clv_5"]) == ["dev_price"]
    assert T.target_horizons([5, 21], 30) == [5, 21, 30]


def test_forward_return_and_missing_rate(spark, bars):
    pdf, sdf = bars
    days = sorted(pdf.date.unique())
    rates = spark.createDataFrame([(d, 0.0001) for i, d in enumerate(days) if i != 40], "date date, rf_daily double")
    divs = spark.createDataFrame([("AA", days[10], 2.0)], "ticker string, ex_date date, dividend double")
    got = T.compute_target(sdf.select("ticker", "date", "close"), rates, divs, [5]).where("ticker = 'AA'").orderBy("date").toPandas()
    c = pdf[pdf.ticker == "AA"].close.to_numpy()
    for i in range(len(days)):
        if i + 5 >= len(days) or i < 40 <= i + 5:
            assert math.isnan(got.R5[i])
        else:
            paid = 2.0 if 0 < (days[i] - days[10]).days <= 5 else 0.0
            assert got.R5[i] == pytest.approx((c[i + 5] + paid - c[i]) / c[i] - 5 * 0.0001, abs=1e-12)


def test_pre_meeting_window(spark):
    import datetime as dt

    d = dt.date(2024, 3, 1)
    days = spark.createDataFrame([("A", d - dt.timedelta(k)) for k in (0, 1, 45, 46)], "ticker string, date date")
    got = {r["date"]: r["pre_agm"] for r in T.pre_meeting(days, spark.createDataFrame([("A", d)], "ticker string, agm_date date")).collect()}
    assert [got[d - dt.timedelta(k)] for k in (0, 1, 45, 46)] == [0.0, 1.0, 1.0, 0.0]


def test_parsers(spark):
    texts = ["14,654.70", "﻿12", "-", "", "NA", "abc", " 7 ", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.parse_number(F.col("t"))).collect()]
    assert got == [14654.7, 12.0, None, None, None, None, 7.0, None]
    texts = ["1.43K", "0.11k", "1.83M", "2B", "-", "", "abc", "1.2.3K", "5"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.parse_volume(F.col("t"))).collect()]
    assert got == [1430.0, 110.0, 1830000.0, 2e9, None, None, None, None, 5.0]
    row = spark.range(1).select(S.clip(F.lit(None).cast("double"), 0, 1), S.clip(F.lit(5.0), 0, 1), S.safe_ratio(F.lit(1.0), F.lit(0.0))).first()
    assert list(row) == [None, 1.0, None]
    assert S.bias_bound(0.05, 100) == pytest.approx(0.0625)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "AIR.csv").write_text('﻿"Date","Price","Open","High","Low","Vol.","Change %"\n"02/12/2024","1,200.00","1,180.00","1,220.00","1,100.02","0.11K","0.62%"\n"bad","1","1","1","1","1","1"\n', encoding="utf-8")
    rows = readers.load_bars(spark, [str(tmp_path / "AIR.csv")]).collect()
    assert [(r.ticker, str(r.date), r.close, r.volume) for r in rows] == [("AIR", "2024-02-12", 1200.0, 110.0)]
    head = "Тикер;Компания;Квартал / Полугодие;EBITDA (млн KZT);Net Debt / Чистый долг (млн KZT);FCFE / Свободный поток (млн KZT)\n"
    (tmp_path / "f-2024.csv").write_text("﻿" + head + "kmg;x;Q4;10;5;2\nkmg;x;За 2024 год;40;5;8\nkmg;x;??;1;1;1\n", encoding="utf-8")
    paths = readers.disclosure_paths(str(tmp_path / "f-{year}.csv"), [2024, 2025])
    got = readers.load_disclosures(spark, paths).orderBy("is_annual").collect()
    assert [(r.ticker, str(r.period_end), r.is_annual) for r in got] == [("KMG", "2024-12-31", False), ("KMG", "2024-12-31", True)]
    assert P.effective_disclosures(spark.createDataFrame(got)).first()["ebitda"] == 40.0
    with pytest.raises(FileNotFoundError):
        readers.disclosure_paths(str(tmp_path / "no-{year}.csv"), [2024])
    assert readers.load_dividends(spark, None).count() == 0
    (tmp_path / "r.csv").write_text("Дата,Закрытие\n02.01.24,14.5\n", encoding="utf-8")
    assert readers.load_rate(spark, str(tmp_path / "r.csv")).first()["rf_daily"] == pytest.approx(14.5 / 25200)
    sinks.write_json(f"file://{tmp_path}/new/m.json", {"a": [1, "é"]})
    assert sinks.read_json(str(tmp_path / "new" / "m.json")) == {"a": [1, "é"]} == readers.load_config(f"file://{tmp_path}/new/m.json")
    assert readers.disclosure_paths(f"file://{tmp_path}/f-{{year}}.csv", [2023, 2024]) == {2024: f"file://{tmp_path}/f-2024.csv"}
    (tmp_path / "d.csv").write_text("ticker,ex_date,dividend\nair,2024-05-02,1.5\n", encoding="utf-8")
    assert [(r.ticker, r.dividend) for r in readers.load_dividends(spark, f"file://{tmp_path}/d.csv").collect()] == [("AIR", 1.5)]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c")]


def test_asof_and_fill(spark):
    import datetime as dt

    d = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    left = spark.createDataFrame([("A", d(k)) for k in (0, 5, 10)] + [("B", d(5))], "ticker string, date date")
    right = spark.createDataFrame([("A", d(5), 1.0), ("A", d(7), None)], "ticker string, effective date, x double")
    got = {(r.ticker, r.date): r.x for r in P.asof_backward(left, right, "effective", ["x"]).collect()}
    assert got == {("A", d(0)): None, ("A", d(5)): 1.0, ("A", d(10)): None, ("B", d(5)): None}
    panel = spark.createDataFrame([("A", d(0), 1.0, None, None), ("B", d(0), None, None, None), ("C", d(1), None, 4.0, None)], "ticker string, date date, ebitda_growth double, nd_ebitda double, fcfe_to_ebitda double")
    filled = {r.ticker: (r.ebitda_growth, r.nd_ebitda, r.fcfe_to_ebitda) for r in P.fill_fundamentals(panel).collect()}
    assert filled == {"A": (1.0, 4.0, 0.0), "B": (1.0, 4.0, 0.0), "C": (1.0, 4.0, 0.0)}


def test_rank_ic_ties_constants_and_few(spark):
    def spearman(x, y):
        return np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]

    x, y = [1.0, 2.0, 2.0, 4.0, 5.0, 5.0], [3.0, 1.0, 2.0, 2.0, 9.0, 4.0]
    rows = [("a", u, v) for u, v in zip(x, y)] + [("b", 1.0, 2.0), ("b", 1.0, 3.0), ("b", 1.0, 4.0), ("c", 1.0, 2.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, score double, R30 double")
    got = {r.g: (r.n, r.ic) for r in M.rank_ic(df, by=["g"]).collect()}
    assert got["a"][1] == pytest.approx(spearman(x, y))
    assert got["b"] == (3, None) and got["c"] == (1, None)
    both = [(u, v) for _, u, v in rows if u is not None]
    assert M.rank_ic(df).first()["ic"] == pytest.approx(spearman(*zip(*both)))
    hot = [(float(v % 3 == 0 or v),) for v in range(400)] + [(None,), (-0.0,), (0.0,), (float("nan"),)] + [(50.0,)] * 300
    got = global_rank(spark.createDataFrame(hot, "v double"), "v", "k").toPandas()
    known = spark.createDataFrame(hot, "v double").where("v is not null").toPandas()["v"].fillna(float("inf")).rank()
    assert sorted(got["k"].dropna()) == sorted(known) and got["k"].isna().sum() == 1
    ranks = global_rank(spark.createDataFrame([(float(v % 37),) for v in range(500)], "v double"), "v", "k").toPandas()
    np.testing.assert_allclose(ranks.k, ranks.v.rank())


def test_portfolio_and_sharpe(spark):
    import datetime as dt

    rows = [(t, dt.date(2024, m, 2), s, r) for m, day in ((1, 0), (2, 1), (3, 2)) for t, s, r in (("A", 3.0, 0.1 * m), ("B", 3.0, 0.2), ("C", 3.0, -0.1), ("D", 1.0 + 9 * day, 0.05))]
    rows += [("A", dt.date(2024, 4, 2), 1.0, 0.1)]
    port = M.top_n_portfolio(spark.createDataFrame(rows, "ticker string, date date, score double, R30 double")).orderBy("date").collect()
    assert [r.picks for r in port] == ["A,B,C", "A,B,D", "A,B,D"]
    ret = np.array([r.portfolio_return for r in port])
    got = M.net_sharpe(spark.createDataFrame(port), [15.0]).first()
    turnover = np.mean([2 / 3, 0]) / 2 * 12
    assert got.turnover_annual == pytest.approx(turnover)
    excess = ret - turnover / 12 * 15 / 1e4
    assert got.sharpe == pytest.approx(excess.mean() / excess.std(ddof=1) * math.sqrt(12))


def test_marks(spark):
    import datetime as dt

    v = [1.0, 5.0, 2.0, 8.0]
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1 + i), x) for i, x in enumerate(v)], "ticker string, date date, score double")
    want = {"mean": 4.0, "median": 3.5, "last": 8.0, "ewma": pd.Series(v).ewm(span=21, adjust=False).mean().iloc[-1]}
    for agg, value in want.items():
        assert M.period_marks(df, "M", agg).first()["mark"] == pytest.approx(value)
    with pytest.raises(ValueError):
        M.period_marks(df, "M", "mode")


def fuzzy_numpy(m, x):
    c, s, b = np.array(m.centers), np.maximum(np.array(m.sigmas), m.sigma_floor), np.array(m.consequents)
    z = (x[:, None] - c) / s
    w = np.exp(-0.5 * (z**2).sum(2))
    f = np.column_stack([np.ones(len(x)), x]) @ b.T
    return w, f


@pytest.fixture(scope="module")
def model():
    return FuzzyModel([[0.0, 0.0], [1.0, 1.0]], [[0.5, 0.7], [0.6, 0.4]], [[40.0, 30.0, -5.0], [60.0, -90.0, 20.0]])


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0.5, 0.8, (300, 2))
    x[0] = [500.0, 500.0]
    y = 50 + 20 * np.tanh(x[:, 0]) + rng.normal(0, 1, 300)
    rows = [(f"T{i % 5}", i, float(a), float(b), float(t), float(i % 2)) for i, ((a, b), t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "ticker string, date int, a double, b double, y double, pre_agm double").cache()


def test_scores(spark, model, points):
    x, _, df = points
    w, f = fuzzy_numpy(model, x)
    clipped = np.clip(f, 0, 100)
    total = w.sum(1)
    want = np.where(total < 1e-8, 50.0, np.clip((w * clipped).sum(1) / np.where(total > 0, total, 1), 0, 100))
    xs = [F.col("a"), F.col("b")]
    got = model.with_score(df, ["a", "b"]).orderBy("date").toPandas().score.to_numpy()
    np.testing.assert_allclose(got, want, atol=1e-9)
    assert got[0] == 50.0 and ((got >= 0) & (got <= 100)).all()
    direct = df.select("date", model.score(xs).alias("s"), model.deployed_score(xs, F.col("pre_agm"), 0.0, ["k"]).alias("z"), model.deployed_score(xs, F.lit(0.0), 0.05, ["k", F.col("date").cast("string")]).alias("u")).orderBy("date").toPandas()
    np.testing.assert_allclose(direct.s, want, atol=1e-9)
    np.testing.assert_allclose(direct.z, want, atol=1e-9)
    np.testing.assert_allclose(direct.u, want, atol=1e-9)
    cond = X.conditioning(model, df.where("date > 0"), ["a", "b"]).first()
    assert cond.c <= 100


def test_truncated_normal(spark):
    z = spark.range(4000).select(S.keyed_truncated_normal(0.05, ["s", F.col("id").cast("string")]).alias("z")).toPandas().z
    assert z.abs().max() <= 0.05 and 0.02 < z.std() < 0.024 and abs(z.mean()) < 0.002


def test_training(spark, model, points, tmp_path):
    x, y, df = points
    rows = df.where("date > 0")
    m = FuzzyModel(model.centers, [list(s) for s in model.sigmas], model.consequents)
    Z.fit_consequents(m, rows, ["a", "b"], "y", 10.0)
    w, _ = fuzzy_numpy(m, x[1:])
    wn = w / w.sum(1, keepdims=True)
    one = np.column_stack([np.ones(299), x[1:]])
    design = (wn[:, :, None] * one[:, None]).reshape(299, -1)
    beta = np.linalg.solve(design.T @ design + 10 * np.eye(6), design.T @ y[1:])
    np.testing.assert_allclose(np.ravel(m.consequents), beta, rtol=1e-6)
    g, _, _ = Z.width_gradient(m, rows, ["a", "b"], "y")

    def loss(ls):
        v = FuzzyModel(m.centers, np.exp(ls).tolist(), m.consequents)
        w, f = fuzzy_numpy(v, x[1:])
        return 0.5 * ((((w * f).sum(1) / w.sum(1)) - y[1:]) ** 2).sum()

    ls = np.log(np.array(m.sigmas))
    for i in range(2):
        for j in range(2):
            e = np.zeros((2, 2))
            e[i, j] = 1e-5
            assert g[i, j] == pytest.approx((loss(ls + e) - loss(ls - e)) / 2e-5, rel=1e-4, abs=1e-4)
    h = Z.train(m, rows, ["a", "b"], "y", epochs=2)
    assert len(h.train_loss) == 2 and h.to_df(spark).count() == 2
    Z.save_checkpoint(str(tmp_path / "c.json"), m, h, {"k": 1})
    again, history, extra = Z.load_checkpoint(str(tmp_path / "c.json"))
    assert again.consequents == m.consequents and history.train_loss == h.train_loss and extra == {"k": 1}
    m.save(str(tmp_path / "m.json"))
    assert FuzzyModel.load(str(tmp_path / "m.json")) == m
    b = Z.least_squares(rows, ["a", "b"], "y")
    np.testing.assert_allclose(b, np.linalg.lstsq(one, y[1:], rcond=None)[0], rtol=1e-8)


def brute_centers(x, rules, radius=0.5, ratio=0.5):
    """Plain loops over all rows."""
    span = [max(c) - min(c) or 1.0 for c in zip(*x)]
    z = [[(v - min(c)) / s for v, c, s in zip(row, zip(*x), span)] for row in x]
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    found = []
    while radius > 1e-3:
        p = [round(sum(math.exp(-4 / radius**2 * gap(a, b)) for b in z), 9) for a in z]
        own = []
        while len(own) < rules:
            k = max(range(len(x)), key=lambda i: (p[i], [-v for v in x[i]]))
            if p[k] <= 0:
                break
            own.append(x[k])
            p = [0.0 if x[i] == x[k] else max(p[i] - p[k] * (ratio + math.exp(-4 / (1.25 * radius) ** 2 * gap(z[i], z[k]))), 0.0) for i in range(len(x))]
        found += own
        if len(own) == rules:
            break
        radius *= 0.7
    return found[:rules]


def test_clustering(spark, monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(Z, "CLUSTER_BLOCK", 50)
    x = np.round(np.concatenate([rng.normal(c, 0.05, (40, 2)) for c in (0.0, 1.0, 3.0)]), 3).tolist()
    groups = {"a": x, "b": x[:45] + x[:5], "c": [[1.0, 2.0]] * 3}
    df = spark.createDataFrame([(g, *row) for g, rows in groups.items() for row in rows] + [("a", None, 1.0), ("d", None, None)], "t string, p double, q double")
    got = {r.g: [list(c) for c in r.centers] for r in Z.cluster_centers(df, ["p", "q"], rules=4, by=F.col("t")).collect()}
    assert got == {g: brute_centers(rows, 4) for g, rows in groups.items()}
    with pytest.raises(ValueError):
        Z.initial_model(df.where("t = 'd'"), ["p", "q"])


def test_clustering_takes_all_rows(spark):
    """5000 rows: the centre is that of all pairs at once, per-ticker training takes them all."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.3, (2500, 2)) for c in (0.0, 2.0)])
    df = spark.createDataFrame([("T", i, float(a), float(b), float(a)) for i, (a, b) in enumerate(x)], "ticker string, date int, a double, b double, y double")
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    z = (x - x.min(0)) / (x.max(0) - x.min(0))
    gap = sum((z[:, None, i] - z[None, :, i]) ** 2 for i in range(2))
    want = x[np.exp(-16 * gap).sum(1).argmax()]
    assert Z.initial_model(df, ["a", "b"], rules=1).centers == [want.tolist()]
    assert X.train_per_ticker(df, ["a", "b"], "y", epochs=1).first().n_train == 5000


def test_clustering_by_cells(spark, monkeypatch):
    """Bounded potentials choose what all pairs choose, however few rows get exact ones and however coarse the grid."""
    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.normal(c, s, (60, 2)) for c, s in ((0.0, 0.05), (1.0, 0.3), (3.0, 0.1))]), 3).tolist()
    x += x[:7]
    df = spark.createDataFrame([tuple(row) for row in x] + [(None, 1.0)], "p double, q double")
    want = brute_centers(x, 6)
    for first, cells, chosen in ((4096, 1 << 18, 4096), (4, 1 << 18, 5), (4, 4, 3), (9, 64, 1)):
        monkeypatch.setattr(Z, "FIRST_CELLS", first)
        monkeypatch.setattr(Z, "CELLS", cells)
        monkeypatch.setattr(Z, "CHOSEN", chosen)
        assert [list(c) for c in Z.cluster_centers(df, ["p", "q"], rules=6).first().centers] == want
    same = spark.createDataFrame([(1.0, 2.0)] * 3, "p double, q double")
    assert Z.cluster_centers(same, ["p", "q"], rules=2).first().centers[0] == [1.0, 2.0]
    assert Z.cluster_centers(df.limit(0), ["p", "q"]).count() == 0


def test_cell_bounds(spark):
    """The bound holds for every row and is far below the potentials."""
    rng = np.random.default_rng(6)
    z = rng.random((400, 3)) ** 2
    z = (z - z.min(0)) / (z.max(0) - z.min(0))
    points = spark.createDataFrame([(list(map(float, r)), list(map(float, r)), 1.0 + i % 3) for i, r in enumerate(z)], "x array<double>, z array<double>, n double")
    n = np.array([1.0 + i % 3 for i in range(400)])
    for bins, alpha in ((2, 16.0), (8, 16.0), (16, 33.0), (64, 66.0)):
        true = np.exp(-alpha * ((z[:, None] - z[None]) ** 2).sum(2)) @ n
        value, bound = Z.Cells.of(points, 3, bins).potentials(z, alpha)
        assert (np.abs(value - true) <= bound).all()
        if bins == 16:
            assert bound.max() < 0.2 * true.max()


def test_fused_training(spark, model, points):
    """One aggregate gives what three passes of Column expressions give; a grid's cells and a ticker's rows don't touch each other."""
    _, _, df = points
    rows = df.where("date > 0")
    m = FuzzyModel(model.centers, [list(s) for s in model.sigmas], model.consequents, scale_lo=[-1.0, 0.5], scale_span=[2.0, 3.0])
    sums = Z.moments(Z.training_rows(rows, ["a", "b"], "y"), [m])[0]
    Z.fit_consequents(m, rows, ["a", "b"], "y", 10.0)
    np.testing.assert_allclose(sums.fit(10.0), m.consequents, rtol=1e-6)
    g, _, loss = Z.width_gradient(m, rows, ["a", "b"], "y")
    np.testing.assert_allclose(sums.gradient(np.array(m.consequents)), g, rtol=1e-6, atol=1e-6)
    assert sums.loss(np.array(m.consequents)) == pytest.approx(loss, rel=1e-8) and sums.n == 299
    fresh = lambda: FuzzyModel(model.centers, [list(s) for s in model.sigmas], model.consequents)
    both, alone = [fresh(), fresh()], fresh()
    histories = Z.train_grid(both, [10.0, 1.0], rows, ["a", "b"], "y", epochs=3)
    single = Z.train(alone, rows, ["a", "b"], "y", epochs=3, ridge=1.0)
    np.testing.assert_allclose(histories[1].train_loss, single.train_loss, rtol=1e-9)
    np.testing.assert_allclose(both[1].sigmas, alone.sigmas, rtol=1e-9)
    keyed = [fresh(), fresh()]
    Z.train_grid(keyed, [10.0, 10.0], rows, ["a", "b"], "y", epochs=2, key="ticker", keys=["T1", "T3"])
    own = fresh()
    Z.train(own, rows.where("ticker = 'T3'"), ["a", "b"], "y", epochs=2)
    np.testing.assert_allclose(keyed[1].consequents, own.consequents, rtol=1e-6)
    assert [k.metadata["n_train"] for k in keyed] == [60, 60]
    none = fresh()
    assert Z.train(none, rows.where("date < 0"), ["a", "b"], "y", epochs=1).train_loss == [0.0] and np.abs(none.consequents).max() == 0


def test_resumed_training(spark, model, points, tmp_path):
    _, _, df = points
    rows = df.where("date > 0")
    fresh = lambda: FuzzyModel(model.centers, [list(s) for s in model.sigmas], model.consequents)
    whole, part = fresh(), fresh()
    want = Z.train(whole, rows, ["a", "b"], "y", epochs=3)
    Z.save_checkpoint(str(tmp_path / "c.json"), part, Z.train(part, rows, ["a", "b"], "y", epochs=2), {"k": 1})
    got, history = Z.resume(str(tmp_path / "c.json"), rows, ["a", "b"], "y", 1)
    np.testing.assert_allclose(history.train_loss, want.train_loss, rtol=1e-9)
    np.testing.assert_allclose(got.sigmas, whole.sigmas, rtol=1e-9)
    again, kept, extra = Z.load_checkpoint(str(tmp_path / "c.json"))
    assert again.consequents == got.consequents and kept == history and extra == {"k": 1} and got.metadata["n_epochs"] == 3


def test_elimination(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(f"k{i % 2}", *map(float, r), float(r @ [1, -2, 0.5, 3])) for i, r in enumerate(a)], "k string, a double, b double, c double, d double, y double")
    sums = Z.gram_rows(df, [F.col(c) for c in "abcd"], F.col("y"), ["k"])
    for row in Z.solve_rows(sums, 0.1).collect():
        x = a[int(row.k[1]) :: 2]
        np.testing.assert_allclose(row.beta, np.linalg.solve(x.T @ x + 0.1 * np.eye(4), x.T @ (x @ [1, -2, 0.5, 3])), rtol=1e-9)
    with pytest.raises(ValueError):
        Z.solve_rows(sums, 0.0)


def test_tuning(spark, points):
    _, _, df = points
    rows = df.where("date > 0")
    table = X.tune(rows.where("date < 150"), rows.where("date >= 150"), ["a", "b"], "y", {"n_rules": [2, 3], "cluster_radius": [0.5], "ridge_lambda": [1.0, 100.0]}, epochs=2).cache()
    got = table.orderBy("cell").collect()
    assert [(r.n_rules, r.ridge_lambda) for r in got] == [(2, 1.0), (2, 100.0), (3, 1.0), (3, 100.0)] and all(r.empirical_C <= 100 and r.final_loss > 0 for r in got)
    m = Z.initial_model(rows.where("date < 150"), ["a", "b"], 3)
    h = Z.train(m, rows.where("date < 150"), ["a", "b"], "y", 2, 100.0)
    assert got[3].final_loss == pytest.approx(h.train_loss[-1])
    one = X.evaluate(rows.where("date >= 150"), ["a", "b"], m, "y").first()
    assert (got[3].val_rmse, got[3].val_rank_ic) == (pytest.approx(one.rmse), pytest.approx(one.rank_ic))
    fake = spark.createDataFrame([(0, 0.9, 120.0), (1, 0.5, 100.0), (2, None, 1.0), (3, 0.7, None)], "cell int, val_rank_ic double, empirical_C double")
    assert X.best_cell(fake).first().cell == 1 and X.best_cell(fake.where("cell in (0, 3)")).first().cell == 0
    assert [r.cell for r in X.tuning_head(fake, 2).collect()] == [0, 3]


def test_panel_bootstrap_broadcasts_no_ranks(spark):
    import datetime as dt

    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i * 7 % 11), float(i * 5 % 13)) for i in range(40)]
    out = X.panel_bootstrap(spark.createDataFrame(rows, "date date, score double, R30 double"), draws=600, block=5)
    assert out._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin [block") == 2
    # Drawn weights are made in tasks, a block of draws at a time, and are those of all draws at once.
    drawn = X.Draws(40, 600, 5, 0, np.ones(40, np.int64))
    assert (np.concatenate([drawn.weights(k) for k in range(drawn.blocks)], 1) == X.date_weights(40, 600, 5, 0)).all()
    assert out.count() == 600


def test_panel_bootstrap(spark, monkeypatch):
    """Weighted ranks equal ranks of repeated rows: ties, a hot value, missing values, slices of few values and short blocks of draws."""
    import datetime as dt

    monkeypatch.setattr(X, "DRAWS_HELD", 7)
    monkeypatch.setattr(X, "RANKED_VALUES", 5)
    rng = np.random.default_rng(8)
    rows = []
    for d in range(12):
        for k in range(4):
            rows.append((dt.date(2001, 1, 1) + dt.timedelta(d), 50.0 if rng.random() < 0.4 else float(rng.integers(0, 20)), None if rng.random() < 0.1 else float(rng.integers(-5, 5))))
    df = spark.createDataFrame([*rows, rows[0]], "date date, score double, R30 double")
    got = {r.b: (r.n, r.ic) for r in X.panel_bootstrap(df, draws=20, block=5, seed=3).collect()}
    drawn = X.panel_draws(df, 20, 5, 3).toPandas()
    panel = df.toPandas().dropna()
    for b, own in drawn.groupby("b"):
        many = own.merge(panel, on="date")
        assert got[b][0] == len(many) and got[b][1] == pytest.approx(many.score.rank().corr(many.R30.rank()))
    assert len(got) == 20 and X.panel_bootstrap(df, draws=5, block=50).count() == 0
    flat = df.withColumn("score", F.lit(1.0))
    assert all(r.ic is None for r in X.panel_bootstrap(flat, draws=3, block=5).collect())


def test_bootstraps_and_adversary(spark, points):
    series = spark.createDataFrame([(f"2001-{1 + i // 25:02d}-{1 + i % 25:02d}", float(i)) for i in range(100)] + [("2002-01-01", None)], "date string, ic double")
    row = X.block_bootstrap(series, draws=500, block=10).first()
    assert row.n == 100 and row.mean == 49.5 and 30 < row.low < 49.5 < row.high < 70
    short = X.block_bootstrap(series.limit(1), draws=10, block=5).first()
    assert (short.n, short.low, short.high) == (1, None, None)
    drawn = X.block_draws(spark, 7, 50, 3, 0).toPandas()
    for _, g in drawn.groupby("b"):
        g = g.sort_values("pos")
        assert list(g.pos) == list(range(7)) and all(g.i.iloc[k] + 1 == g.i.iloc[k + 1] for k in (0, 1, 3, 4)) and g.i.between(0, 6).all()
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 2))
    y = np.sin(x[:, 0])
    beta, base, gamma = X.svr_fit(x, y)
    fit = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2)) @ beta + base
    assert np.abs(fit - y).max() < 0.6 and X._r2(y, fit) > 0.9
    _, _, df = points
    rows = df.where("date > 0")
    got = X.reconstruction_r2(rows.where("pre_agm = 0"), rows.where("pre_agm = 1"), ["a", "b"], "y").first()
    assert got.n_train == 149 and got.r2 is not None
    few = X.reconstruction_r2(rows.limit(3), rows.limit(3), ["a", "b"], "y").first()
    assert few.r2 is None
    assert X.train_per_ticker(rows, ["a", "b"], "y", epochs=2).count() == 5


def test_registered_adversary_takes_all_rows(spark, monkeypatch):
    import datetime as dt

    from marketweave.plans import queries as Q

    x = np.random.default_rng(4).normal(size=(4300, len(Q.INPUTS)))
    days = [dt.date(1996, 6, 1) if i < 2100 else dt.date(1999, 6, 1) for i in range(4300)]
    rows = [(f"T{i}", d, 1.0, *map(float, r), float(r[0])) for i, (d, r) in enumerate(zip(days, x))]
    df = spark.createDataFrame(rows, "ticker string, date date, pre_agm double, " + ", ".join(f"{c} double" for c in Q.INPUTS) + ", score double")
    monkeypatch.setattr(Q, "scored", lambda *_: df)
    plain, shuffled = (Q.QUERIES[name](spark, "").first() for name in ("m6_svr_r2", "m7_svr_shuffled"))
    assert (plain.n_train, plain.n_test) == (shuffled.n_train, shuffled.n_test) == (2100, 2200)
    assert plain.r2 > 0.9 > shuffled.r2


def test_payout(spark):
    import datetime as dt

    d = dt.date(2024, 12, 31)
    rows = [("A", d, 10.0, 5.0, 2.0, False), ("A", d, 40.0, 20.0, 8.0, True), ("B", d, 0.0, 1.0, 1.0, False), ("C", d, 10.0, 5.0, -1.0, False)]
    dis = spark.createDataFrame(rows, "ticker string, period_end date, ebitda double, net_debt double, fcfe double, is_annual boolean")
    got = {r.ticker: r.PR_target for r in payout_table(dis, spark.createDataFrame([("A", 50.0), ("B", 50.0), ("C", 50.0)], "ticker string, Y_attr double")).collect()}
    assert got["A"] == pytest.approx(0.5 / (1 + math.exp(3 * (0.5 - 1)))) and got["B"] is None and got["C"] == 0.0


def test_training_rows_are_a_table_in_one_wave(spark):
    """An epoch's plan holds no work that came before it, and a task for each core, not for each partition of a shuffle."""
    df = spark.range(50).select(F.col("id").alias("g"), (F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("y")).groupBy("a", "y").agg(F.max("g").alias("g"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = Z.training_rows(df, ["a"], "y")
        assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert "Aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString()
        model = FuzzyModel([[0.0], [5.0]], [[2.0], [2.0]], [[0.0, 0.0]] * 2)
        x = np.array([i % 7 for i in range(50)], float)[:, None]
        own = Z.moment_vector(x, np.arange(50.0), np.array(model.centers), np.array(model.sigmas))
        assert Z.moments(rows, [model])[0].squares == pytest.approx(Z.Moments(own, 2, 1).squares)
        rows.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_feature_sets_are_whole(spark, monkeypatch):
    """The query compares all four sets, with the published number of rules and epochs."""
    from marketweave.plans import queries as Q

    asked = {}
    monkeypatch.setattr(Q, "written", lambda df: df)
    monkeypatch.setattr(Q.X, "compare_feature_sets", lambda panels, **settings: asked.update(panels=panels, **settings))
    Q.QUERIES["z22_feature_sets"](spark, "/root/testdata/sf0.001")
    assert {name: (len(p[2]), p[3]) for name, p in asked["panels"].items()} == {"baseline": (3, "raw"), "microstructure": (8, "minmax"), "fundamentals": (6, "minmax"), "all": (11, "minmax")}
    assert all(set(p[2]) <= set(p[0].columns) and set(p[2]) <= set(p[1].columns) for p in asked["panels"].values())
    assert (asked["rules"], asked["epochs"]) == (5, 200)


def test_sets_of_unlike_inputs_train_side_by_side(spark):
    """A set's row is that of its model trained alone, whatever the other sets' inputs and rows."""
    rng = np.random.default_rng(3)
    days = pd.bdate_range("2024-01-01", periods=100).date
    rows = [(f"T{t}", d, *map(float, rng.normal(size=3)), float(rng.uniform(0, 100)), *map(float, rng.normal(size=3))) for t in range(4) for d in days]
    df = spark.createDataFrame(rows, "ticker string, date date, a double, b double, c double, Y_target double, R21 double, R30 double, R63 double").cache()
    df = df.withColumn("c", F.when(F.col("ticker") != "T0", F.col("c")))
    train, test = df.where("date < '2024-04-01'"), df.where("date >= '2024-04-01' and c is not null")
    got = {r["set"]: r for r in X.compare_feature_sets({"few": (train, test, ["b"], "raw"), "many": (train, test, ["a", "b", "c"], "minmax")}, rules=2, epochs=3).collect()}
    for name, inputs, scaling in (("few", ["b"], "raw"), ("many", ["a", "b", "c"], "minmax")):
        m = Z.initial_model(train, inputs, 2, scaling=scaling)
        Z.train(m, train, inputs, "Y_target", 3)
        fit = M.fit_metrics(m.with_score(test, inputs), "score", "Y_target").first()
        assert (got[name].rmse, got[name].mae) == (pytest.approx(fit.rmse, rel=1e-9), pytest.approx(fit.mae, rel=1e-9))
        assert got[name].n_inputs == len(inputs) and got[name].n_free_params == m.counts()["free"]


def test_clustering_of_many_inputs(spark, monkeypatch):
    """With more inputs than a grid can part, blocks of rows meet pair by pair; choices are those of plain loops, copies and mirrored rows included."""
    rng = np.random.default_rng(11)
    monkeypatch.setattr(Z, "CLUSTER_BLOCK", 20)
    x = np.round(np.concatenate([rng.normal(c, s, (25, 6)) for c, s in ((0.0, 0.1), (1.0, 0.3))]), 3)
    x = np.concatenate([x, x[:4]])
    for rows in (x.tolist(), np.concatenate([x, -x]).tolist()):
        df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"x{k} double" for k in range(6)))
        assert [list(c) for c in Z.cluster_centers(df, [f"x{k}" for k in range(6)], rules=4).first().centers] == brute_centers(rows, 4)
