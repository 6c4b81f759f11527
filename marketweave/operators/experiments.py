"""Bootstraps, masking draws, conditioning, tuning, feature sets, per-ticker training and the reconstruction adversary."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.scalars import keyed_truncated_normal, keyed_uniform
from marketweave.operators.fuzzy import FuzzyModel
from marketweave.operators.metrics import fit_metrics, mark_rank_ic, mean_and_error, net_sharpe, rank_ic, top_n_portfolio
from marketweave.operators.training import cluster_centers, finite_rows, forward, initial_model, least_squares, linear_score, train_grid
from marketweave.sources.scratch import collect_garbage, written


def block_draws(spark, n: int, draws: int, block: int, seed: int) -> DataFrame:
    """b, pos, i: each draw's n positions from moving blocks of 0 .. n-1, by a keyed hash (the same on every engine); empty if n is under a block."""
    if n < block:
        return spark.createDataFrame([], "b int, pos int, i int")
    rows = spark.range(draws).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(-(-n // block) - 1))).alias("j"))
    start = F.floor(keyed_uniform(str(seed), F.col("b").cast("string"), F.col("j").cast("string")) * F.lit(n - block + 1)).cast("int")
    rows = rows.withColumn("s", start).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    return rows.select("b", (F.col("j") * block + F.col("k")).alias("pos"), (F.col("s") + F.col("k")).alias("i")).where(F.col("pos") < n)


def numbered(days: DataFrame, by: str = "date") -> DataFrame:
    """i = 0, 1, ... in order; for one row per date."""
    return days.withColumn("i", F.row_number().over(Window.orderBy(by)) - 1)


def block_bootstrap(series: DataFrame, col: str = "ic", draws: int = 5000, block: int = 30, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """n, mean, low, high: mean of a series by date and its interval from moving blocks; NULL bounds if it is shorter than a block."""
    rows = numbered(series.where(F.col(col).isNotNull() & ~F.isnan(col))).select("i", F.col(col).alias("x"))
    means = block_draws(series.sparkSession, rows.count(), draws, block, seed).join(rows, "i").groupBy("b").agg(F.avg("x").alias("m"))
    bounds = means.agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
    return rows.agg(F.count("x").alias("n"), F.avg("x").alias("mean")).crossJoin(bounds)  # one row and one row


def panel_draws(panel: DataFrame, draws: int, block: int, seed: int) -> DataFrame:
    """b, pos, date: each draw's dates from moving blocks of the panel's sorted dates."""
    days = numbered(panel.select("date").distinct())
    return block_draws(panel.sparkSession, days.count(), draws, block, seed).join(days, "i").select("b", "pos", "date")


def date_weights(n: int, draws: int, block: int, seed: int, first: int = 0) -> np.ndarray:
    """How often each of n dates is in each of so many draws from `first` on (n x draws): block_draws, counted. Bounded by dates and draws, whatever the number of rows."""
    out = np.zeros((n + 1, draws), np.int32)
    if n < block:
        return np.zeros((n, 0), np.int32)
    for b in range(draws):
        for j in range(-(-n // block)):
            u = (int(hashlib.md5(f"{seed}|{first + b}|{j}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0
            start = int(u * (n - block + 1))
            out[start, b] += 1
            out[start + min(block, n - j * block), b] -= 1
    return np.cumsum(out[:n], 0, dtype=np.int32)


#: Draws whose ranks a row carries at a time; distinct values of a slice, about.
DRAWS_HELD, RANKED_VALUES = 256, 1024


class Draws:
    """The draws in blocks of DRAWS_HELD. Weights are made where they are needed, so that neither plans nor the driver carry them."""

    def __init__(self, dates: int, draws: int, block: int, seed: int, totals: np.ndarray) -> None:
        self.dates, self.draws, self.block, self.seed, self.totals, self.held = dates, draws, block, seed, totals, DRAWS_HELD
        self.blocks = -(-draws // self.held)
        # A draw has as many dates as the panel, so no rank, doubled, is over this.
        self.kind = np.dtype("<i4" if 2 * dates * int(totals.max(initial=0)) < 1 << 31 else "<i8")

    def weights(self, k: int) -> np.ndarray:
        return _held_weights(self.dates, min(self.held, self.draws - k * self.held), self.block, self.seed, k * self.held)


@lru_cache(maxsize=32)
def _held_weights(n: int, draws: int, block: int, seed: int, first: int) -> np.ndarray:
    return date_weights(n, draws, block, seed, first).astype(np.int64)


def _weighted_ranks(rows: DataFrame, col: str, drawn: Draws) -> DataFrame:
    """block, value, ranks (packed integers): twice the tie-averaged rank of each value, less twice the mean rank, among the rows of every draw of a block of draws.

    A draw weighs a row by its date, so it is enough to know how many rows of each date have a value. Values are cut into slices; what lies below a slice is a count for each date,
    and inside a slice the weights of its values are summed upwards. No row is repeated, and a value that most rows share is one entry for each date.
    """
    counts = rows.groupBy(F.col(col).alias("value"), "i").agg(F.count(F.lit(1)).alias("n")).persist()
    values = counts.select("value").distinct()
    n = max(1, -(-values.count() // RANKED_VALUES))
    cuts = sorted(set(values.approxQuantile("value", [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    cut = counts.withColumn("slice", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("value"))) if cuts else F.lit(0))
    # Rows of each date below each slice: one row per slice with an array by date.
    upto = Window.partitionBy("i").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    grid = cut.select("slice").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(drawn.dates - 1))))
    below = grid.join(cut.groupBy("slice", "i").agg(F.sum("n").alias("n")), ["slice", "i"], "left").withColumn("below", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(upto), F.lit(0)))
    below = below.groupBy(F.col("slice").alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "below"))), lambda v: v["below"]).alias("below"))

    def run(table: pa.Table, ahead: pa.Table) -> pa.Table:
        value, date, n = (np.asarray(table[c]) for c in ("value", "i", "n"))
        order = np.argsort(value, kind="stable")
        value, date, n = value[order], date[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        base = np.asarray(ahead["below"][0].as_py(), np.int64)
        out = []
        for block in range(drawn.blocks):
            w = drawn.weights(block)
            own = np.add.reduceat(n[:, None] * w[date], starts, axis=0)
            ranks = (2 * (base @ w + np.cumsum(own, 0)) - own - drawn.totals @ w).astype(drawn.kind)
            out.append(pa.table({"block": np.full(len(starts), block, np.int32), "value": value[starts], "ranks": pa.array([v.tobytes() for v in ranks], pa.binary())}))
        return pa.concat_tables(out)

    # Few bytes, much work: about a slice for each task.
    dealt = cut.select("slice", "value", "i", "n").repartition(min(n, 4096), "slice")
    return dealt.groupBy("slice").cogroup(below.groupBy("at")).applyInArrow(run, "block int, value double, ranks binary")


def panel_bootstrap(panel: DataFrame, score: str = "score", ret: str = "R30", draws: int = 5000, block: int = 30, seed: int = 0) -> DataFrame:
    """b, n, ic: the pooled rank correlation of every draw of moving blocks of dates; a date drawn twice counts twice. Empty if there are fewer dates than a block.

    Values are ranked once for all draws (`_weighted_ranks`); a row meets the ranks of its score and of its return for DRAWS_HELD draws at a time, and only sums by draw go on.
    Nothing of the ranks may be broadcast: they are far wider than Spark takes them to be.
    """
    spark = panel.sparkSession
    panel = written(panel.select("date", F.col(score).cast("double").alias("x"), F.col(ret).cast("double").alias("y")))
    days = numbered(panel.select("date").distinct()).persist()
    dates = days.count()
    if dates < block:
        return spark.createDataFrame([], "b int, n long, ic double")
    rows = panel.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    # + 0.0: both zeros are one value
    rows = rows.join(days, "date").select("i", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))
    rows = written(rows)
    totals = np.zeros(dates, np.int64)
    for r in rows.groupBy("i").count().collect():  # one row per date
        totals[r["i"]] = r["count"]
    drawn = Draws(dates, draws, block, seed, totals)
    ranks = {c: _weighted_ranks(rows, c, drawn).select("block", F.col("value").alias(c), F.col("ranks").alias(f"r{c}")) for c in "xy"}
    many = rows.groupBy("i", "x", "y").agg(F.count(F.lit(1)).alias("k")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(drawn.blocks - 1))))
    met = many.join(ranks["x"].hint("merge"), ["block", "x"]).join(ranks["y"].hint("merge"), ["block", "y"]).select("block", "i", "k", "rx", "ry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            block, i, k = (np.asarray(c) for c in b.columns[:3])
            for own in np.unique(block):
                at = np.flatnonzero(block == own)
                for lo in range(0, len(at), 1024):
                    some = at[lo : lo + 1024]
                    rx, ry = (np.frombuffer(b"".join(v.as_buffer() for v in c.take(pa.array(some))), drawn.kind).reshape(len(some), -1).astype(np.float64) for c in b.columns[3:])
                    w = (drawn.weights(int(own))[i[some]] * k[some, None]).astype(np.float64)
                    wx = w * rx
                    part = np.stack([w.sum(0), (wx * ry).sum(0), (wx * rx).sum(0), (w * ry * ry).sum(0)])
                    totals[own] = part if own not in totals else totals[own] + part
        for own, part in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.shape[1], dtype=np.int32) + own * drawn.held, pa.int32()), *[pa.array(v) for v in part]], names=["b", "n", "xy", "xx", "yy"])

    sums = met.mapInArrow(run, "b int, n double, xy double, xx double, yy double").groupBy("b").agg(*[F.sum(c).alias(c) for c in ("n", "xy", "xx", "yy")])
    ic = F.when(F.col("n") >= 3, F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0)))
    return sums.select("b", F.col("n").cast("long").alias("n"), ic.alias("ic"))


def interval(series: DataFrame, col: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return series.agg(F.count(col).alias("n"), F.percentile(F.col(col), F.lit(low)).alias("low"), F.percentile(F.col(col), F.lit(high)).alias("high"))


def sharpe_bootstrap(portfolio: DataFrame, cost_bps: float, draws: int = 2000, seed: int = 0) -> DataFrame:
    """b, sharpe: months drawn with replacement; turnover follows the drawn order."""
    index = numbered(portfolio).select("i", "portfolio_return", "picks")
    return net_sharpe(block_draws(portfolio.sparkSession, index.count(), draws, 1, seed).join(index, "i"), [cost_bps], by=["b"], order="pos").select("b", "sharpe")


def horizon_table(scored: DataFrame, train_rows: DataFrame, inputs: list[str], horizons: list[int]) -> DataFrame:
    """One row per horizon: n_labelled, rmse, mae, pooled_rank_ic, per_asset_mean_rank_ic and, for least squares on the same labels,
    ols_pooled_rank_ic. A horizon without a label has 0 and NULLs."""
    out = None
    for h in horizons:
        label, ret = f"Y_target_{h}", f"R{h}"
        pooled = rank_ic(scored, "score", ret).select(F.col("ic").alias("pooled_rank_ic"))
        fit = scored.where(F.col(label).isNotNull()).agg(F.count(F.lit(1)).alias("n_labelled"), F.sqrt(F.avg((F.col("score") - F.col(label)) ** 2)).alias("rmse"), F.avg(F.abs(F.col("score") - F.col(label))).alias("mae"))
        own = rank_ic(scored.where(F.col(label).isNotNull()), "score", ret, ["ticker"]).agg(F.avg("ic").alias("per_asset_mean_rank_ic"))
        ols = scored.withColumn("ols", linear_score(least_squares(train_rows, inputs, label), inputs))
        ols = rank_ic(ols, "ols", ret).select(F.col("ic").alias("ols_pooled_rank_ic"))
        row = fit.crossJoin(pooled).crossJoin(own).crossJoin(ols).withColumn("horizon_days", F.lit(h))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def evaluate(df: DataFrame, inputs: list[str], model: FuzzyModel, label: str) -> DataFrame:
    """n, rmse, mae, dir_acc and rank_ic of the unclipped prediction on finite rows."""
    rows = model.with_prediction(finite_rows(df, inputs, label), inputs)
    return fit_metrics(rows, "prediction", label).crossJoin(rank_ic(rows, "prediction", label).select(F.col("ic").alias("rank_ic")))  # one row each


def conditioning(model: FuzzyModel, df: DataFrame, inputs: list[str]) -> DataFrame:
    """max_abs, mean_abs of the rule outputs as scored, and c: the largest distance of one from the score."""
    xs = [F.col(c) for c in inputs]
    rows = finite_rows(df, inputs)
    mean = sum((w * f for w, f in zip(model.weights(xs), model.rule_outputs(xs, model.clip_rule_outputs), strict=True)), F.lit(0.0))
    r = rows.select(F.array(*model.rule_outputs(xs, model.clip_rule_outputs)).alias("f"), mean.alias("y"))
    r = r.select(F.array_max(F.transform("f", F.abs)).alias("m"), F.aggregate("f", F.lit(0.0), lambda a, x: a + F.abs(x)).alias("s"), F.size("f").alias("k"), F.array_max(F.transform("f", lambda x: F.abs(x - F.col("y")))).alias("c"))
    return r.agg(F.max("m").alias("max_abs"), (F.sum("s") / F.sum("k")).alias("mean_abs"), F.max("c").alias("c"))


def masked_draws(model: FuzzyModel, df: DataFrame, inputs: list[str], draws: int = 25, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """df once for each draw with score, masked and delta; rows without the flag keep their score."""
    xs = [F.col(c) for c in inputs]
    many = model.with_score(df, inputs).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    key = [str(seed), F.col("draw").cast("string"), F.col("ticker"), F.col("date").cast("string")]
    noise = [keyed_truncated_normal(alpha, [*key, str(k)]) for k in range(model.n_rules)]
    masked = F.when(F.col("pre_agm") > 0, model.masked_score(xs, noise)).otherwise(F.col("score"))
    return many.withColumn("masked", masked).withColumn("delta", F.col("masked") - F.col("score"))


def masked_report(model: FuzzyModel, df: DataFrame, inputs: list[str], draws: int = 25, alpha: float = 0.05, cost_bps: float = 15.0, top_n: int = 3, seed: int = 0) -> DataFrame:
    """One row per draw: n_masked, mean_abs_delta, mean_delta, ic, rmse and sharpe of the masked scores."""
    many = masked_draws(model, df, inputs, draws, alpha, seed).withColumn("masked", F.round("masked", 6)).persist()
    delta = many.where("pre_agm > 0").groupBy("draw").agg(F.count("delta").alias("n_masked"), F.avg(F.abs("delta")).alias("mean_abs_delta"), F.avg("delta").alias("mean_delta"))
    ic = rank_ic(many, "masked", "R30", ["draw"]).select("draw", "ic")
    fit = fit_metrics(many, "masked", "Y_target", ["draw"]).select("draw", "rmse")
    days = many.join(many.groupBy(F.date_trunc("month", "date").alias("m")).agg(F.min("date").alias("date")).select("date"), "date", "left_semi").where("R30 is not null and masked is not null")
    place = F.row_number().over(Window.partitionBy("draw", "date").orderBy(F.col("masked").desc(), "ticker"))
    picks = days.withColumn("k", place).where(F.col("k") <= top_n).groupBy("draw", "date").agg(F.avg("R30").alias("portfolio_return"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("picks")).where(F.col("n") >= top_n)
    sharpe = net_sharpe(picks, [cost_bps], by=["draw"]).select("draw", "sharpe")
    return ic.join(fit, "draw", "left").join(delta, "draw", "left").join(sharpe, "draw", "left")


#: The published grid: 36 cells.
GRID = {"n_rules": [3, 5, 7], "cluster_radius": [0.3, 0.4, 0.5, 0.6], "ridge_lambda": [1.0, 10.0, 100.0]}


def validate(models: list[FuzzyModel], df: DataFrame, inputs: list[str], label: str) -> DataFrame:
    """One row per model, cell = 0, 1, ...: val_rank_ic, val_rmse and val_mae of the unclipped prediction on finite labelled rows, and empirical_C of the rule outputs as scored.

    All models read a row at once; what follows is keyed by cell. Cells without rows are missing.
    """
    shapes = [(np.array(m.centers), np.array(m.sigmas), np.array(m.consequents), np.array(m.scale_lo or [0.0] * m.n_inputs), np.array(m.scale_span or [1.0] * m.n_inputs), m) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *xs, y = (np.asarray(c) for c in b.columns)
            raw = np.column_stack(xs)
            for k, (centers, sigmas, beta, lo, span, m) in enumerate(shapes):
                x = (raw - lo) / span
                w, _ = forward(x, centers, sigmas, m.sigma_floor)
                f = beta[:, 0] + x @ beta[:, 1:].T
                used = np.clip(f, 0.0, m.top) if m.clip_rule_outputs else f
                far = np.abs(used - (w * used).sum(1, keepdims=True)).max(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array((w * f).sum(1)), pa.array(y), pa.array(far)], names=["cell", "prediction", "y", "far"])

    rows = finite_rows(df, inputs, label).select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(inputs)], F.col(label).cast("double").alias("y"))
    found = rows.mapInArrow(run, "cell int, prediction double, y double, far double").persist()
    ic = rank_ic(found, "prediction", "y", ["cell"]).select("cell", F.col("ic").alias("val_rank_ic"))
    fit = fit_metrics(found, "prediction", "y", ["cell"]).select("cell", F.col("rmse").alias("val_rmse"), F.col("mae").alias("val_mae"))
    return ic.join(fit, "cell").join(found.groupBy("cell").agg(F.max("far").alias("empirical_C")), "cell")


def tune(df_fit: DataFrame, df_valid: DataFrame, inputs: list[str], label: str, grid: dict[str, list] | None = None, epochs: int = 20, feature_scaling: str = "raw") -> DataFrame:
    """Fits every cell of the grid (n_rules, cluster_radius, ridge_lambda) and measures it on the validation rows: one row per cell, with final_loss.

    All cells train side by side (an aggregate per epoch for the whole grid); cells that share rules and radius share their clustering, and a radius' centres for few rules are the first
    of those for many.
    """
    grid = grid or GRID
    cells = list(itertools.product(grid["n_rules"], grid["cluster_radius"], grid["ridge_lambda"]))
    first = {r: initial_model(df_fit, inputs, max(grid["n_rules"]), r, scaling=feature_scaling) for r in grid["cluster_radius"]}
    models = []
    for rules, radius, _ in cells:
        m = first[radius]
        models.append(replace(m, centers=m.centers[:rules], sigmas=m.sigmas[:rules], consequents=m.consequents[:rules], metadata={}))
    histories = train_grid(models, [c[2] for c in cells], df_fit, inputs, label, epochs)
    rows = [(k, int(c[0]), float(c[1]), float(c[2]), h.train_loss[-1] if epochs else None) for k, (c, h) in enumerate(zip(cells, histories, strict=True))]
    table = df_fit.sparkSession.createDataFrame(rows, "cell int, n_rules int, cluster_radius double, ridge_lambda double, final_loss double")
    return table.join(validate(models, df_valid, inputs, label), "cell", "left")


def tuning_head(table: DataFrame, n: int = 10) -> DataFrame:
    """The n cells with the highest validation rank correlation, best first."""
    return table.orderBy(F.col("val_rank_ic").desc_nulls_last(), "cell").limit(n)


def best_cell(table: DataFrame, most: float = 100.0) -> DataFrame:
    """The best cell by validation rank correlation among those whose empirical_C is at most `most`; among all if none is."""
    feasible = F.coalesce(F.col("empirical_C") <= most, F.lit(False))
    return table.orderBy(feasible.desc(), F.col("val_rank_ic").desc_nulls_last(), "cell").limit(1)


def compare_feature_sets(panels: dict[str, tuple[DataFrame, DataFrame, list[str], str]], label: str = "Y_target", rules: int = 5, epochs: int = 200) -> DataFrame:
    """panels: name -> (train, test, inputs, input scaling). One row per set: inputs, features, free parameters, rmse, mae, pooled IC, net Sharpe at 15 bps and mean ICs of monthly and
    quarterly marks (R21 and R63 of the test rows). The sets' models train side by side, each on its own rows: an epoch is one aggregate for all sets."""
    names, spark = list(panels), next(iter(panels.values()))[0].sparkSession
    most, rows = max(len(p[2]) for p in panels.values()), None
    for name, (train_df, _, inputs, _) in panels.items():
        # A set's inputs in their order; its model doesn't read the rest.
        own = finite_rows(train_df, inputs, label).select(F.lit(name).alias("set"), *[(F.col(inputs[k]).cast("double") if k < len(inputs) else F.lit(0.0)).alias(f"in{k}") for k in range(most)], F.col(label).alias("label"))
        rows = own if rows is None else rows.unionByName(own)

    def begun(name: str) -> FuzzyModel:
        train_df, _, inputs, scaling = panels[name]
        return initial_model(train_df.where(F.col(label).isNotNull()), inputs, rules, scaling=scaling)

    def measured(name: str) -> tuple:
        _, test_df, inputs, _ = panels[name]
        model = models[name]
        scored = written(model.with_score(test_df, inputs)).persist()
        fit, ic = fit_metrics(scored, "score", label).first(), rank_ic(scored).first()
        sharpe = net_sharpe(top_n_portfolio(scored), [15.0]).first()
        marks = [mean_and_error(mark_rank_ic(scored, unit, h)).first()["mean"] for unit, h in (("month", 21), ("quarter", 63))]
        scored.unpersist()
        collect_garbage(spark)
        return name, len(inputs), ",".join(inputs), model.counts()["free"], fit["rmse"], fit["mae"], ic["ic"], sharpe["sharpe"] if sharpe else None, *marks

    with ThreadPoolExecutor(len(names)) as pool:  # many small jobs, those of the sets side by side
        models = dict(zip(names, pool.map(begun, names), strict=True))
    train_grid(list(models.values()), [10.0] * len(names), rows, [f"in{k}" for k in range(most)], "label", epochs, key="set", keys=names)
    out = [measured(name) for name in names]  # one after another: plans of all sets at once fill the driver
    kind = "set string, n_inputs int, features string, n_free_params int, rmse double, mae double, pooled_rank_ic double, net_sharpe_15bps double, monthly_mark_ic double, quarterly_mark_ic double"
    return spark.createDataFrame(out, kind)


def masked_summary(report: DataFrame) -> DataFrame:
    """One row of masked_report's draws: their number, masked rows, mean absolute and signed change, mean absolute bias, and mean and standard deviation of IC, rmse and Sharpe."""
    spread = [f(c).alias(f"{c}_{n}") for c in ("ic", "rmse", "sharpe") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return report.agg(
        F.count(F.lit(1)).alias("draws"), F.max("n_masked").alias("n_masked"), F.avg("mean_abs_delta").alias("mean_abs_delta"), F.avg("mean_delta").alias("mean_delta"), F.avg(F.abs("mean_delta")).alias("mean_abs_bias"), *spread)


def train_per_ticker(df: DataFrame, inputs: list[str], label: str, rules: int = 3, epochs: int = 20, ridge: float = 10.0, rate: float = 1e-3) -> DataFrame:
    """ticker, n_train, rmse, final_loss: a model of its own for each ticker, all side by side.

    A ticker's rows may lie in any task: an epoch is one keyed aggregate (`train_grid`), so no task gathers a ticker. The driver holds a model per ticker.
    """
    rows = written(finite_rows(df, inputs, label).select("ticker", "date", *inputs, label)).persist()
    found = {r["g"]: r["centers"] for r in cluster_centers(rows, inputs, rules=rules, by=F.col("ticker")).collect()}  # one row per ticker
    spread = {r[0]: np.array(r[1:], float) for r in rows.groupBy("ticker").agg(*[F.stddev_pop(c) for c in inputs]).collect()}
    tickers = sorted(found)
    models = []
    for t in tickers:
        widths = np.where(spread[t] > 0, np.maximum(0.75 * spread[t], 4e-4), 1.0).tolist()
        models.append(FuzzyModel([list(c) for c in found[t]], [widths] * len(found[t]), [[50.0] + [0.0] * len(inputs)] * len(found[t])))
    train_grid(models, [ridge] * len(models), rows, inputs, label, epochs, rate, key="ticker", keys=tickers)
    rows.unpersist()
    out = [(t, m.metadata["n_train"], float(np.sqrt(2 * m.metadata["fitted_loss"] / max(m.metadata["n_train"], 1))), m.metadata["final_loss"]) for t, m in zip(tickers, models, strict=True)]
    return df.sparkSession.createDataFrame(out, "ticker string, n_train int, rmse double, final_loss double")


def _kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(2))


def svr_fit(x: np.ndarray, y: np.ndarray, c: float = 1.0, epsilon: float = 0.1, sweeps: int = 200) -> tuple[np.ndarray, float, float]:
    """Support-vector regression with an RBF kernel by coordinate descent on the dual; returns coefficients, intercept and gamma.

    The kernel is centred, which stands for the intercept's equality constraint.
    """
    gamma = 1.0 / (x.shape[1] * x.var()) if x.var() > 0 else 1.0
    k = np.concatenate([_kernel(x[i : i + 256], x, gamma) for i in range(0, len(x), 256)])
    base = float(np.median(y))
    beta, g = np.zeros(len(x)), base - y
    for _ in range(sweeps):
        moved = 0.0
        for i in range(len(x)):
            free = beta[i] - g[i] / k[i, i]
            new = float(np.clip(np.sign(free) * max(abs(free) - epsilon / k[i, i], 0.0), -c, c))
            if new != beta[i]:
                g += (new - beta[i]) * k[i]
                moved = max(moved, abs(new - beta[i]))
                beta[i] = new
        inside = (np.abs(beta) > 1e-9) & (np.abs(beta) < c - 1e-9)
        shift = float(np.mean((-g - epsilon * np.sign(beta))[inside])) if inside.any() else float(np.median(-g))
        base, g = base + shift, g + shift
        if moved < 1e-4 and abs(shift) < 1e-4:
            break
    return beta, base, gamma


def _r2(y: np.ndarray, p: np.ndarray) -> float:
    spread = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - p) ** 2).sum() / spread) if spread > 0 else float("nan")


def reconstruction_r2(train_df: DataFrame, test_df: DataFrame, inputs: list[str], score: str, mask_rate: float = 0.0, seed: int = 0, shuffled: bool = False) -> DataFrame:
    """n_train, n_test, r2 of an adversary who learns the score from the inputs; at a mask rate rows drop out by a keyed hash, else all
    are taken; NULL with under 10 or 5 rows. One task, whose kernel is quadratic in the training rows."""
    def part(df: DataFrame, side: int) -> DataFrame:
        rows = finite_rows(df, inputs, score)
        if mask_rate > 0:
            rows = rows.where(keyed_uniform(str(seed), str(side), F.col("ticker"), F.col("date").cast("string")) >= mask_rate)
        drawn = keyed_uniform(str(seed + 1), F.col("ticker"), F.col("date").cast("string"))
        return rows.select(F.lit(side).alias("side"), drawn.alias("u"), *inputs, F.col(score).alias("y"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["side", "u", *inputs])
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        r2 = None
        if len(a) >= 10 and len(b) >= 5:
            x, y = a[inputs].to_numpy(float), a["y"].to_numpy(float)
            beta, base, gamma = svr_fit(x, y)
            t, truth = b[inputs].to_numpy(float), b["y"].to_numpy(float)
            if shuffled:
                truth = np.random.default_rng(seed + 1).permutation(truth)
            r2 = _r2(truth, np.concatenate([_kernel(t[i : i + 256], x, gamma) @ beta for i in range(0, len(t), 256)]) + base)
        yield pd.DataFrame({"n_train": [len(a)], "n_test": [len(b)], "r2": [r2]})

    both = part(train_df, 0).unionByName(part(test_df, 1)).coalesce(1)
    return both.mapInPandas(fit, "n_train int, n_test int, r2 double")
