"""Mixing sources to target weights by Pareto order sampling.

A source of S words with target T gives its words T/S copies on average: the whole part is certain for every document, the rest is sampled with
unequal inclusion probabilities: p/(1-p) is the document's importance (by default about the square root of its size) times a factor of its source that
makes the expected words meet the rest. Documents are ranked by [u/(1-u)] / [p/(1-p)] with u drawn from a digest of the seed and the
id, and the first ones are taken until the source's remaining words are met (the sample has a fixed size in words).
Ranks are never collected in one task: the order is cut with two levels of BINS sums, then inside one small bin.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.llm.common import WORD, left_join, save

BINS, SEED = 4096, 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), the same for the same key and seed on every engine: 52 bits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def draw(id_col: str, text_col: str, seed: int = SEED) -> Column:
    """The uniform number of a row: by its id, without one by its text."""
    return uniform(F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))), seed)


def importance_class(size: Column, importance: Column | None) -> Column:
    """log2 of the importance in quarters; importance defaults to 2 to the power of half the bits of the size, rounded down."""
    if importance is None:
        half = F.floor((F.length(F.bin(F.greatest(size, F.lit(1)))) - 1) / 2)
        return (4 * half).cast("int")
    usual = importance.cast("double")
    return F.when((usual > 0) & (usual < float("inf")), F.round(4 * F.log2(usual))).otherwise(F.lit(0)).cast("int")


def inclusion_factor(classes: Column, rest: Column) -> Column:
    """The factor by which importances become inclusion odds such that the expected words of classes (array of c, words) are `rest`; by bisection of
    factor/(1+factor) in 60 steps."""
    odds = lambda t, c: t / (1 - t) * F.pow(F.lit(2.0), c["c"] / F.lit(4.0))
    expected = lambda t: F.aggregate(classes, F.lit(0.0), lambda s, c: s + c["words"] * (odds(t, c) / (1 + odds(t, c))))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = expected(mid) < rest
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    t = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve)["lo"]
    return t / (1 - t)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size -> target: sources by code point, null last, weigh `weights` repeating and share `share` of all words.

    No target is above `cap` times its source's size; the excess goes to the others by weight. This is the closed form: with
    sources by cap/weight, the level is the first one that leaves its own source uncapped, and levels fall from there. One row per source passes one window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    limit = F.lit(float(cap)) * F.col("source_size")
    w = sizes.withColumn("w", weight).withColumn("cap", limit).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    w = w.withColumn("level", left / F.sum("w").over(after))
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole), F.lit(float("inf")))
    return w.withColumn("target", F.least("cap", F.col("w") * level)).drop("w", "cap", "ratio", "level")


def pareto_mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", importance_col: str | None = None,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = SEED,
) -> DataFrame:
    """id, source, size, source_size, target, taken, copies and u (the draw) of every row.

    Size counts words (null text: 0); rows without words are never taken. A null source is a source of its own. `importance_col`
    (positive numbers; null or other values count as 1; steps of a quarter of a power of two) multiplies a document's inclusion odds p/(1-p).
    Rows with a null id are drawn by a digest of their text. Rows of a source that repeat an id share one draw: they are taken or left together,
    so a source in which one id holds many words can miss its target by these.
    The last document of a source is the one that brings its words nearest to the target. Empty table: empty result.
    Other columns are ignored, whatever their names.
    """
    importance = None if importance_col is None else F.col(importance_col)
    size = word_count(F.col(text_col))
    rows = save(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), draw(id_col, text_col, seed).alias("u"), importance_class(size, importance).alias("c")))
    kinds = rows.groupBy("source", "c").agg(F.sum("size").alias("words"))
    sizes = save(kinds.groupBy("source").agg(F.sum("words").alias("source_size"), F.array_sort(F.collect_list(F.struct("c", "words"))).alias("classes")))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.when(F.abs(copies - F.round(copies)) < 1e-12, F.round(copies)).otherwise(copies)
    plan = source_targets(sizes, weights, share, cap).withColumn("e", copies).withColumn("certain", F.floor("e")).withColumn("p", F.col("e") - F.col("certain"))
    plan = plan.withColumn("rest", F.col("p") * F.col("source_size")).withColumn("factor", inclusion_factor(F.col("classes"), F.col("rest"))).drop("classes")
    rows = left_join(rows, plan, "source")
    # Pareto rank: random odds over inclusion odds. rank/(1+rank) lies in (0, 1); the sample ends near 1/2.
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("factor") * F.pow(F.lit(2.0), F.col("c") / F.lit(4.0)))
    q = F.when((F.col("p") > 0) & (F.col("factor") > 0), rank / (1 + rank)).otherwise(F.col("u"))
    rows = save(rows.withColumn("q", q).drop("c", "factor").withColumn("b1", F.least(F.floor(F.col("q") * BINS), F.lit(BINS - 1)).cast("int")).withColumn("b2", F.floor((F.col("q") * BINS - F.col("b1")) * BINS).cast("int")))

    live = rows.where("p > 0 and size > 0")
    first = _cut(live, ["source"], "b1", "rest")
    inside = _in_bin(live, first, ["source"], "b1")
    second = _cut(inside, ["source"], "b2", "rest")
    deep = _in_bin(inside, second, ["source"], "b2")
    running = F.sum("size").over(Window.partitionBy("source").orderBy("q", "id").rowsBetween(Window.unboundedPreceding, 0))
    last = deep.withColumn("run", running).where("run <= rest").groupBy("source").agg(F.max(F.struct("q", "id")).alias("edge"), F.sum("size").alias("got"))
    edges = (
        first.select("source", F.col("bin").alias("c1"), F.col("left").alias("left1"))
        .join(second.select(F.col("source").alias("s2"), F.col("bin").alias("c2"), F.col("left").alias("left2")), F.col("source").eqNullSafe(F.col("s2")), "left")
        .join(last.withColumnRenamed("source", "s3"), F.col("source").eqNullSafe(F.col("s3")), "left")
        .select("source", "c1", "c2", "edge", (F.coalesce("left2", "left1") - F.coalesce("got", F.lit(0))).alias("gap"))
    )
    rows = left_join(rows, edges, "source")
    in_edge = (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2")) & (F.struct("q", "id") <= F.col("edge"))
    before = (F.col("b1") < F.coalesce("c1", F.lit(BINS))) | ((F.col("b1") == F.col("c1")) & (F.col("b2") < F.coalesce("c2", F.lit(BINS)))) | in_edge
    rows = save(rows.withColumn("chosen", (F.col("p") > 0) & (F.col("size") > 0) & F.coalesce(before, F.lit(False))))

    closing = rows.where("p > 0 and size > 0 and not chosen and size < 2 * gap").groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("miss"), "q", "id")).alias("closing"))
    out = left_join(rows, closing, "source")
    one = F.coalesce(F.struct("q", "id") == F.struct(F.col("closing.q"), F.col("closing.id")), F.lit(False)) & F.col("id").isNotNull() & (F.col("p") > 0) & (F.col("size") > 0)
    n = (F.col("certain") + (F.col("chosen") | one).cast("int")).cast("int")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("size") * n).alias("taken"), F.when(F.col("size") > 0, n).otherwise(F.lit(0)).alias("copies"), "u")


def _cut(rows: DataFrame, keys: list[str], bin_col: str, budget: str) -> DataFrame:
    """For each key the bin in which the running size passes the budget, and the budget left when that bin starts."""
    sums = rows.groupBy(*keys, bin_col).agg(F.sum("size").alias("sz"), F.first(budget).alias("budget"), F.count(F.lit(1)).alias("n_bin"))
    order = Window.partitionBy(*keys).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("run", F.sum("sz").over(order)).where(F.col("run") > F.col("budget"))
    best = run.groupBy(*keys).agg(F.min(F.struct(F.col(bin_col).alias("bin"), (F.col("budget") - F.col("run") + F.col("sz")).alias("left"), "n_bin")).alias("m"))
    return best.select(*keys, "m.bin", "m.left", "m.n_bin")


def _in_bin(rows: DataFrame, cut: DataFrame, keys: list[str], bin_col: str) -> DataFrame:
    """The rows of the bins found by _cut, with the budget left there; a bin holds a 4096th of its source."""
    edge = cut.select(F.col(keys[0]).alias("_k"), F.col("bin").alias("_b"), F.col("left").alias("_left"))
    cond = F.col(keys[0]).eqNullSafe(F.col("_k")) & (F.col(bin_col) == F.col("_b"))
    return rows.join(edge, cond).drop("_k", "_b", "rest").withColumnRenamed("_left", "rest")
