"""Importance resampling towards a target text collection, over hashed word n-grams.

A document's words become an array of buckets (CRC-32 of each run of words, modulo the number of buckets) by higher-order functions. Counts of buckets
over all documents and over the target collection are the only thing that is shuffled for scoring; from them each bucket's gain, the
smoothed log ratio of its shares, is a literal array of fixed length, and a document's weight is a fold over its own buckets: no document is
exploded or joined for its score. Documents are then drawn without replacement by the Gumbel trick: the highest sums of weight and a keyed draw. Only
DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.llm.common import drop, lower_ascii, save

#: What stands between words: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Scores of a band; ranks are offset by bands, then inside a band.
BAND = 64


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def _run(words: Column, k: int, bucket: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda i: bucket(F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]))


def buckets_of(words: Column, width: int, buckets: int) -> Column:
    """The bucket of every run of 1 to `width` consecutive words, joined by one space; repeats stay."""
    bucket = lambda s: F.crc32(s.cast("binary")) % buckets
    runs = [F.transform(words, bucket)]
    for k in range(2, width + 1):
        at = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(at, _run(words, k, bucket)))
    return F.concat(*runs).cast("array<int>")


def _counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(own: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """floor(1000 ln of the ratio of the smoothed shares) of each bucket; own and target have a column `buckets`. One list of fixed length."""
    spark = own.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(_counts(own, "s").withColumn("t", F.lit(0).cast("long"))).unionByName(_counts(target, "t").withColumn("s", F.lit(0).cast("long")))
    both = save(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    total = both.agg(F.sum("s"), F.sum("t")).first()
    smooth = lambda c: (F.col(c) + 1).cast("double")
    ratio = smooth("t") * F.lit(float(total[0] + buckets)) / (smooth("s") * F.lit(float(total[1] + buckets)))
    found = both.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain")).orderBy("bucket").collect()  # `buckets` rows, whatever the input
    drop(both)
    return [r["gain"] for r in found]


def gumbel(id_: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of SHA-256 of `seed:id`; a null id is the empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u)))


def draw(scored: DataFrame, percent: int) -> DataFrame:
    """scored (id, n_features, weight, score, able) with rank in place of able: 1, 2, 3 ... of the floor(percent/100 N) highest scores of the N able rows, else null.

    Ties go to the smaller id (null last). No window sees all rows: the numbers of rows by score are bounded by the range of scores (weights lie
    between logarithms of counts, draws between -3104 and 22874), and are summed by band, then inside a band. Only rows from the last score
    drawn upwards are shuffled, by score, rows equal in all columns as one row with a number.
    """
    same = save(scored.where("able").groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("band", F.floor(F.col("score") / BAND)))
    most = percent * (same.agg(F.sum("n")).first()[0] or 0) // 100
    above = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = same.groupBy("band").agg(F.sum("n").alias("n")).select("band", above(Window.orderBy(F.desc("band"))).alias("ahead"))
    starts = same.join(F.broadcast(bands), "band").select("score", (F.col("ahead") + above(Window.partitionBy("band").orderBy(F.desc("score")))).alias("before"))
    starts = save(starts.where(F.col("before") < most).select(F.col("score").alias("top"), "before"))
    drop(same)
    met = scored.join(F.broadcast(starts), F.col("able") & (F.col("score") == F.col("top")), "left")
    key = ["id", "n_features", "weight", "score"]
    rows = met.where("before is not null").groupBy("before", *key).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("start", F.col("before") + above(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight")))
    rows = rows.select(*key, F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("n"))).alias("place")).select(*key, F.when(F.col("place") <= most, F.col("place")).alias("rank"))
    return rows.unionByName(met.where("before is null").select(*key, F.lit(None).cast("long").alias("rank")))


def bagged(docs: DataFrame, text_col: str, width: int, buckets: int, id_col: str | None = None) -> DataFrame:
    """id (with id_col), n_words and the array `buckets` of every text."""
    own = [F.col(id_col).alias("id")] if id_col else []
    words = docs.select(*own, words_of(F.col(text_col).cast("string")).alias("words"))
    return words.select(*(["id"] if id_col else []), F.size("words").alias("n_words"), buckets_of(F.col("words"), width, buckets).alias("buckets"))


def target_resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 25, least_words: int = 20, width: int = 2, buckets: int = 10_000, seed: int = 7,
) -> DataFrame:
    """id, n_features, weight, score and rank of every row of docs; rank 1, 2, 3 ... of those drawn, null for the others.

    Drawn is `percent` of the rows with at least `least_words` words. A null text has no words and weight 0; a row with a null id draws as the empty id; repeated
    rows are drawn each on their own. Empty tables (documents, target or both) give what the smoothed counts give; other columns
    are ignored, whatever their names. Texts are read once: bucket arrays are written, and read for counts and for scores.
    """
    own = save(bagged(docs, text_col, width, buckets, id_col))
    gain = F.expr(f"array({', '.join(f'{g}L' for g in gains(own, bagged(target, text_col, width, buckets), buckets))})")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, b: s + F.element_at(gain, b + 1))
    n = F.size("buckets").cast("long")
    weight = F.when(n > 0, F.floor(total / n)).otherwise(F.lit(0)).cast("long")
    scored = own.select("id", n.alias("n_features"), weight.alias("weight"), (F.col("n_words") >= least_words).alias("able"))
    scored = save(scored.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    drop(own)
    return draw(scored, percent).withColumnRenamed("id", id_col)
