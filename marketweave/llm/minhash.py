"""Near-duplicate documents: universal hash minima, banding, signature verification, exact check on full shingle sets.

Documents with equal shingle sets collapse into classes first. Within a bucket no all-pairs list is made: each class is
tested against one pivot; then only pairs across components remain, between classes outside the bucket's
largest component and the rest, less those that the number of their shingles found in no other class rules out. Links are confirmed on the full sets and joined by large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm import bytehash
from marketweave.llm.common import WORD, left_join, release, save, small_batches
from marketweave.llm.components import components

#: Rows in a band. With 32 bands a pair at similarity 0.8 shares no bucket with probability (1 - 0.8**4)**32 = 5e-8.
BAND_ROWS = 4


def _signer(width: int, bands: int, seed: int = 7):
    n = bands * BAND_ROWS
    rng = np.random.default_rng(seed)
    mul, add = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    lane = bytehash.mix(np.arange(1, BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.list_(pa.int32())), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bytehash.texts(batches, 1 << 20):
            shingles, first = bytehash.shingle_sets(*bytehash.word_hashes(*bytehash.utf8(part.column(1))), width)
            n_set = np.diff(first)
            some = np.flatnonzero(n_set)
            sig = np.zeros((len(n_set), n), np.uint32)
            digest = np.zeros((len(n_set), 2), np.uint64)
            if len(some):
                at = first[some]
                for k in range(n):
                    sig[some, k] = np.minimum.reduceat((shingles * mul[k] + add[k]) >> np.uint64(32), at)
                digest[some] = _digest(shingles, at)
            keys = np.zeros((len(n_set), bands), np.uint64)
            for b in range(bands):
                for j in range(BAND_ROWS):
                    keys[:, b] += sig[:, b * BAND_ROWS + j] * lane[j]
                keys[:, b] = bytehash.mix(bytehash.mix(keys[:, b]) + np.uint64(b))
            lists = lambda m, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel().view(kind)))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(n_set, pa.int64()), _raw(n_set, digest),
                lists(sig, np.int32), lists(keys, np.int64)], schema=schema)

    return sign


def _digest(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each set; the sum of mixed members doesn't depend on their order."""
    return np.stack([np.add.reduceat(bytehash.mix(shingles ^ key), at) for key in _KEYS], 1)


_KEYS = bytehash.mix(np.arange(7, 9, dtype=np.uint64))


def _raw(n_set: np.ndarray, digest: np.ndarray) -> pa.Array:
    raw = np.concatenate([n_set.astype(np.uint64)[:, None], digest], 1).tobytes()
    return pa.array([raw[i : i + 24] for i in range(0, len(raw), 24)], pa.binary())


def _sets(width: int):
    schema = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bytehash.texts(batches, 1 << 20):
            shingles, first = bytehash.shingle_sets(*bytehash.word_hashes(*bytehash.utf8(part.column(1))), width)
            n_set = np.diff(first)
            digest = np.zeros((len(n_set), 2), np.uint64)
            if n_set.any():
                digest[n_set > 0] = _digest(shingles, first[:-1][n_set > 0])
            yield pa.RecordBatch.from_arrays([part.column(0), _raw(n_set, digest), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(shingles.view(np.int64)))], schema=schema)

    return build


def _of(rows: DataFrame, facts: DataFrame, col: str, prefix: str, how: str = "left") -> DataFrame:
    """Join of one row of facts (a written table) per id to rows by a column in which a few ids may be very frequent.

    An inner join, where every row has its facts, lets Spark send few rows to the facts in place of dealing out both.
    """
    own = facts.select(F.col("id").alias(col), *[F.col(c).alias(f"{prefix}{c}") for c in facts.columns if c != "id"])
    return rows.join(own, col, how)


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 32,
) -> DataFrame:
    """id, n_shingles, component_id and kept of every row; links have 100 * intersection >= percent * union.

    Words are A-Z-lower-cased runs of non-white-space; a text of fewer than `width` words is one shingle; null, empty and blank texts
    have no shingle and link with nothing (also where a row with words repeats the id). Rows with a null id link with nothing, have a null component and are kept. Rows that repeat
    an id are one document to the links, which has the links of each of its texts; n_shingles is of the row's own text. Texts of any
    length are read whole, in slices. Empty table: empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    signed = save(source.mapInArrow(_signer(width, bands), "id long, n_shingles long, digest binary, sig array<int>, bands array<long>"))
    # An id with several sets is several nodes, numbered above all ids, that are linked with the one that keeps the id.
    several = signed.where("id is not null and n_shingles > 0").groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least != most").select("id", "least")
    several = save(several)
    more = None
    if not several.isEmpty():
        above = signed.agg(F.max("id")).first()[0] + 1
        more = signed.join(several, "id").where("n_shingles > 0 and digest != least").select("id", "digest").distinct()
        more = save(more.select("id", "digest", (F.monotonically_increasing_id() + F.lit(above)).alias("node")))
        signed = save(signed.withColumnRenamed("id", "doc").join(more.withColumnRenamed("id", "doc"), ["doc", "digest"], "left").withColumn("id", F.coalesce("node", "doc")).drop("node"))
    else:
        signed = signed.withColumn("doc", F.col("id"))
    copies = signed.where("id is not null and n_shingles > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # Bands stay with the class's representative alone.
    members = left_join(signed.select("id", "doc", "n_shingles", "digest", "bands"), copies, "digest").withColumn("rep", F.coalesce("rep", "id"))
    members = save(members.select("id", "doc", "n_shingles", "rep", F.when((F.col("id") == F.col("rep")) & (F.col("n_shingles") > 0), F.col("bands")).alias("bands")))
    keyed = members.where("bands is not null").select("id", F.explode("bands").alias("key"))
    members = members.drop("bands")
    buckets = save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    placed = save(keyed.join(buckets, "key"))
    # A bucket's pivot is the class whose buckets are fullest: the common ancestor of near copies rather than one of them.
    crowd = save(placed.groupBy("id").agg(F.struct(F.sum("size").alias("rows"), (-F.col("id")).alias("minus_id")).alias("crowd")))
    pivots = placed.join(crowd, "id").groupBy("key").agg(F.max("crowd").alias("pivot"))
    placed = save(placed.join(save(pivots), "key"))
    among = placed.select("id").distinct()
    facts = save(signed.where("n_shingles > 0").select("id", "n_shingles", "sig").join(among, "id", "left_semi").dropDuplicates(["id"]))
    kind = "id long, digest binary, shingles array<long>"
    if more is None:
        worded = source.where(F.col("body").cast("string").rlike(WORD))
        sets = save(worded.join(among, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(width), kind).drop("digest"))
    else:
        wanted = members.join(among, "id", "left_semi").select(F.col("doc").alias("id")).distinct()
        found = source.join(wanted, "id", "left_semi").dropDuplicates(["id", "body"]).mapInArrow(_sets(width), kind).where("size(shingles) > 0").withColumnRenamed("id", "doc")
        found = found.join(more.withColumnRenamed("id", "doc"), ["doc", "digest"], "left").select(F.coalesce("node", "doc").alias("id"), "shingles")
        sets = save(found.join(among, "id", "left_semi").dropDuplicates(["id"]))
    floor = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / (bands * BAND_ROWS)) ** 0.5

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs a, b that pass sizes and signatures, with the common shingles of their full sets and whether they link."""
        release(spark, 1)  # many plans lie behind: the driver's heap would grow to its limit
        p = _of(_of(pairs, facts, "a", "a_", "inner"), facts, "b", "b_", "inner")
        same = F.aggregate(F.zip_with("a_sig", "b_sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        fits = F.least("a_n_shingles", "b_n_shingles") * 100 >= F.greatest("a_n_shingles", "b_n_shingles") * percent
        p = save(p.where(fits & (same >= floor * bands * BAND_ROWS)).select("a", "b"))
        # A pivot meets its whole family here: adaptive execution splits its pairs.
        both = _of(_of(p, sets, "a", "a_", "inner"), sets, "b", "b_", "inner").select("a", "b", F.col("a_shingles").alias("sa"), F.col("b_shingles").alias("sb"))
        common = F.size(F.array_intersect("sa", "sb"))
        link = 100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))
        return save(both.withColumn("common", common).select("a", "b", "common", link.alias("link")))

    if more is not None:
        rep_of = lambda col: members.select(F.col("id").alias(col), "rep").distinct()
        same = more.select("node", "id").join(rep_of("node"), "node").select(F.col("rep").alias("a"), "id").join(rep_of("id"), "id").select("a", F.col("rep").alias("b"))
        same = save(same)

    def linked(tested: DataFrame) -> DataFrame:
        links = tested.where("link").select("a", "b")
        return links if more is None else links.unionByName(same)

    # 1. Each class against the fullest of its pivots.
    starred = placed.select(F.col("id").alias("a"), "pivot", (-F.col("pivot.minus_id")).alias("b")).where("a != b")
    stars = save(starred.groupBy("a", "b").agg(F.max("pivot").alias("pivot")))
    first = save(stars.groupBy("a").agg(F.max("pivot").alias("pivot")).select("a", (-F.col("pivot.minus_id")).alias("b")))
    tested = verified(first)
    comps = save(components(linked(tested)))
    # 2. The other pivots that are still in another component.
    known = lambda rows, col, name: _of(rows, comps, col, "_").withColumnRenamed("_component_id", name).withColumn(name, F.coalesce(name, col))
    others_ = save(stars.select("a", "b").join(first, ["a", "b"], "left_anti"))
    second = save(known(known(others_, "a", "ca"), "b", "cb").where("ca != cb").select("a", "b"))
    if not second.isEmpty():
        tested = tested.unionByName(verified(second))
        comps = save(components(linked(tested)))
    # 3. Within a bucket, what is outside its largest component against the rest of the bucket.
    inside = save(known(placed.select("id", "key", "size", "pivot"), "id", "comp"))
    parts = inside.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_keys = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("most"), F.count(F.lit(1)).alias("n_comps"))
    open_keys = save(open_keys.where("n_comps > 1").select("key", F.col("most.comp").alias("major")))
    open_rows = save(inside.join(open_keys, "key"))
    # A shingle that no other open class has can't be in an intersection, so I <= own = n - lone, and a link needs
    # (100 + percent) * I >= percent * (n + n'). Where both were tested against the pivot and have i and i' shingles in common
    # with it, I <= min(i, i') + min(own - i, own' - i').
    shingles = sets.join(open_rows.select("id").distinct(), "id", "left_semi").select("id", F.explode("shingles").alias("s"))
    lone = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
    bound = facts.select("id", "n_shingles").join(lone, "id", "left").select("id", "n_shingles", (F.col("n_shingles") - F.coalesce("lone", F.lit(0))).alias("own"))
    own_keys = open_rows.groupBy("id").agg(F.collect_list("key").alias("keys"))
    open_rows = open_rows.join(bound.join(own_keys, "id"), "id")
    least = open_rows.groupBy("key").agg(F.min("n_shingles").alias("least"))
    fits = lambda common, n: (100 + percent) * common >= percent * n
    alive = left_join(open_rows, least, "key").where(fits(F.col("own"), F.col("n_shingles") + F.col("least")))
    measured = tested.select(F.col("a").alias("id"), F.col("b").alias("hub"), "common")
    alive = alive.withColumn("hub", -F.col("pivot.minus_id")).join(measured, ["id", "hub"], "left")
    alive = save(alive.withColumn("common", F.when(F.col("id") == F.col("hub"), F.col("n_shingles")).otherwise(F.col("common"))))
    salts = F.ceil(F.col("size") / 256).cast("int")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("id", "comp", "n_shingles", "own", "common", "keys")]
    outside = alive.where("comp != major").select("key", *side("a"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    rest = alive.select("key", "major", *side("b"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    able = (F.col("comp_a") != F.col("comp_b")) & ((F.col("comp_b") == F.col("major")) | (F.col("id_a") < F.col("id_b")))
    most = F.least("own_a", "own_b")
    through = F.least("common_a", "common_b") + F.least(F.col("own_a") - F.col("common_a"), F.col("own_b") - F.col("common_b"))
    most = F.when(F.col("common_a").isNotNull() & F.col("common_b").isNotNull(), F.least(most, through)).otherwise(most)
    once = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")  # a pair comes from one of its buckets
    third = outside.join(rest, ["key", "salt"]).where(able & fits(most, F.col("n_shingles_a") + F.col("n_shingles_b")) & once).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    done = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    third = save(third.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(done, ["a", "b"], "left_anti"))
    if not third.isEmpty():
        tested = tested.unionByName(verified(third))
        comps = save(components(linked(tested)))
    final = members.join(comps.select(F.col("id").alias("rep"), F.col("component_id").alias("_c")), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("_c", "rep")).otherwise(F.col("doc"))
    return final.select(F.col("doc").alias(id_col), "n_shingles", component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))
