"""Exact deduplication through a log-structured merge index of text digests.

Digests arrive in batches. A batch's memtables (one per task) collapse equal digests, and a flush writes them as a run: rows sorted by digest, and
a blocked Bloom filter. New digests are probed against the filters of earlier runs; those that pass are looked up in the runs themselves, and what is
found there or twice in the memtable is a hit. When a level has FANOUT runs, compaction merges them into one run of the next level, which
keeps one identifier and the number of entries of each digest. The bytes of all rows of a hit are compared,
and texts that differ under one digest are split into groups of their own. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import drop, few, left_join, lower_ascii, save

#: Runs of a level that compaction merges; bits of a filter for each digest.
FANOUT, FILTER_BITS = 2, 16
#: Digests of hits that are broadcast for verification; more are joined by id and digest.
HITS_SENT = 200_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _mask(digest: Column) -> Column:
    """Three bits of a filter's 64-bit word."""
    h = F.xxhash64(digest, F.lit(1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))


class DigestIndex:
    """Sorted runs by level with their filters. `keep`: "max" or "min" identifier of a digest stays."""

    def __init__(self, keep: str = "max", fanout: int = FANOUT) -> None:
        self.keep, self.fanout = {"max": F.max, "min": F.min}[keep], fanout
        self.levels: list[list[dict]] = [[]]

    @property
    def runs(self) -> list[dict]:
        return [run for level in self.levels for run in level]

    def _flush(self, memtable: DataFrame, level: int) -> dict:
        """memtable: digest, id, n, one row per digest. Each task sorts and writes its own; the filter is a table of 64-bit words."""
        rows = save(memtable.sortWithinPartitions("digest"))
        n = rows.count()
        words = max(1, n * FILTER_BITS // 64)
        bits = few(rows, n).groupBy(F.pmod(F.xxhash64("digest"), F.lit(words)).alias("word")).agg(F.bit_or(_mask(F.col("digest"))).alias("bits"))
        run = {"rows": rows, "filter": save(bits), "words": words, "n": n}
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        return run

    def lookup(self, digests: DataFrame, runs: list[dict] | None = None) -> DataFrame:
        """digest of those that some run holds: filters first, then the runs for what passes."""
        runs = self.runs if runs is None else runs
        asked = [F.struct(F.lit(k).alias("run"), F.pmod(F.xxhash64("digest"), F.lit(r["words"])).alias("word")) for k, r in enumerate(runs)]
        if not asked:
            return digests.limit(0)
        size = max([digests.count(), *[r["n"] for r in runs]]) * len(runs)  # of the probes and of the runs, at most
        filters = held = None
        for k, r in enumerate(runs):
            f, h = r["filter"].withColumn("run", F.lit(k)), r["rows"].select("digest", F.lit(k).alias("run"))
            filters, held = (f, h) if filters is None else (filters.unionByName(f), held.unionByName(h))
        filters, held = few(filters, size), few(held, size)
        probes = few(digests, size).select("digest", F.explode(F.array(*asked)).alias("at")).select("digest", "at.*")
        maybe = probes.join(filters, ["run", "word"]).where(F.col("bits").bitwiseAND(_mask(F.col("digest"))) == _mask(F.col("digest")))
        return maybe.select("digest", "run").join(held, ["run", "digest"], "left_semi").select("digest")

    def add(self, entries: DataFrame) -> DataFrame:
        """entries: digest, id. Flushes one batch as a run and returns its hits: digests that it holds twice or that were there before."""
        earlier = self.runs
        run = self._flush(few(entries, entries.count()).groupBy("digest").agg(self.keep("id").alias("id"), F.count(F.lit(1)).alias("n")), 0)
        hits = run["rows"].where("n > 1").select("digest").unionByName(self.lookup(run["rows"].select("digest"), earlier))
        hits = save(few(hits, run["n"] * (1 + len(earlier))).distinct())
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._merge(level, self.levels[level])
        return hits

    def _merge(self, level: int, runs: list[dict]) -> dict:
        every = runs[0]["rows"]
        for r in runs[1:]:
            every = every.unionByName(r["rows"])
        gone = list(runs)
        run = self._flush(few(every, sum(r["n"] for r in runs)).groupBy("digest").agg(self.keep("id").alias("id"), F.sum("n").alias("n")), level + 1)
        for other in self.levels[: level + 1]:
            other[:] = [r for r in other if not any(r is g for g in gone)]
        for r in gone:
            drop(r["rows"], r["filter"])
        return run

    def compact(self) -> DataFrame:
        """All runs as one: digest, the id that stays and the number n of entries."""
        if len(self.runs) > 1:
            self._merge(len(self.levels) - 1, self.runs)
        return self.runs[0]["rows"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest: Callable[[Column], Column] = sha256, batches: int = 4) -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 of every row; `digest` is a parameter so that tests can force collisions.

    Null text counts as empty. Texts are equal if identical after lower-casing A-Z. A null id never stays while
    its group has another; in a group of null ids only, keep_id is null and the rows are kept. Repeated rows (same id and text)
    count in group_size and share one fate. An empty table gives an empty result; other columns are ignored.
    """
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    sha = [] if digest is sha256 else [sha256(F.col("norm")).alias("sha")]
    log = save(rows.select("id", "digest", *sha, F.pmod(F.xxhash64("id", "digest"), F.lit(batches)).cast("int").alias("batch")), partitionBy="batch")
    index, hits = DigestIndex(keep), None
    for k in range(batches):
        got = index.add(log.where(F.col("batch") == k).select("digest", "id"))
        hits = got if hits is None else hits.unionByName(got)
    whole = index.compact()
    size = index.runs[0]["n"] * batches  # rows of the index and of the hits, at most
    groups = save(few(whole, size).join(few(hits, size).distinct(), "digest", "left_semi").select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size")))
    found = left_join(log.drop("batch"), groups, "digest")
    found = save(found.select("id", "digest", *(["sha"] if sha else []), F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size")))
    drop(log)

    # Byte verification of the hits: all texts under a digest are equal if the least is the greatest. A task passes on two for each digest.
    if groups.count() <= HITS_SENT:
        texts = rows.join(F.broadcast(groups.select("digest")), "digest", "left_semi")
    else:
        members = found.where("group_size > 1").select(F.col("id").alias("own"), F.col("digest").alias("d")).distinct()
        texts = rows.join(members, F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("d")))
    ends = texts.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    differ = save(ends.where("least != greatest").select("digest"))
    if differ.isEmpty():
        drop(differ)
        return _named(found, id_col)
    # Digests that hold different texts: group those rows by the bytes themselves.
    clash = rows.join(differ, "digest", "left_semi")
    groups = clash.groupBy("norm").agg(index.keep("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    fixed = left_join(clash, groups, "norm").withColumn("sha", sha256(F.col("norm"))).drop("norm")
    clean = found.join(differ, "digest", "left_anti")
    clean = clean if sha else clean.withColumn("sha", F.col("digest"))
    return _named(clean.unionByName(fixed), id_col)


def _named(out: DataFrame, id_col: str) -> DataFrame:
    sha = F.col("sha" if "sha" in out.columns else "digest")
    return out.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(sha)).alias("text_sha256"),
    )
