"""How filters interact: every order of a set of filters, audited by executing a trie of permutations.

The trie's root is the whole table; an edge applies one filter to the survivors of the path so far. Survivors don't depend on the order in which
filters were applied, so all prefixes over the same filters share one state: it is executed once, depth first, from the persisted
survivors of the state it was reached from, and its counts are memoised in a written table. With five filters that is 31 states
in place of 325 prefixes, and never more than six frames are persisted at a time. Every removal is counted on the survivors at its edge. Only
DataFrame functions are used.
"""

from __future__ import annotations

import itertools
import json
import uuid
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import WORD, drop, left_join, save, scratch_dir

#: Filters of a set at most: its orders grow with the factorial.
MOST_FILTERS = 6


def text_fails(text: Column) -> dict[str, Column]:
    """Failure conditions of a text (null: empty): A under 200 words, B under half of its words distinct, C over 3 % capitals A-Z, D a symbol of #$%&*|."""
    body = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(body, F.lit(f"({WORD})"))
    n = F.size(words).cast("long")
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n,
        "C": 100 * F.octet_length(F.regexp_replace(body, "[^A-Z]+", "")).cast("long") > 3 * F.length(body).cast("long"),
        "D": body.rlike(r"[#$%&*|]"),
    }


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, A .. E, good_lost, toxic_lost of every row: which filters it fails, and whether a label calls it good (quality 1) or toxic (1).

    E fails if a smaller id has the same text anywhere in the table (by SHA-256). A null id is neither smaller nor larger than another and has no label; repeated rows
    of one id don't fail each other; labels given more than once count if any of them says so. Copies meet by digest, summed up
    before any shuffle, and rows find their group in a join that adaptive execution splits where one text is hot.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    rows = save(rows.select("id", "part", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), *[c.alias(f) for f, c in text_fails(F.col("text")).items()]))
    first = save(rows.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    rated = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good_lost"), F.max(F.col("toxic") == 1).alias("toxic_lost"))
    rated = save(rated)
    found = left_join(left_join(rows, first, "digest"), rated, "id")
    no = F.lit(False)
    out = save(found.select("part", *"ABCD", F.coalesce(F.col("id") > F.col("least"), no).alias("E"), *[F.coalesce(c, no).alias(c) for c in ("good_lost", "toxic_lost")]))
    drop(rows, first, rated)
    return out


def execute_trie(rows: DataFrame, filters: list[str], lost: list[str]) -> DataFrame:
    """state (bits of the filters applied), part, alive, filter, removed and a count of each of `lost`: the edges of the trie, for parts with survivors."""
    path = f"{scratch_dir(rows.sparkSession)}/mw-{uuid.uuid4().hex}"
    done: set[int] = set()
    # What each filter would remove from a state's survivors (nothing if it was applied): one aggregate, the same for all states.
    removed = [F.struct(F.lit(f).alias("filter"), F.count_if(f).alias("removed"), *[F.count_if(F.col(f) & F.col(x)).alias(x) for x in lost]) for f in filters]
    edges = [F.count(F.lit(1)).alias("alive"), F.array(*removed).alias("edges")]
    passes = {f: ~F.col(f) for f in filters}

    def visit(state: int, survivors: DataFrame) -> None:
        done.add(state)
        left = [f for k, f in enumerate(filters) if not state >> k & 1]
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        survivors.groupBy("part").agg(*edges).write.parquet(f"{path}/state={state}")
        for f in left if len(left) > 1 else []:  # nothing is counted after the last filter
            after = state | 1 << filters.index(f)
            if after not in done:
                visit(after, survivors.where(passes[f]))
        survivors.unpersist()

    visit(0, rows)
    found = rows.sparkSession.read.option("basePath", path).parquet(path)
    return found.select(F.col("state").cast("int").alias("state"), "part", "alive", F.inline("edges"))


def filter_audit(rows: DataFrame, filters: list[str], lost: list[str] | None = None, part: str = "part") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, one count for each of `lost`, and shapley: a row for every part, order and step.

    rows: `part`, a boolean column for each filter (true: fails) and for each of `lost` (rows whose loss is counted); nulls count as false, a null part as the empty
    string. An empty table gives an empty result; other columns are ignored. Parts are never collected: a state's counts are aggregates by part.
    """
    lost = lost or []
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    own = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *[F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in [*filters, *lost]])
    edges = execute_trie(own, filters, lost)
    bit = {f: 1 << k for k, f in enumerate(filters)}
    full = sum(bit.values())
    routes = [
        {"filter_order": "".join(order), "step": k + 1, "state": sum(bit[f] for f in order[:k]), "filter": order[k]}
        for order in itertools.permutations(filters) for k in range(len(order))
    ]
    kind = "array<struct<filter_order:string,step:int,state:int,filter:string>>"
    parts = edges.where("state = 0").select("part").distinct()
    steps = parts.select("part", F.inline(F.from_json(F.lit(json.dumps(routes)), kind)))
    at = steps.join(edges, ["part", "state", "filter"], "left").na.fill(0, ["alive", "removed", *lost])
    own_bit = reduce(lambda c, f: c.when(F.col("filter") == f, bit[f]), filters, F)
    # All that a filter fails is what it removes first; what it alone fails, what it removes last; each order counts in shapley.
    ends = at.groupBy("part", "filter").agg(
        F.max(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"), F.max(F.when(F.col("state") == F.lit(full) - own_bit, F.col("removed"))).alias("unique_fails"), F.sum("removed").alias("shapley"))
    out = at.join(ends, ["part", "filter"])
    return out.select(
        "part", "filter_order", "step", (F.col("alive") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley")
