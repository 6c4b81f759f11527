"""Near-duplicate embeddings by NN-descent.

A neighbour graph starts from random-hyperplane orders and is refined by joins of neighbours' neighbours: at every node its
neighbours and reverse neighbours are compared with each other, and each keeps its best. Lists whose last entry still is a
link are enlarged. Links are checked in double precision. Lists may be too short for all links and the descent may miss some,
so its components are only a start: all pairs of vectors of different components are compared in blocks, components with a
link between them are merged, and within a component links are counted exactly in blocks. Results don't depend on the lists;
an audit logs the share of all links that they held.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import drop, left_join, save
from marketweave.llm.components import components

_LOG = logging.getLogger(__name__)
#: Orders to start from, and neighbours taken on each side in each.
ORDERS, SIDE = 4, 4
#: Vectors of a component that meet in one block product.
BLOCK = 512
#: Vectors of a block in the comparison of components, about, and the most blocks a side; beyond them blocks grow.
SWEEP, SWEEP_BLOCKS = 10_000, 64
#: Vectors of a tile of such a block, and pairs verified at once.
TILE, VERIFY = 1024, 1 << 14


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    n = len(column)
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    return flat.reshape(n, -1).astype(np.float64 if kind is np.float64 else np.float32) if n else np.zeros((0, 1), np.float32)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, dim, unit vector as float64 and float16; rows that link with nothing are left out."""
    schema = pa.schema([("id", pa.int64()), ("dim", pa.int32()), ("unit", pa.binary()), ("half", pa.binary())])
    for batch in batches:
        vec = batch.column(1)
        flat, first = vec.values, np.asarray(vec.offsets).astype(np.int64)
        x = np.asarray(flat.fill_null(float("nan")), np.float64)
        size = np.diff(first)
        odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        ok = np.asarray(pc.and_(batch.column(0).is_valid(), vec.is_valid())) & (size > 0) & (odd[first[1:]] == odd[first[:-1]])
        out = []
        for dim in np.unique(size[ok]):
            at = np.flatnonzero(ok & (size == dim))
            m = x[first[at][:, None] + np.arange(dim)]
            scale = np.abs(m).max(1)
            at, m, scale = at[scale > 0], m[scale > 0], scale[scale > 0]
            m = m / scale[:, None]
            m = m / np.sqrt((m * m).sum(1))[:, None]
            out.append([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), _rows(m), _rows(m.astype(np.float16))])
        if out:
            yield from (pa.RecordBatch.from_arrays(o, schema=schema) for o in out)


def _rows(m: np.ndarray) -> pa.Array:
    """A row of the matrix per value, as bytes."""
    raw = np.ascontiguousarray(m).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(0, len(raw) + 1, max(1, m.itemsize * m.shape[1]), dtype=np.int32)), pa.py_buffer(raw)])


def _signatures(seed: int):
    schema = pa.schema([("order", pa.int32()), ("dim", pa.int32()), ("sig", pa.int64()), ("id", pa.int64()), ("half", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column(3), np.float16)
                for t in range(ORDERS):
                    planes = np.random.default_rng([seed, t, int(dim)]).standard_normal((int(dim), 62)).astype(np.float32)
                    sig = ((x @ planes) > 0) @ (np.int64(1) << np.arange(61, -1, -1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(np.full(len(x), dim, np.int32)), pa.array(sig, pa.int64()), part.column(0), part.column(3)], schema=schema)

    return sign


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float32())])


def _edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim.astype(np.float32))], schema=_EDGES)


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between rows at most SIDE apart in an order; the last rows of a batch are carried into the next."""
    tail = None
    for batch in batches:
        if tail is not None:
            batch = pa.concat_batches([tail, batch])
        group = np.asarray(batch.column(0)).astype(np.int64) << 32 | np.asarray(batch.column(1))
        ids = np.asarray(batch.column(3))
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            x, i = _matrix(batch.column(4).take(pa.array(at)), np.float16), ids[at]
            for d in range(1, min(SIDE, len(at) - 1) + 1):
                sim = (x[d:] * x[:-d]).sum(1)
                yield _edges(np.concatenate([i[d:], i[:-d]]), np.concatenate([i[:-d], i[d:]]), np.concatenate([sim, sim]))
        tail = batch.slice(max(0, batch.num_rows - SIDE))


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs among a node's neighbours, one of them new, that beat the worst entry of either list."""
    for batch in batches:
        got = [], [], []
        for near in batch.column(0).to_pylist():
            ids = np.array([r["other"] for r in near])
            x = np.frombuffer(b"".join(r["half"] for r in near), np.float16).reshape(len(near), -1).astype(np.float32)
            worst, new = np.array([r["worst"] for r in near], np.float32), np.array([r["new"] for r in near])
            sim = x @ x.T
            fresh = (new[:, None] | new[None, :]) & (ids[:, None] != ids[None, :])
            a, b = np.nonzero(fresh & (sim > worst[:, None]))
            got[0].append(ids[a])
            got[1].append(ids[b])
            got[2].append(sim[a, b])
        if got[0]:
            yield _edges(*(np.concatenate(g) for g in got))


def _best(edges: DataFrame, lists: DataFrame | None, k: int, threshold: float, k_most: int) -> DataFrame:
    """u -> near: its best neighbours, distinct, best first. A list that is full of links gets twice the room, up to k_most."""
    if lists is not None:
        old = lists.select("u", F.explode("near").alias("e")).select("u", "e.v", "e.sim", F.lit(False).alias("new"))
        room = lists.select("u", "room")
        edges = edges.withColumn("new", F.lit(True)).unionByName(old)
    else:
        edges, room = edges.withColumn("new", F.lit(True)), None
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    near = one.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("sim", "v", "new")), asc=False).alias("near"))
    near = near.join(room, "u", "left").withColumn("room", F.coalesce("room", F.lit(k))) if room is not None else near.withColumn("room", F.lit(k))
    full = (F.size("near") >= F.col("room")) & (F.try_element_at("near", F.col("room"))["sim"] >= threshold)
    near = near.withColumn("room", F.when(full, F.least(F.col("room") * 2, F.lit(k_most))).otherwise(F.col("room")))
    near = near.withColumn("near", F.slice("near", 1, F.col("room")))
    return near.withColumn("worst", F.when(F.size("near") >= F.col("room"), F.element_at("near", -1)["sim"]).otherwise(F.lit(-2.0)))


def _refine(lists: DataFrame, units: DataFrame, k: int, threshold: float, k_most: int, turn: int) -> tuple[DataFrame, int]:
    edges = lists.select("u", F.explode("near").alias("e")).select("u", "e.v", "e.new")
    popular = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    # Of a node's reverse neighbours about k_most are drawn each time.
    back = left_join(edges, popular, "v")
    back = back.where(F.pmod(F.xxhash64("u", "v", F.lit(turn)), F.lit(1 << 20)) < F.lit(k_most) / F.col("n") * (1 << 20))
    around = edges.select(F.col("u").alias("node"), F.col("v").alias("other"), "new").unionByName(back.select(F.col("v").alias("node"), F.col("u").alias("other"), "new"))
    around = around.groupBy("node", "other").agg(F.max("new").alias("new"))
    facts = units.select("id", "half").join(lists.select(F.col("u").alias("id"), "worst"), "id", "left").select(F.col("id").alias("other"), "half", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    met = around.join(facts, "other").groupBy("node").agg(F.collect_list(F.struct("other", "half", "worst", "new")).alias("near"))
    pairs = met.where(F.exists("near", lambda r: r["new"])).select("near").mapInArrow(_local_join, "u long, v long, sim float")
    after = save(_best(pairs, lists, k, threshold, k_most))
    news = after.agg(F.sum(F.size(F.filter("near", lambda e: e["new"])))).first()[0]
    return after, int(news or 0)


def _cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.float64) for i in (2, 3))
        dims = np.array([len(b) // 8 for b in batch.column(2).to_pylist()])
        cos = np.add.reduceat(x * y, np.concatenate([[0], np.cumsum(dims)[:-1]])) if len(dims) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cos)], names=["a", "b", "cos"])


def _count_block(threshold: float):
    def count(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"])
        ids, n = np.asarray(table["id"]), np.asarray(table["n"])
        x = _matrix(table["unit"].combine_chunks(), np.float64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):  # a block with itself
            hit = (x @ x.T >= threshold)
            np.fill_diagonal(hit, False)
            return pa.table({"id": ids, "n": n, "links": hit @ n, "found": hit.sum(1)})
        hit = x[left] @ x[right].T >= threshold
        both = np.concatenate([left, right])
        return pa.table({"id": ids[both], "n": n[both], "links": np.concatenate([hit @ n[right], hit.T @ n[left]]), "found": np.concatenate([hit.sum(1), hit.sum(0)])})

    return count


def _bridges(threshold: float):
    """Pairs of components with a link between two blocks: products in single precision, near hits again in double."""

    def find(table: pa.Table) -> pa.Table:
        side, label = np.asarray(table["side"]), np.asarray(table["label"])
        order = np.lexsort((label, side))
        side, label = side[order], label[order]
        x = _matrix(table["unit"].combine_chunks().take(pa.array(order)), np.float64)
        single, lowest = x.astype(np.float32), np.float32(threshold - 1e-5 - 1e-6 * x.shape[1])
        n, found = int((side == 0).sum()), set()
        own = n == len(side)  # a block with itself
        for i in range(0, n, TILE):
            p = slice(i, min(i + TILE, n))
            for j in range(i if own else n, len(side), TILE):
                q = slice(j, j + TILE)
                if label[p][0] == label[p][-1] == label[q][0] == label[q][-1]:
                    continue
                a, b = np.nonzero((single[p] @ single[q].T >= lowest) & (label[p][:, None] != label[q]))
                for k in range(0, len(a), VERIFY):
                    u, v = a[k : k + VERIFY] + i, b[k : k + VERIFY] + j
                    hit = (x[u] * x[v]).sum(1) >= threshold
                    found.update(zip(label[u[hit]].tolist(), label[v[hit]].tolist(), strict=True))
        pairs = sorted({(max(c), min(c)) for c in found})
        return pa.table({"a": pa.array([c[0] for c in pairs], pa.int64()), "b": pa.array([c[1] for c in pairs], pa.int64())})

    return find


def _join_components(units: DataFrame, comps: DataFrame, size: int, threshold: float) -> DataFrame:
    """comps with those merged that have a link between them; a vector without a link so far is a component of its own."""
    labelled = units.select("id", "dim", "unit").join(comps, "id", "left").select("id", "dim", "unit", F.coalesce("component_id", "id").alias("label"), F.col("component_id").isNotNull().alias("linked"))
    labelled = save(labelled)
    blocks = max(1, min(SWEEP_BLOCKS, -(-size // SWEEP)))
    dealt = labelled.withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "label", "unit")
    dealt = dealt.repartition(blocks * (blocks + 1) // 2, "dim", "i", "j")  # few bytes, much work: not for adaptive execution to reduce
    bridges = save(dealt.groupBy("dim", "i", "j").applyInArrow(_bridges(threshold), "a long, b long").distinct())
    if bridges.isEmpty():
        drop(bridges, labelled)
        return comps
    merged = components(bridges).select(F.col("id").alias("label"), "component_id")
    after = left_join(labelled.select("id", "label", "linked"), merged, "label")
    after = save(after.where("linked or component_id is not null").select("id", F.coalesce("component_id", "label").alias("component_id")))
    drop(bridges, labelled)
    return after


def embedding_dedup(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, k: int = 12, rounds: int = 6, seed: int = 11) -> DataFrame:
    """id, n_links, component_id and kept of every row; links have a cosine of at least `threshold` in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do rows with a null id (component null, kept)
    and vectors of other lengths than each other. Equal vectors are one node with a count. Rows that repeat an id are taken to
    repeat its vector. Lists grow to 4k neighbours; links beyond that are found by exact blocks between components and inside them. Empty table: empty result.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    k_most = 4 * k
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    all_units = save(vectors.mapInArrow(_prepare, "id long, dim int, unit binary, half binary").dropDuplicates(["id"]))
    same = all_units.groupBy("unit").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    members = save(left_join(all_units.select("id", "unit"), same.where("n > 1"), "unit").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("n", F.lit(1)).alias("n")))
    reps = members.where("id = rep").select("id", "n")
    units = save(all_units.join(reps, "id"))
    size = units.count()

    ordered = units.mapInArrow(_signatures(seed), "order int, dim int, sig long, id long, half binary")
    parts = max(1, min(4096, size // 5000))
    start = ordered.repartitionByRange(parts, "order", "dim", "sig", "id").sortWithinPartitions("order", "dim", "sig", "id").mapInArrow(_adjacent, "u long, v long, sim float")
    lists = save(_best(start, None, k, threshold, k_most))
    for turn in range(1, rounds + 1):
        after, news = _refine(lists, units, k, threshold, k_most, turn)
        drop(lists)
        lists = after
        if news <= 0.002 * size * k:
            break
    near = lists.select("u", F.explode("near").alias("e")).where(F.col("e.sim") >= threshold - 0.01)
    pairs = near.select(F.greatest("u", "e.v").alias("a"), F.least("u", "e.v").alias("b")).distinct()
    both = pairs.join(units.select(F.col("id").alias("a"), F.col("unit").alias("x")), "a").join(units.select(F.col("id").alias("b"), F.col("unit").alias("y")), "b")
    links = save(both.select("a", "b", "x", "y").mapInArrow(_cosine, "a long, b long, cos double").where(F.col("cos") >= threshold).select("a", "b"))
    comps = _join_components(units, save(components(links)), size, threshold)

    # Exact counts: every component in blocks of about BLOCK vectors, each pair of blocks in a task of its own.
    inside = units.join(comps, "id").select("id", "n", "unit", "component_id")
    sizes = comps.groupBy("component_id").agg(F.count(F.lit(1)).alias("m"))
    inside = left_join(inside, sizes, "component_id")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    inside = inside.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("component_id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "n", "unit")
    counted = save(met.groupBy("component_id", "i", "j").applyInArrow(_count_block(threshold), "id long, n long, links long, found long").groupBy("id").agg(F.max("n").alias("n"), F.sum("links").alias("links"), F.sum("found").alias("found")))
    # The audit: of all links between different vectors, the share that the refined lists hold.
    true, held = counted.agg(F.sum("found")).first()[0] or 0, links.count()
    _LOG.info("NN-descent held %d of %d links (recall %.4f); the exact blocks gave the rest", held, true // 2, 2 * held / true if true else 1.0)
    found = counted.join(comps, "id").select(F.col("id").alias("rep"), "links", "component_id")
    known = members.join(found, "rep", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = vectors.select("id").join(known, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
