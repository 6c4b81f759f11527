"""Suffix-array deduplication: bytes covered by long substrings that also start in a document with a smaller id.

Windows of `length` bytes meet by their minimiser (the smallest hash of their KMER-byte pieces), so equal windows land in one bucket
whatever the documents. Minimisers found in one document only are dropped first. In a bucket the runs of windows
(segments) are concatenated, suffix-sorted and turned into a Burrows-Wheeler transform; breadth-first backward extension
of all intervals yields the common prefixes by increasing length and stops at `length`: the intervals left
are the classes of equal windows, and each class has a smallest document id.

Repeats inside a slice of documents are settled before any shuffle, so a passage in a third of all documents sends one
entry per slice. All traffic between tasks is packed arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm import bytehash
from marketweave.llm.common import small_batches

KMER = 20
#: Bytes of a slice; temporary arrays take about 100 times as much.
SLICE = 1 << 20
#: Suffixes sorted at a time (more only where one minimiser has more).
CHUNK = 100_000


def _runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: text index, start byte, windows in the run, minimiser. Runs are cut at `length`-KMER+1 windows."""
    w = length - KMER + 1
    n = len(data) - length + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64)
    p, q = bytehash._power_tables(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(bytehash._TABLE[data] * p[: len(data)], out=run[1:])
    low = bytehash.mix((run[KMER:] - run[:-KMER]) * q[: len(data) - KMER + 1])
    width = 1
    while 2 * width <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < w:
        low = np.minimum(low[: -(w - width)], low[w - width :])
    low = low[:n]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    at = np.flatnonzero(np.arange(n) + length <= offsets[text + 1])
    low, text = low[at], text[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    head = np.flatnonzero(since % w == 0)
    return text[head], at[head], np.diff(np.append(head, len(at))), low[head]


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))


def _blobs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    size = values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _first(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins, with the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _key(low: np.ndarray, parts: int) -> np.ndarray:
    return (low >> np.uint64(32) << np.uint64(32)) | (low % np.uint64(parts))


def _minimisers(length: int, parts: int):
    """Rows for lookup by part (part, uids, upper halves of the keys); keys known to be shared inside the slice travel along (uid, whole keys, no flags)."""
    schema = pa.schema([("part", pa.int32()), ("uids", pa.list_(pa.int64())), ("counts", pa.binary()), ("keys", pa.binary()), ("shared", pa.binary())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bytehash.texts(batches, SLICE):
            uid = np.asarray(part.column(0))
            text, _, _, low = _runs(*bytehash.utf8(part.column(1)), length)
            key = _key(low, parts)
            order = np.lexsort((text, key))
            key, text = key[order], text[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            key, text = key[new], text[new]
            first = _first(key)
            many = np.repeat(np.diff(first) > 1, np.diff(first))
            lead = first[:-1]
            k, t, flag = key[lead], text[lead], many[lead]
            by = np.lexsort((t, k & np.uint64(0xFFFFFFFF)))
            k, t, flag = k[by], t[by], flag[by].astype(np.uint8)
            cut = _first(k & np.uint64(0xFFFFFFFF))
            if len(k):
                # A text's keys stand together in a part: its uid is written once, with their number.
                run = _first((k & np.uint64(0xFFFFFFFF)) * np.uint64(part.num_rows) + t.astype(np.uint64))
                of_part = np.searchsorted(run, cut)
                yield pa.RecordBatch.from_arrays([
                    pa.array((k[cut[:-1]] & np.uint64(0xFFFFFFFF)).astype(np.int32)), _lists(uid[t[run[:-1]]], of_part), _blobs(np.diff(run).astype(np.uint32), of_part),
                    _blobs((k >> np.uint64(32)).astype(np.uint32), cut), _blobs(flag, cut)], schema=schema)
            if many.any():
                k, t = key[many], text[many]
                by = np.argsort(t, kind="stable")
                k, t = k[by], t[by]
                cut = _first(t)
                yield pa.RecordBatch.from_arrays([
                    pa.array((uid[t[cut[:-1]]] % parts).astype(np.int32)), _lists(uid[t[cut[:-1]]], np.arange(len(cut))), pa.array([b""] * (len(cut) - 1), pa.binary()), _blobs(k, cut), pa.array([b""] * (len(cut) - 1), pa.binary())], schema=schema)

    return find


def _flat(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """All items of a packed column, end to end."""
    if pa.types.is_list(column.type):
        return np.concatenate([np.zeros(0, kind), *(np.asarray(c.flatten()) for c in column.chunks)]).astype(kind)
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in column.to_pylist())])


def _shared(table: pa.Table) -> pa.Table:
    """uid, keys: the minimisers of a part that more than one slice has, for documents that don't know it yet, and what they know."""
    told = pc.equal(pc.binary_length(table["shared"]), 0)
    known = table.filter(told)
    table = table.filter(pc.invert(told))
    known = pa.table({"uid": pa.array(_flat(known["uids"], np.int64), pa.int64()), "keys": known["keys"]})
    if not table.num_rows:
        return known
    uid, key, flag = np.repeat(_flat(table["uids"], np.int64), _flat(table["counts"], np.uint32)), _flat(table["keys"], np.uint32), _flat(table["shared"], np.uint8)
    part = np.uint64(table["part"][0].as_py())
    order = np.argsort(key, kind="stable")
    first = _first(key[order])
    size = np.diff(first)
    hit = np.zeros(len(key), bool)
    hit[order] = np.repeat(size > 1, size)
    uid, key = uid[hit & (flag == 0)], key[hit & (flag == 0)].astype(np.uint64) << np.uint64(32) | part
    order = np.argsort(uid, kind="stable")
    uid, key = uid[order], key[order]
    cut = _first(uid)
    return pa.concat_tables([pa.table({"uid": pa.array(uid[cut[:-1]], pa.int64()), "keys": _blobs(key, cut)}), known])


def _rows(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """A zero-padded matrix of segments; bytes are shifted by one, so that zero ends a segment (255 isn't a UTF-8 byte)."""
    padded = np.concatenate([data + np.uint8(1), np.zeros(width, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, width)[start].copy() if len(start) else np.zeros((0, width), np.uint8)
    out[np.arange(width) >= size[:, None]] = 0
    return out


def _covers(uid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[pa.Array]:
    order = np.argsort(uid, kind="stable")
    uid, lo, hi = uid[order], lo[order], hi[order]
    cut = _first(uid)
    return [pa.array(uid[cut[:-1]], pa.int64()), _lists(lo.astype(np.int32), cut), _lists(hi.astype(np.int32), cut)]


def _pack(*arrays: np.ndarray) -> tuple[int, bytes]:
    raw = b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(size: int, packed: bytes, n: int, kinds: list[type]) -> list[np.ndarray]:
    """Arrays of n items of each kind, then the bytes that are left."""
    raw, at, out = pa.decompress(packed, size, codec="zstd", asbytes=True), 0, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


def _segments(length: int, parts: int):
    """Segments whose minimiser is shared, packed by part; covers of documents that repeat a smaller id's segment in the slice travel along (n = 0)."""
    schema = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("pack", pa.binary()), ("uid", pa.int64()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))])
    width = 2 * length - KMER

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bytehash.texts(batches, SLICE):
            uid, ids = np.asarray(part.column(0)), np.asarray(part.column(1))
            data, offsets = bytehash.utf8(part.column(2))
            known = [np.frombuffer(b, np.uint64) for row in part.column(3).to_pylist() for b in row]
            text, start, n, low = _runs(data, offsets, length)
            keep = np.isin(_key(low, parts), np.concatenate(known) if known else np.zeros(0, np.uint64))
            text, start, n, low = text[keep], start[keep], n[keep], low[keep]
            size = n + length - 1
            rows = _rows(data, start, size, width)
            _, group = np.unique(rows.view(f"S{width}").ravel(), return_inverse=True)
            least = np.full(group.max() + 1 if len(group) else 0, np.iinfo(np.int64).max)
            np.minimum.at(least, group, ids[text])
            done = ids[text] > least[group]
            at = start - offsets[text]
            if done.any():
                u, lo, hi = _covers(uid[text[done]], at[done], (at + size)[done])
                m = len(u)
                zero = pa.array(np.zeros(m, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array((np.asarray(u) % parts).astype(np.int32)), zero, zero, pa.array([b""] * m, pa.binary()), u, lo, hi], schema=schema)
            if not done.all():
                open_ = np.flatnonzero(~done)
                p = (low[open_] % np.uint64(parts)).astype(np.int32)
                by = np.argsort(p, kind="stable")
                open_, p = open_[by], p[by]
                cut = _first(p)
                packs = []
                for x in np.split(open_, cut[1:-1]):
                    packs.append(_pack(uid[text[x]], np.diff(ids[text[x]], prepend=0), at[x].astype(np.int32), low[x].astype(np.uint32), size[x].astype(np.uint8), rows[x][np.arange(width) < size[x, None]]))
                m = len(packs)
                yield pa.RecordBatch.from_arrays([
                    pa.array(p[cut[:-1]]), pa.array(np.diff(cut).astype(np.int32)), pa.array([x[0] for x in packs], pa.int32()), pa.array([x[1] for x in packs], pa.binary()),
                    pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32())), pa.nulls(m, pa.list_(pa.int32()))], schema=schema)

    return cut_out


def interval_classes(rows: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, class) of every window of `length` bytes that occurs more than once in the zero-ended rows.

    Suffixes are sorted with ties by row. Level by level, the interval of a string x is extended backwards by every byte c before its
    suffixes: the rows of cx are those of x with c before them, in the same order. Intervals of one suffix go no further.
    """
    width = rows.shape[1]
    row = np.repeat(np.arange(len(rows)), size + 1)
    off = np.arange(len(row)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    padded = np.zeros((len(rows), 2 * width + 2), np.uint8)
    padded[:, 1 : width + 1] = rows
    flat = padded.ravel()
    where = row * padded.shape[1] + off + 1
    order = np.argsort(np.lib.stride_tricks.sliding_window_view(flat, width)[where].view(f"S{width}").ravel(), kind="stable")
    before = flat[where[order] - 1]
    back = np.argsort(before, kind="stable")  # back[k]: the suffix whose extension by its preceding byte is suffix k
    live_at = before[back] > 0
    group = np.zeros(len(order), np.int32)
    for _ in range(length):
        g = np.where(live_at, group[back], -1)
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (before[back[1:]] != before[back[:-1]])
        single = new & np.append(new[1:], True)
        group = np.cumsum(new, dtype=np.int32)
        group[(g < 0) | single] = -1
        if (group < 0).all():
            break
    hit = np.flatnonzero(group >= 0)
    return row[order[hit]], off[order[hit]], group[hit]


def _bucket(length: int):
    width = 2 * length - KMER
    names = ["uid", "lo", "hi"]

    def settle(table: pa.Table) -> pa.Table:
        told = table.filter(pc.equal(table["n"], 0)).select(names)
        table = table.filter(pc.greater(table["n"], 0))
        if not table.num_rows:
            return told
        found = [_unpack(*x, [np.int64, np.int64, np.int32, np.uint32, np.uint8]) for x in zip(table["size"].to_pylist(), table["pack"].to_pylist(), table["n"].to_pylist(), strict=True)]
        uid, lo, low, size, blob = (np.concatenate([x[i] for x in found]) for i in (0, 2, 3, 4, 5))
        ids = np.concatenate([np.cumsum(x[1]) for x in found])
        lo, size = lo.astype(np.int64), size.astype(np.int64)
        hi = lo + size
        rows = _rows(blob - np.uint8(1), np.cumsum(size) - size, size, width)
        _, lead, group = np.unique(rows.view(f"S{width}").ravel(), return_index=True, return_inverse=True)
        least = np.full(len(lead), np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids)
        done = ids > least[group]
        out = [(uid[done], lo[done], hi[done])]
        # Windows of distinct segments can only be equal under one minimiser.
        order = np.argsort(low[lead], kind="stable")
        first = _first(low[lead][order])
        several = np.flatnonzero(np.diff(first) > 1)
        entries = np.argsort(group, kind="stable")
        entry_at = np.searchsorted(group[entries], np.arange(len(lead) + 1))
        pick: list[np.ndarray] = []
        total = 0
        for i in several.tolist() + [-1]:
            if pick and (i < 0 or total > CHUNK):
                seg = np.concatenate(pick)
                r, o, c = interval_classes(rows[lead[seg]], size[lead[seg]], length)
                if len(c):
                    doc = least[seg[r]]
                    edge = _first(c)
                    low_doc = np.repeat(np.minimum.reduceat(doc, edge[:-1]), np.diff(edge))
                    r, o = seg[r[doc > low_doc]], o[doc > low_doc]
                    by = np.lexsort((o, r))
                    r, o = r[by], o[by]
                    new = np.ones(len(r), bool)
                    new[1:] = (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1)
                    head = np.flatnonzero(new)
                    tail = np.append(head[1:], len(r)) - 1 if len(r) else head
                    seg_r, o1, o2 = r[head], o[head], o[tail] + length
                    n = entry_at[seg_r + 1] - entry_at[seg_r]
                    e = entries[np.repeat(entry_at[seg_r], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    o1, o2 = np.repeat(o1, n), np.repeat(o2, n)
                    own = ~done[e]
                    out.append((uid[e[own]], lo[e[own]] + o1[own], lo[e[own]] + o2[own]))
                pick, total = [], 0
            if i >= 0:
                pick.append(order[first[i] : first[i + 1]])
                total += int(size[lead[pick[-1]]].sum())
        own = pa.table(dict(zip(names, _covers(*(np.concatenate(x) for x in zip(*out))), strict=True)))
        return pa.concat_tables([told.cast(own.schema), own])

    return settle


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        bodies, uncovered = batch.column(2).to_pylist(), batch.column(3).is_null().to_pylist()
        for i, body in enumerate(bodies):
            if uncovered[i]:
                found.append((len(body), 0, 0, hashlib.sha256(body).hexdigest(), body))
                continue
            data = np.frombuffer(body, np.uint8)
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, np.asarray(batch.column(3)[i].values.flatten()), 1)
            np.add.at(edge, np.asarray(batch.column(4)[i].values.flatten()), -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rest = data[~gone].tobytes()
            found.append((len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest))
        yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([x[j] for x in found], _OUT.field(j + 1).type) for j in range(5))], schema=_OUT)


_OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that remain) of every row.

    A byte goes if a `length`-byte string over it also starts in a row with a smaller id; all strings are judged on the input. Null text is
    empty. Rows with a null id are left whole and remove nothing. Rows that share an id don't remove each other's bytes; repeated rows have
    one result. Texts shorter than `length` stay whole. Only a slice of about 1 MB (or one text) is in a task's memory at once.
    """
    if length <= KMER:
        raise ValueError(f"length must be over {KMER}")
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    source = docs.select(F.xxhash64(id_col, text_col).alias("uid"), F.col(id_col).cast("long").alias("id"), body.alias("body"))
    able = source.where(F.col("id").isNotNull() & (F.octet_length("body") >= length))
    bytes_in = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(64, min(1 << 20, bytes_in >> 23))
    found = able.select("uid", "body").mapInArrow(_minimisers(length, parts), "part int, uids array<long>, counts binary, keys binary, shared binary")
    known = found.groupBy("part").applyInArrow(_shared, "uid long, keys binary")
    wanted = known.groupBy("uid").agg(F.collect_list("keys").alias("keys"))
    # Texts are dealt by uid once: the exchange is the same in this join and in the last one, and Spark reuses it.
    suspects = source.join(wanted, "uid").select("uid", "id", "body", "keys")
    cuts = suspects.mapInArrow(_segments(length, parts), "part int, n int, size int, pack binary, uid long, lo array<int>, hi array<int>")
    covers = cuts.groupBy("part").applyInArrow(_bucket(length), "uid long, lo array<int>, hi array<int>")
    covers = covers.groupBy("uid").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    found = source.join(covers, "uid", "left").select("uid", "id", "body", "lo", "hi")
    out = found.mapInArrow(_remove, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)
