"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units where no piece could span the cut. The lattice of every distinct unit is built relationally: its substrings of
bounded length are exploded, equi-joined to the piece table (broadcast: it has the vocabulary's size) and grouped by unit; a higher-order
aggregate folds the edges into the unit's pieces. Unigram models fold by Viterbi. BPE models need another fold: their
scores are merge ranks, and the best sum of ranks isn't what merging gives, so the fold applies the best merge again and again.
Ids of the HOT most frequent units go to the tasks as one packed table; those of other units reach their documents through joins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketweave.llm import bytehash
from marketweave.llm.common import drop, release, save, small_batches

#: Units whose ids are sent to every task, at most; about 25 bytes each.
HOT = 1 << 20
SPACE = "▁"
#: Units in one part of the lattice: few, so that a part's edges die young in the collector.
GROUP = 4_000
#: Units of up to so many characters fold in a bit mask; longer ones in a Python heap.
MASK = 60
_PAIRS = 1 << 22


@dataclass
class PieceModel:
    """What encoding needs of a model. pieces: (text, id, score) of ordinary pieces; byte_ids: ids of the 256 bytes, or empty."""

    kind: str
    pieces: list[tuple[str, int, float]]
    byte_ids: list[int]
    unk: int
    prefix: bool

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Which characters may stand side by side in a unit: for two bytes (0 never, 1 in some piece, 2 look at the characters),
        and a bit for each hashed pair of characters. A space counts as the mark it becomes."""
        wide = np.zeros(_PAIRS, bool)
        quick = np.zeros((256, 256), np.uint8)
        quick[128:, :] = 2  # after the end of a longer character
        quick[:, 192:] = 2  # before one
        quick[:, 128:192] = 1  # inside one
        for text, _, _ in self.pieces:
            c = np.frombuffer(text.replace(SPACE, " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
            wide[_pair(c[:-1], c[1:])] = True
            for x, y in zip(c[:-1].tolist(), c[1:].tolist(), strict=True):
                if x < 128 and y < 128:
                    quick[x, y] = 1
        return quick.ravel(), wide

    def table(self, spark: SparkSession) -> DataFrame:
        """piece, id, rank (0 is best), score."""
        order = sorted(self.pieces, key=lambda p: (-p[2], p[1]))
        kind = T.StructType([T.StructField("piece", T.StringType()), T.StructField("id", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())])
        ranks: dict[float, int] = {}
        rows = [(p, i, ranks.setdefault(s, len(ranks)), s) for p, i, s in order]
        return spark.createDataFrame(rows, kind)

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids end to end, with spaces for the marks, and where each id's begin."""
        out = {i: p.replace(SPACE, " ").encode() for p, i, _ in self.pieces} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        rows = [out.get(i, b"") for i in range(max(out) + 1)] if out else []
        return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def load_model(path: str) -> PieceModel:
    """Reads a SentencePiece model on the driver. Only models without a normalisation table, extra white-space removal and user-defined symbols."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models that leave the text as it is")
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    ordinary, byte_ids, unk = [], [0] * 256, 0
    for i, p in enumerate(proto.pieces):
        if p.type == kinds.USER_DEFINED:
            raise ValueError("user-defined symbols aren't supported")
        if p.type == kinds.NORMAL:
            ordinary.append((p.piece, i, p.score))
        elif p.type == kinds.BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
        elif p.type == kinds.UNKNOWN:
            unk = i
    kind = "bpe" if proto.trainer_spec.model_type == 2 else "unigram"
    del sentencepiece
    return PieceModel(kind, ordinary, byte_ids if proto.trainer_spec.byte_fallback else [], unk, norm.add_dummy_prefix)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (bytehash.mix(a << np.uint64(32) | b) % np.uint64(_PAIRS)).astype(np.int64)


def _code(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters whose first bytes are at `at`; data has four bytes to spare."""
    b = data[at].astype(np.uint64)
    c1, c2, c3 = (data[at + k].astype(np.uint64) & np.uint64(0x3F) for k in (1, 2, 3))
    six = np.uint64(6)
    two, three = (b & np.uint64(0x1F)) << six | c1, ((b & np.uint64(0x0F)) << six | c1) << six | c2
    code = np.where(b < 0x80, b, np.where(b < 0xE0, two, np.where(b < 0xF0, three, (((b & np.uint64(7)) << six | c1) << six | c2) << six | c3)))
    return np.where(code == ord(SPACE), np.uint64(32), code)


def units(data: np.ndarray, offsets: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every unit, their hashes, and the index at which each text's units begin. Texts come with the space put before them."""
    quick, wide = pairs
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(len(offsets), np.int64)
    state = quick[data[:-1].astype(np.uint16) << 8 | data[1:]]
    cut = np.ones(n, bool)
    cut[1:] = state == 0
    slow = np.flatnonzero(state == 2) + 1
    slow = slow[(data[slow] & 0xC0) != 0x80]
    if len(slow):
        spare = np.concatenate([data, np.zeros(4, np.uint8)])
        back = slow - 1
        for _ in range(3):
            back = np.where((data[back] & 0xC0) == 0x80, np.maximum(back - 1, 0), back)
        cut[slow] = ~wide[_pair(_code(spare, back), _code(spare, slow))]
    inside = np.flatnonzero((data & 0xC0) == 0x80)
    cut[inside] = False
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    p, q = bytehash._power_tables(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(bytehash._TABLE[data] * p[:n], out=run[1:])
    h = bytehash.mix(bytehash.mix((run[end] - run[start]) * q[start]) + np.uint64(seed)).view(np.int64)
    return start, end, h, np.searchsorted(start, offsets)


def _distinct(pairs, seed: int):
    schema = pa.schema([("h", pa.int64()), ("unit", pa.string()), ("n", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array([v[0] for v in held.values()], pa.string()), pa.array([v[1] for v in held.values()], pa.int64())], schema=schema)
            held.clear()
            return rows

        for part in bytehash.texts(batches, 2 << 20):
            data, offsets = bytehash.utf8(part.column(0))
            start, end, h, _ = units(data, offsets, pairs.value, seed)
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            raw = data.tobytes()
            for k, s, e, c in zip(u.tolist(), start[at].tolist(), end[at].tolist(), n.tolist(), strict=True):
                if k in held:
                    held[k][1] += c
                else:
                    held[k] = [raw[s:e].decode("utf-8", "replace").replace(" ", SPACE), c]
            if len(held) > 300_000:
                yield flush()
        yield flush()

    return find


def lattice(words: DataFrame, table: DataFrame, longest: int, on: str = "unit", scores: bool = True) -> DataFrame:
    """words: h, unit -> h, length, edges: the pieces that are substrings of the unit, as (rank, start, len, id) with their score or, without
    scores, bit masks of their ends and of what lies between.

    Units are dealt first, GROUP to a part, and exploded and grouped where they are: no edge is shuffled, and a part's groups fit in memory.
    """
    spark = words.sparkSession
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(8 * GROUP))
    words = words.repartition(max(1, -(-words.count() // GROUP)), "h")
    at = words.select("h", on, F.length(on).alias("length")).withColumn("start", F.explode(F.sequence(F.lit(0), F.col("length") - 1)))
    at = at.withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("length") - F.col("start")))))
    sub = at.withColumn("sub", F.substring(on, F.col("start") + 1, F.col("len"))).withColumn("key", F.xxhash64("sub"))
    edges = sub.join(F.broadcast(table.withColumn("key", F.xxhash64("piece"))), "key").where("sub = piece")
    last = F.col("start") + F.col("len")
    more = ["score"] if scores else [_bit(F.col("start")).bitwiseOR(_bit(last)).alias("ends"), (_bit(last) - _bit(F.col("start") + 1)).alias("inner")]
    return edges.groupBy("h").agg(F.max("length").alias("length"), F.collect_list(F.struct("rank", "start", "len", "id", *more)).alias("edges"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def fold_bpe(lat: DataFrame) -> DataFrame:
    """h, kept: the edges that are left when the best merge is applied until none is possible (units of up to MASK characters).

    The state is a mask of the characters that begin a symbol. A merge is an edge both of whose ends are set and that has exactly one
    bit set inside; of all the one with the best rank, the leftmost of equals, clears that bit.
    """
    lat = lat.withColumn("merges", F.sort_array(F.filter("edges", lambda e: e["len"] > 1)))
    inside = lambda m, e: m.bitwiseAND(e["inner"])

    def one(mask: Column, e: Column) -> Column:
        ready = (mask.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(inside(mask, e)) == 1)
        return F.when(ready, inside(mask, e)).otherwise(F.lit(0).cast("long"))

    def step(mask: Column, _: Column) -> Column:
        found = lambda bit, e: F.when(bit != 0, bit).otherwise(one(mask, e))
        after = lambda bit: F.when(bit == 0, F.bitwise_not(mask)).otherwise(mask.bitwiseXOR(bit))
        # A mask without a merge is complemented, which makes it negative: nothing more is looked for.
        return F.when(mask < 0, mask).otherwise(F.aggregate("merges", F.lit(0).cast("long"), found, after))

    whole = _bit(F.col("length") + 1) - F.lit(1).cast("long")
    steps = F.when((F.size("merges") > 0) & (F.col("length") > 1), F.sequence(F.lit(1), F.least(F.col("length") - 1, F.size("merges")))).otherwise(F.array().cast("array<int>"))
    lat = lat.withColumn("mask", F.aggregate(steps, whole, step)).withColumn("mask", F.when(F.col("mask") < 0, F.bitwise_not("mask")).otherwise(F.col("mask")))
    last = lambda e: (F.col("mask").bitwiseAND(e["ends"]) == e["ends"]) & (F.col("mask").bitwiseAND(e["inner"]) == 0)
    return lat.select("h", F.filter("edges", last).alias("kept"))


def fold_viterbi(lat: DataFrame, unknown: float) -> DataFrame:
    """h, kept: the edges of the best-scoring segmentation; a character without a piece costs `unknown`.

    The state holds the best score and last edge for every position up to the one reached; positions are folded from left to right.
    """
    def step(state: Column, j: Column) -> Column:
        ending = F.filter("edges", lambda e: e["start"] + e["len"] == j)
        ways = F.transform(ending, lambda e: F.struct((F.element_at(state, e["start"] + 1)["s"] + e["score"]).alias("s"), (-e["start"]).alias("start"), e["len"].alias("len"), e["id"].alias("id")))
        alone = F.struct((F.element_at(state, j)["s"] + F.lit(unknown)).alias("s"), (1 - j).alias("start"), F.lit(1).alias("len"), F.lit(-1).alias("id"))
        return F.concat(state, F.array(F.array_max(F.concat(ways, F.array(alone)))))

    origin = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit(-1).alias("id")))
    best = lat.withColumn("best", F.aggregate(F.sequence(F.lit(1), F.col("length")), origin, step))

    def back(path: Column, _: Column) -> Column:
        at = F.when(F.size(path) == 0, F.col("length")).otherwise(-F.element_at(path, -1)["start"])
        return F.when(at > 0, F.concat(path, F.array(F.element_at("best", at + 1)))).otherwise(path)

    path = F.aggregate(F.sequence(F.lit(1), F.col("length")), F.array().cast("array<struct<s:double,start:int,len:int,id:int>>"), back)
    kept = F.transform(F.filter(path, lambda e: e["id"] >= 0), lambda e: F.struct(F.lit(0).alias("rank"), (-e["start"]).alias("start"), e["len"].alias("len"), e["id"].alias("id"), F.lit(0.0).alias("score")))
    return best.select("h", kept.alias("kept"))


def merge_long(text: str, pieces: dict[str, tuple[float, int]]) -> list[tuple[int, int]]:
    """(start, end) of the symbols of a long unit after all merges; a heap holds the lattice's edges that are possible now."""
    n = len(text)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and nxt[i] < n:
            end = nxt[nxt[i]]
            got = pieces.get(text[i:end])
            if got:
                heapq.heappush(heap, (-got[0], i, nxt[i], end))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, mid, end = heapq.heappop(heap)
        if not alive[i] or nxt[i] != mid or nxt[mid] != end:
            continue
        alive[mid] = False
        nxt[i] = end
        if end < n:
            prv[end] = i
        offer(i)
        offer(prv[i])
    return [(i, nxt[i]) for i in range(n) if alive[i]]


def unit_ids(words: DataFrame, model: PieceModel) -> DataFrame:
    """words: h, unit, n -> h, n, ids array<int>."""
    spark = words.sparkSession
    table = model.table(spark)
    short = words.where(F.length("unit") <= MASK) if model.kind == "bpe" else words
    lat = lattice(short, table, model.longest, scores=model.kind != "bpe")
    folded = fold_bpe(lat) if model.kind == "bpe" else fold_viterbi(lat, min((s for _, _, s in model.pieces), default=0.0) - 10.0)
    kept = F.array_sort(F.transform("kept", lambda e: F.struct(e["start"].alias("start"), e["len"].alias("len"), e["id"].alias("id"))))
    got = short.select("h", "unit", "n").join(folded.select("h", kept.alias("kept")), "h", "left")
    # Characters that are no piece become their bytes, or the unknown id.
    covered = F.coalesce(F.aggregate("kept", F.lit(0), lambda s, e: s + e["len"]), F.lit(0))
    digits = lambda c: F.hex(F.encode(c, "utf-8"))
    first_byte = model.byte_ids[0] if model.byte_ids else None
    if first_byte is not None and model.byte_ids != list(range(first_byte, first_byte + 256)):
        raise ValueError("byte pieces must be in order")
    def spelled(c: Column) -> Column:
        if first_byte is None:
            return F.array(F.lit(model.unk))
        return F.transform(F.sequence(F.lit(1), F.length(digits(c)) - 1, F.lit(2)), lambda k: (F.conv(F.substring(digits(c), k, F.lit(2)), 16, 10).cast("int") + F.lit(first_byte)))
    inside = lambda i: F.exists(F.coalesce("kept", F.array().cast("array<struct<start:int,len:int,id:int>>")), lambda e: (e["start"] < i) & (i < e["start"] + e["len"]))
    def at(i: Column) -> Column:
        own = F.filter(F.coalesce("kept", F.array().cast("array<struct<start:int,len:int,id:int>>")), lambda e: e["start"] == i)
        return F.when(F.size(own) > 0, F.transform(own, lambda e: e["id"])).when(inside(i), F.array().cast("array<int>")).otherwise(spelled(F.substring("unit", i + 1, F.lit(1))))
    slow = F.flatten(F.transform(F.sequence(F.lit(0), F.length("unit") - 1), at))
    out = got.select("h", "n", F.when(covered == F.length("unit"), F.transform("kept", lambda e: e["id"])).otherwise(slow).alias("ids"))
    if model.kind != "bpe":
        return out
    vocabulary = {p: (s, i) for p, i, s in model.pieces}
    byte_ids, unk = model.byte_ids, model.unk
    shared = spark.sparkContext.broadcast(vocabulary)

    def long_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for text in batch.column(1).to_pylist():
                own = []
                for a, b in merge_long(text, shared.value):
                    got = shared.value.get(text[a:b])
                    own += [got[1]] if got else [byte_ids[x] for x in text[a:b].encode()] if byte_ids else [unk]
                ids.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int32()))], names=["h", "n", "ids"])

    long = words.where(F.length("unit") > MASK).select("h", "unit", "n").mapInArrow(long_units, "h long, n long, ids array<int>")
    return out.unionByName(long)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(1)
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(b.column(0)).tobytes()], pa.binary()), pa.array([np.asarray(pc.list_value_length(ids)).astype(np.int32).tobytes()], pa.binary()), pa.array([np.asarray(ids.flatten()).astype(np.int32).tobytes()], pa.binary())], names=["h", "n", "ids"])


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [len(x).to_bytes(4, "little") + pa.compress(x, codec="zstd", asbytes=True) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["uid", "id", "body"])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        full = [pa.decompress(x[4:], int.from_bytes(x[:4], "little"), codec="zstd", asbytes=True) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(full, pa.binary()), b.column(2)], names=["id", "body", "own"])


def encode(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id, n_pieces, ids array<int> and round_trip (decoding gives the text again) of every row.

    Null and empty texts have no pieces. Ids equal those of the model's own library. round_trip is false only for texts that hold the
    mark U+2581 itself, which decodes to a space. Rows may repeat, also their ids. No row is cut; a document's texts are read whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.xxhash64(id_col, text_col).alias("uid"), F.col(id_col).alias("id"), F.concat(F.when(F.length(F.col(text_col)) > 0, " " if model.prefix else "").otherwise(""), F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("body"))
    pairs = spark.sparkContext.broadcast(model.pairs())
    prefix = model.prefix
    for seed in range(5):  # another seed in the unlikely case that two units share a hash
        found = source.select("body").mapInArrow(_distinct(pairs, seed), "h long, unit string, n long")
        words = save(found.groupBy("h", "unit").agg(F.sum("n").alias("n")), compression="zstd")
        del found
        if words.select("h").distinct().count() == words.count():
            break
    release(spark)
    # A task takes several parts one after the other and writes one file for all.
    coded = save(unit_ids(words, model).coalesce(max(16, words.count() // (8 * GROUP))), compression="zstd")
    drop(words)
    release(spark)
    counts = coded.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("level")).collect()  # at most 4 * 63 rows
    level, room = 1000, hot
    for r in counts:
        if r[1] > room:
            break
        level, room = r[0], room - r[1]
    is_hot = F.floor(F.log2("n") * 4).cast("int") >= F.lit(level)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    chunks = coded.where(is_hot).select("h", "ids").mapInArrow(_pack, "h binary, n binary, ids binary").collect()  # at most `hot` units
    small_batches(spark)
    h = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(c[0], np.int64) for c in chunks)])
    n = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(c[1], np.int32) for c in chunks)]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(c[2], np.int32) for c in chunks)])
    del chunks
    release(spark)
    order = np.argsort(h)
    flat = flat[_ragged((np.cumsum(n) - n)[order], n[order])]
    if len(flat) and 0 <= flat.min() and flat.max() < 1 << 16:
        flat = flat.astype(np.uint16)
    begin = np.concatenate([[0], np.cumsum(n[order])])
    begin = begin.astype(np.int32) if begin[-1] < 1 << 31 else begin
    shared = spark.sparkContext.broadcast((h[order], begin, flat, slots(h[order])))
    del h, n, flat, order, begin

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value[0], shared.value[3]
        for part in bytehash.texts(batches, 1 << 20):
            _, _, h, first = units(*bytehash.utf8(part.column(1)), pairs.value, seed)
            missing = lookup(table, keys, h) < 0
            lists = [np.unique(h[a:b][missing[a:b]]) for a, b in zip(first[:-1], first[1:], strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))], names=["uid", "hs"])

    asked = source.select("uid", "body").mapInArrow(rare, "uid long, hs array<long>").where("size(hs) > 0").dropDuplicates(["uid"]).select("uid", F.explode("hs").alias("h"))
    told = asked.join(coded.where(~is_hot).select("h", "ids"), "h").groupBy("uid").agg(F.collect_list(F.struct("h", "ids")).alias("own"))
    # Texts travel packed: they are most of what is shuffled.
    rows = source.mapInArrow(_squeeze, f"uid long, id {dict(source.dtypes)['id']}, body binary").join(told, "uid", "left").select("id", "body", "own")
    decoder = spark.sparkContext.broadcast(model.decoder())
    schema = pa.schema([("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, begin, flat, table = shared.value
        for part in bytehash.texts(_expand(batches), 1 << 20):
            data, offsets = bytehash.utf8(part.column(1))
            _, _, h, first = units(data, offsets, pairs.value, seed)
            own = part.column(2).flatten()
            own_h, own_ids = np.asarray(own.field(0)), own.field(1)
            own_flat, own_first = np.asarray(own_ids.flatten()), np.asarray(own_ids.offsets).astype(np.int64)
            own_first = own_first - own_first[0]
            lead = np.unique(own_h, return_index=True)
            where, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            at = lookup(table, keys, h)
            ok = at >= 0
            where[ok], count[ok] = begin[at[ok]], begin[at[ok] + 1] - begin[at[ok]]
            rest = np.flatnonzero(~ok)
            if len(rest):
                at = lead[1][np.searchsorted(lead[0], h[rest])]
                where[rest], count[rest] = own_first[:-1][at], np.diff(own_first)[at]
            place, sent = _ragged(where, count), np.repeat(ok, count)
            ids = np.empty(len(place), np.int32)
            ids[sent], ids[~sent] = flat[place[sent]], own_flat[place[~sent]]
            ends = np.concatenate([[0], np.cumsum(count)])[first]
            back, back_first = decoded(ids, ends, *decoder.value, prefix)
            raw, text = data.tobytes(), back.tobytes()
            lead = int(prefix)
            same = [raw[a + lead : b] == text[c:d] for a, b, c, d in zip(offsets[:-1], offsets[1:], back_first[:-1], back_first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array(same)], names=["id", *schema.names])

    kind = dict(source.dtypes)["id"]
    out = rows.mapInArrow(write, f"id {kind}, n_pieces long, ids array<int>, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def slots(keys: np.ndarray) -> np.ndarray:
    """An open hash table of the positions of distinct 64-bit hashes, at most half full; -1 is empty."""
    size = 1 << max(4, int(2 * len(keys) - 1).bit_length())
    table = np.full(size, -1, np.int32)
    left, at = np.arange(len(keys), dtype=np.int32), keys & (size - 1)
    while len(left):
        free = table[at] < 0
        table[at[free]] = left[free]  # of several for one slot, one stays
        lost = table[at] != left
        left, at = left[lost], (at[lost] + 1) & (size - 1)
    return table


def lookup(table: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted hash among the keys, or -1."""
    at = wanted & (len(table) - 1)
    out = table[at]
    left = np.flatnonzero(out >= 0)
    left = left[keys[out[left]] != wanted[left]]
    while len(left):
        at[left] = (at[left] + 1) & (len(table) - 1)
        out[left] = table[at[left]]
        left = left[out[left] >= 0]
        left = left[keys[out[left]] != wanted[left]]
    return out


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices begin[i] .. begin[i] + count[i] - 1 of all i, end to end."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count)


def decoded(ids: np.ndarray, first: np.ndarray, table: np.ndarray, starts: np.ndarray, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts from their ids, and where each text's begin; the space put before a text goes. Ids that are no text are dropped."""
    ids = np.asarray(ids, np.int64)
    known = (ids >= 0) & (ids < len(starts) - 1)
    safe = np.where(known, ids, 0)
    begin, size = starts[safe], np.where(known, starts[np.minimum(safe + 1, len(starts) - 1)] - starts[safe], 0)
    out = table[_ragged(begin, size)]
    ends = np.concatenate([[0], np.cumsum(size)])[first]
    if prefix and len(out):
        lead = ends[:-1][(np.diff(ends) > 0)]
        drop = lead[out[lead] == 32]
        keep = np.ones(len(out), bool)
        keep[drop] = False
        ends = ends - np.searchsorted(drop, ends)
        out = out[keep]
    return out, ends


def decode(rows: DataFrame, model: PieceModel, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text of every row of ids; null ids give null, none an empty text."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model.decoder())
    prefix = model.prefix

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in batch.column(1).to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            data, ends = decoded(np.concatenate([np.zeros(0, np.int64), *lists]), first, *shared.value, prefix)
            raw = data.tobytes()
            text = [None if x is None else raw[a:b].decode("utf-8", "replace") for x, a, b in zip(batch.column(1).to_pylist(), ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["id", "text"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col).alias("id"), ids_col).mapInArrow(read, f"id {kind}, text string").withColumnRenamed("id", id_col)
