"""Token ids of a corpus in binary files: tokenized, coded in blocks and written in ascending order of document ids, and read back.

Documents are dealt by ranges of (id, hash of text) and sorted inside a partition, so the files of all partitions, by partition and record, are the corpus in
order. A task tokenizes its texts and codes whole documents into records of many blocks (`rangecoder`); Spark's text writer puts the records as they are,
each followed by a line feed, so files commit with their tasks on any file system that Spark writes to. Readers walk the records of a file, check every
checksum, and find each record's place in the corpus by sums of the records before it.

Record format, little endian: magic "MWT1", partition u32, record u32, documents u32, ids per block at most u32, blocks u32, bytes of the
document table u32, bytes of all blocks u64, CRC-32 of this header and the table u32; the table (zlib: ids of documents i64, null marks u8, numbers of token ids u64); then for each block its length u32 and its bytes.
"""

from __future__ import annotations

import json
import os
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.llm import rangecoder
from marketweave.llm.bytehash import texts, trim
from marketweave.llm.common import drop, left_join, save, scratch_dir

RECORD = struct.Struct("<4sIIIIIIQI")
MAGIC = b"MWT1"
#: Bytes of text tokenized at a time; words of a string that the library gets at once; records of a file.
PIECE, WORDS, RECORDS = 1 << 24, 512, 8
#: The mark between words: a piece of its own, since white space stands around it.
MARK = "\x01"
#: Keys whose ids a Python worker keeps from task to task.
KEPT = 1 << 18
#: Pieces of the tokenizers whose words part after their last letter and whose ASCII letters may be lower-cased first.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokenizer:
    """Ids of whole texts by a tokenizer of the `tokenizers` library whose pieces never reach over white space.

    A text's ids are then those of its words end to end, so each distinct word of a batch is encoded once. Cut is at ASCII white space, around which neither normalisation (NFC has no
    composition with it) nor any piece extends. Where the tokenizer's pieces are PARTS, a word is further cut between an ASCII letter and the ASCII punctuation
    that ends the word, where a piece always ends; and if it lower-cases, words of ASCII alone are lower-cased here. What remains is far less often new, and ids of KEPT such keys stay for later batches.
    Words that may hold an added token go to the library as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each of Spark's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        spec = json.loads(self.tokenizer.to_str())
        steps = lambda x, inner: [] if not x else x[inner] if x["type"] == "Sequence" else [x]
        normal, cuts = steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")
        known = all(n["type"] in ("NFC", "Lowercase") or (n["type"], n.get("pattern"), n.get("content")) == ("Replace", {"Regex": r"\s+"}, " ") for n in normal)
        split = [c for c in cuts if c["type"] == "Split" and c["pattern"] == {"Regex": PARTS} and c["behavior"] == "Removed" and c["invert"]]
        level = [c for c in cuts if c["type"] == "ByteLevel" and not c["use_regex"] and not c["add_prefix_space"]]
        added = all(a["content"].startswith("<|") for a in spec["added_tokens"])
        self.cut = known and added and len(split) == len(level) == 1 and len(cuts) == 2 and cuts[0] is split[0]
        self.lower = self.cut and any(n["type"] == "Lowercase" for n in normal)
        self.slots: dict[str, int] = {}
        self.kept, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def keys(self, words: pa.Array) -> pa.Array:
        """Two keys for each word, whose ids end to end are the word's."""
        words = words.cast(pa.large_string())
        first, last = (np.frombuffer(words.buffers()[1], np.int64)[words.offset :][i : i + len(words)] for i in (0, 1))
        size = last - first
        if not size.any():
            return pa.array([""] * (2 * len(words)), pa.large_string())
        plain = np.zeros(len(words), bool)
        if self.cut:
            stem = np.asarray(pc.binary_length(pc.ascii_rtrim(words, characters=string.punctuation)))
            end = np.frombuffer(words.buffers()[2], np.uint8)[np.maximum(first + stem - 1, 0)] | 32
            plain = ~np.asarray(pc.match_substring(words, "<|"))
            size = np.where(plain & (stem > 0) & (end >= ord("a")) & (end <= ord("z")), stem, size)
        edges = np.append(np.stack([first, first + size], 1).ravel(), last[-1])
        keys = pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(edges), words.buffers()[2])
        if self.lower:
            low = np.repeat(plain & np.asarray(pc.string_is_ascii(words)), 2)
            keys = pc.if_else(pa.array(low), pc.ascii_lower(keys), keys)
        return keys

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and where each word's begin; `words` are distinct strings."""
        coded = self.keys(words).dictionary_encode()
        names = coded.dictionary.to_pylist()
        slot = np.fromiter((self.slots.get(k, -1) for k in names), np.int64, len(names))
        new = np.flatnonzero(slot < 0)
        ids, starts = self.words([names[i] for i in new])
        slot[new] = len(self.starts) - 1 + np.arange(len(new))
        kept, starts = np.concatenate([self.kept, ids]), np.concatenate([self.starts, self.starts[-1] + starts[1:]])
        room = min(len(new), KEPT - len(self.slots))
        if room > 0:
            self.slots.update((names[i], int(k)) for i, k in zip(new[:room], slot[new[:room]], strict=True))
            self.starts = starts[: len(self.starts) + room].copy()
            self.kept = kept[: self.starts[-1]].copy()
        use = slot[np.asarray(coded.indices)]
        length = np.diff(starts)[use]
        ends = np.concatenate([[0], np.cumsum(length)])
        return kept[np.arange(ends[-1]) + np.repeat(starts[use] - ends[:-1], length)], ends[::2]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and where each word's begin."""
        counts, found = [], []
        clean = len(self.mark) == 1 and not any(MARK in w for w in words)
        if clean:
            joined = [f" {MARK} ".join(words[i : i + WORDS]) for i in range(0, len(words), WORDS)]
            for k, e in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                cut = np.flatnonzero(ids == self.mark[0])
                edges = np.concatenate([[-1], cut, [len(ids)]])
                if len(edges) - 1 != len(words[k * WORDS : (k + 1) * WORDS]):
                    raise ValueError("the mark doesn't stand alone with this tokenizer")
                counts.append(np.diff(edges) - 1)
                found.append(np.delete(ids, cut))
        else:
            for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
                counts.append([len(e.ids)])
                found.append(np.array(e.ids, np.uint32))
        starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        return (np.concatenate(found) if found else np.zeros(0, np.uint32)), starts.astype(np.int64)

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with `end` after it, and the number of each text's. Null is an empty text."""
        lists = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
        offsets = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        ids, starts = self.distinct(coded.dictionary)
        last = len(starts) - 1  # the end mark is one word more
        ids, starts = np.append(ids, np.uint32(end)), np.append(starts, starts[-1] + 1)
        word = np.insert(np.asarray(coded.indices).astype(np.int64), offsets[1:] - offsets[0], last)
        length = np.diff(starts)[word]
        before = np.concatenate([[0], np.cumsum(length)])
        flat = ids[np.arange(before[-1]) + np.repeat(starts[word] - before[:-1], length)]
        return flat, np.diff(before[offsets - offsets[0] + np.arange(len(offsets))])


@lru_cache(maxsize=1)
def shared_tokenizer(path: str) -> WordTokenizer:
    """A Python worker's own, for all its tasks."""
    return WordTokenizer(path)


def pack(part: int, number: int, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, block: int) -> bytes:
    blocks = rangecoder.encode(ids, block)
    table = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + counts.astype("<u8").tobytes()
    table = zlib.compress(table, 6)
    body = b"".join(len(b).to_bytes(4, "little") + b for b in blocks)
    head = RECORD.pack(MAGIC, part, number, len(doc_ids), block, len(blocks), len(table), len(body), 0)[:-4]
    return head + zlib.crc32(table, zlib.crc32(head)).to_bytes(4, "little") + table + body


def unpack(data: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """part, record, ids of documents, number of token ids of each, token ids of each record of a file; ValueError where one is damaged."""
    at = 0
    while at < len(data):
        if at + RECORD.size > len(data):
            raise ValueError("a record is cut short")
        magic, part, number, docs, block, n_blocks, n_table, n_body, check = RECORD.unpack_from(data, at)
        head, table_at = data[at : at + RECORD.size - 4], at + RECORD.size
        table = data[table_at : table_at + n_table]
        if magic != MAGIC or zlib.crc32(table, zlib.crc32(head)) != check:
            raise ValueError("a record's header is damaged")
        at = table_at + n_table
        stop, blocks = at + n_body, []
        while at < stop:
            size = int.from_bytes(data[at : at + 4], "little")
            blocks.append(data[at + 4 : at + 4 + size])
            at += 4 + size
        if at != stop or len(blocks) != n_blocks or data[at : at + 1] != b"\n":
            raise ValueError("a record's blocks are damaged")
        at += 1
        table = zlib.decompress(table)
        doc_ids, null = np.frombuffer(table, "<i8", docs), np.frombuffer(table, "u1", docs, 8 * docs)
        counts = np.frombuffer(table, "<u8", docs, 9 * docs).astype(np.int64)
        ids = rangecoder.decode(blocks, block)
        if len(ids) != counts.sum():
            raise ValueError("a record's ids don't match its documents")
        yield part, number, [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)], counts, ids


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = rangecoder.BLOCK, lanes: int = rangecoder.LANES) -> None:
    """Token ids of all rows as files in `path`, in ascending order of id (nulls first; rows of one id by hash of text, then text).

    A null text is an empty one: the end id alone. An empty table gives a folder without records. Other columns are ignored. A record holds whole documents, lanes x block ids and
    the rest of the last one; what a task holds at a time is bounded by that, a piece of text and its longest document.
    """
    tokens_path = tokenizer_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        tokenizer, names, counts, held, size = shared_tokenizer(tokens_path), [], [], [], 0

        def record() -> pa.RecordBatch:
            packed = pack(part, number, names, np.concatenate(counts), np.concatenate(held), block)
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["record"])

        for b in texts(batches, PIECE):
            ids, n = tokenizer.encode(b.column(1).cast(pa.large_binary()).cast(pa.large_string()), end)
            names += b.column(0).to_pylist()
            counts.append(n)
            held.append(ids)
            size += len(ids)
            if size >= lanes * block:
                yield record()
                number, names, counts, held, size = number + 1, [], [], [], 0
        if names:
            yield record()
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first(), "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h", F.col("text").asc_nulls_first())
    records = rows.select("id", "text").mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.options(maxRecordsPerFile=RECORDS, lineSep="\n").text(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with_ids, the ids (array<long>) of every document of the files; damaged files raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for part, number, doc_ids, counts, ids in unpack(content.as_buffer().to_pybytes()):
                    ends = np.cumsum(counts)
                    starts = ends - counts
                    crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts, ends, strict=True)]
                    own = [pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())]
                    if with_ids:
                        own.append(pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64())))
                    place = [pa.array(np.full(len(counts), v, np.int32)) for v in (part, number)]
                    yield pa.RecordBatch.from_arrays([*place, *own], names=[f.name for f in kind.fields])
        trim()

    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

    kind = StructType().add("part", IntegerType()).add("record", IntegerType()).add("id", LongType()).add("own", LongType()).add("n_tokens", LongType()).add("ids_crc32", LongType())
    kind = kind.add("ids", ArrayType(LongType())) if with_ids else kind
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = save(files.mapInArrow(run, kind))
    # Records of a partition, then partitions: no window sees more than these, whatever the number of documents.
    sums = save(found.groupBy("part", "record").agg(F.sum("n_tokens").alias("n")))
    from pyspark.sql import Window

    above = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n")).select(F.col("part").alias("p"), above(Window.orderBy("part")).alias("ahead"))
    inside = sums.select("part", "record", above(Window.partitionBy("part").orderBy("record")).alias("before"))
    starts = inside.join(parts, F.col("part") == F.col("p")).select(F.struct("part", "record").alias("place"), (F.col("ahead") + F.col("before")).alias("first"))
    out = left_join(found.withColumn("place", F.struct("part", "record")), starts, "place")
    drop(sums)
    return out.select(F.col("id").alias(id_col), (F.col("first") + F.col("own")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_digest(docs: DataFrame, tokenizer_path: str, end: int = 2, **names: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, as read back from files written for it in the shared folder."""
    path = f"{scratch_dir(docs.sparkSession)}/mw-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path, end, **names)
    return read_token_files(docs.sparkSession, path, id_col=names.get("id_col", "doc_id"))
