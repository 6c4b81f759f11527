"""Filter audit, target resampling and token files against plain loops, the library and exact round trips."""

import glob
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketweave.llm import rangecoder, resample, tokenfiles
from marketweave.llm.audit import document_flags, filter_audit
from marketweave.llm.resample import target_resample
from marketweave.llm.tokenfiles import WordTokenizer, read_token_files, write_token_files

DOCS = "doc_id long, text string, lang string, source string, part string, id string, state int, score double, n long"


def rows_of(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, [None, "en", "", "de"][k % 4], "s", "p", "x", 1, 0.5, 2) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeFGÉ") for _ in range(rng.randrange(1, 6)))
    made = [" ".join(word() for _ in range(rng.choice([1, 30, 210, 400]))) for _ in range(30)]
    made += ["a " * 300, "A" * 40, " ".join(f"w{i}" for i in range(250)) + " #", "\x85\xa0 x", "tab\tand\x0bmore\x0c" * 80, "1$", made[2], made[2], made[3].upper(), "", None, None, "é" * 50_000 + " B"]
    return made


def test_flags_and_audit(spark, texts):
    ids = [*range(len(texts) - 2), None, 0]
    rows = rows_of(texts, ids) + rows_of([texts[2]], [None]) + rows_of([texts[5]], [5])
    labels = [(i, i % 3 % 2, i % 5 == 0) for i in range(0, 40, 2)] + [(4, 1, False), (4, 0, True), (None, 1, True), (6, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = filter_audit(document_flags(docs, spark.createDataFrame([(a, b, None if c is None else int(c)) for a, b, c in labels], "doc_id long, quality int, toxic int")), list("ABCDE"), ["good_lost", "toxic_lost"])
    good = {a for a, b, _ in labels if a is not None and b == 1}
    toxic = {a for a, _, c in labels if a is not None and c}
    flags = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [j for j, o, *_ in rows if (o or "") == t and j is not None]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and min(same) < i}
        flags.append((lang or "", {f for f, v in fails.items() if v}, i in good, i in toxic))
    want, shapley = {}, {}
    for order in itertools.permutations("ABCDE"):
        for part in ("", "en", "de"):
            own = [r for r in flags if r[0] == part]
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = [r for r in own if f in r[1]]
                want[part, "".join(order), k + 1] = [len(left), len(gone), len(fails) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()}
    assert found == {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in want.items()} and len(found) == 3 * 600


def test_audit_general(spark):
    """Two filters, nulls, other columns; an empty table; too many filters."""
    df = spark.createDataFrame([("a", True, None, 1, 2), ("a", True, True, 1, 2), (None, False, True, 1, 2)], "part string, short boolean, rude boolean, step int, kept int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit(df, ["short", "rude"]).collect()}
    assert got["a", "shortrude", 1] == (0, 2, 0, 1, 3) and got["a", "shortrude", 2] == (0, 0, 1, 0, 1) and got["", "rudeshort", 1] == (0, 1, 0, 1, 2)
    assert filter_audit(df.limit(0), ["short", "rude"]).count() == 0
    with pytest.raises(ValueError):
        filter_audit(df, list("abcdefg"))
    empty = spark.createDataFrame([], DOCS)
    assert filter_audit(document_flags(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")), list("ABCDE")).count() == 0


def brute_resample(docs, target, percent, least):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    bag = lambda w: [zlib.crc32(f.encode()) % 10000 for f in [*w, *map(" ".join, itertools.pairwise(w))]]
    own, aim = [bag(words(t)) for _, t in docs], [b for t in target for b in bag(words(t))]
    s, t = np.bincount([b for x in own for b in x], minlength=10000), np.bincount(aim, minlength=10000) if aim else np.zeros(10000, int)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in range(10000)]
    out = []
    for (i, text), x in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("percent", [0, 25, 70, 100])
def test_target_resample(spark, texts, percent):
    texts = texts + ["A1b2 c3-d4_É " * 30, "x y " * 10] * 6
    ids = [*range(len(texts) - 8), None, None, 7, 7, 7, 7, 3, 3]  # repeated and null ids, equal rows, ties
    target = [t for t in texts[:9] if t] + [None, "a b a b"]
    docs = spark.createDataFrame(rows_of(texts, ids), DOCS).repartition(3)
    got = target_resample(docs, spark.createDataFrame([(0, t, "k") for t in target], "item_id long, text string, bucket string"), percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(list(zip(ids, texts)), target, percent, 20)


def test_target_resample_edges(spark, texts, monkeypatch):
    monkeypatch.setattr(resample, "BAND", 1)
    empty = spark.createDataFrame([], DOCS)
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    assert target_resample(empty, docs).count() == 0
    got = sorted((tuple(r) for r in target_resample(docs, empty).collect()), key=str)
    assert got == brute_resample(list(enumerate(texts)), [], 25, 20)
    assert target_resample(docs.limit(1), empty, width=3, buckets=7).count() == 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 6), st.integers(0, 2**32 - 1)), max_size=300), st.sampled_from([1, 7, 64]), st.sampled_from([1, 3, 50]))
def test_range_coder(ids, block, lanes):
    ids = np.array(ids, "<u4")
    blocks = rangecoder.encode(ids, block, lanes)
    assert len(blocks) == -(-len(ids) // block)
    assert rangecoder.decode(blocks, block, lanes).tolist() == ids.tolist()


def test_range_coder_blocks():
    """Repeated phrases take far fewer bits than 16, and fewer in longer blocks; blocks stand alone; damage is found."""
    rng = random.Random(1)
    phrases = [[rng.randrange(40_000) for _ in range(6)] for _ in range(200)]
    ids = np.array([i for _ in range(6000) for i in rng.choice(phrases)], "<u4")
    blocks = rangecoder.encode(ids, 4096)
    assert sum(map(len, blocks)) * 8 / len(ids) < 9 and sum(map(len, rangecoder.encode(ids, 65536))) * 8 / len(ids) < 4.5
    assert (rangecoder.decode(blocks[::-2], 4096) == np.concatenate([ids[k * 4096 : (k + 1) * 4096] for k in range(len(blocks))[::-2]])).all()
    for at in (0, 5, 9, 13, 20, len(blocks[0]) // 2, len(blocks[0]) - 9):
        bad = bytearray(blocks[0])
        bad[at] ^= 0x11
        with pytest.raises(ValueError):
            rangecoder.decode([bytes(bad)], 4096)
    with pytest.raises(ValueError):
        rangecoder.decode([blocks[0][:10]], 4096)


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


NASTY = ["", " ", "a", "Don't WE'LL  it's", "x y z\u0085w v", "<|endoftext|> a<|startoftext|>b", "é ́ a\n̸", "İSTANBUL ΣΣ straße", "12345 3.14!?#", "\x01", "a \x01 b\x01\x01c", "\x00\x1f\x1c\x1dx", "\U0001f600‍\U0001f680 中文", "가 ᆨ"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(NASTY)), max_size=6))
def test_words_give_the_ids_of_whole_texts(tokenizer_path, texts):
    import pyarrow as pa

    own = test_words_give_the_ids_of_whole_texts.__dict__.setdefault("own", WordTokenizer(tokenizer_path))
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    ids, counts = own.encode(pa.array([*texts, None], pa.string()), 2)
    want = [[*own.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in [*texts, ""]]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


ODD = ["Word, word. WORD! word", "<|endoftext|>, <|ENDOFTEXT|>. a<|endoftext|>b, <|x|>,", "don't, DON'T!' dogs' 'S x'LL, o'", "J\u030c, J\u030cx. A\u0301; a\u0338= x=\u0338 \u212a, \u0130. \u03a3\u03a3, \u01c5!", "a1, 1a. #A -- a-b- A_", "", "\x01, a"]


@pytest.mark.parametrize("kept", [0, 3, 1 << 18])
def test_words_part_into_keys(tokenizer_path, monkeypatch, kept):
    """Words that differ in case and closing punctuation are encoded once, as are those of earlier batches while there is room; ids are those of whole texts."""
    import pyarrow as pa

    monkeypatch.setattr(tokenfiles, "KEPT", kept)
    own, asked = WordTokenizer(tokenizer_path), []
    words = own.words
    monkeypatch.setattr(own, "words", lambda w: asked.append(sorted(w)) or words(w))
    for texts in (ODD[:1], ODD[:1], ODD, pa.array(["z, z", *ODD]).slice(1).to_pylist(), ODD[::-1]):
        ids, counts = own.encode(pa.array(["z, y", *texts], pa.string()).slice(1), 2)
        want = [[*own.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert set(asked[0]) == {"", "word", ",", ".", "!"}
    assert asked[1] == ([] if kept > 3 else asked[1]) and len(asked[1]) == max(0, 5 - kept)
    assert len(own.slots) <= kept


def test_token_files(spark, tmp_path, tokenizer_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfiles, "RECORDS", 2)
    texts = [*NASTY, None, "word " * 60_000, *[f"text {i} of many, {i * i}" for i in range(40)]]
    ids = [*range(len(texts) - 4), None, 7, 7, 3]
    docs = spark.createDataFrame(rows_of(texts, ids), DOCS).repartition(5)
    path = str(tmp_path / "tokens")
    write_token_files(docs, path, tokenizer_path, block=64, lanes=4)
    got = sorted(read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(tokenizer_path)
    want = sorted(((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in zip(ids, texts)), key=str)
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == want
    assert [(r.doc_id is not None, r.doc_id) for r in got] == sorted((r.doc_id is not None, r.doc_id) for r in got)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got[:-1])]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)
    first = max(glob.glob(f"{path}/part-*"), key=os.path.getsize)
    data = bytearray(open(first, "rb").read())
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        list(tokenfiles.unpack(bytes(data)))
    with pytest.raises(ValueError):
        list(tokenfiles.unpack(bytes(data[:-3])))


def test_token_files_of_nothing(spark, tmp_path, tokenizer_path):
    write_token_files(spark.createDataFrame([], DOCS), str(tmp_path / "none"), tokenizer_path)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_registered(spark):
    from marketweave.llm.queries import QUERIES, SQL

    for n in (11, 12, 13):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
    assert {"op11_filter_audit", "op12_target_resample"} <= set(SQL)
