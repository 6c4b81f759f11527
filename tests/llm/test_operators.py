"""The training-data operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweave.llm import bytehash, embeddings, exact, substrings
from marketweave.llm.components import components
from marketweave.llm.exact import DigestIndex, exact_dedup
from marketweave.llm.langmix import language_id
from marketweave.llm.minhash import near_dedup
from marketweave.llm.mixing import pareto_mix, source_targets
from marketweave.llm import langmix, toxicity as toxic_
from marketweave.llm import quality as quality_
from marketweave.llm.quality import grade, quality, train
from marketweave.llm.toxicity import toxicity
from marketweave.llm.wrappers import expression, extract_html, infer, read

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, size int, id string, u double"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    base = " ".join(words(120, 1))
    near = base.split()
    near[60] = "changed"
    far = base.split()
    for i in range(0, 120, 6):
        far[i] = f"other{i}"
    return [base, base.upper(), " ".join(near), " ".join(far), None, "", "  \t\n", "one", "One", "one two", " ".join(words(90, 2)), " ".join(words(5000, 3)), "x\x85y é\xa0z", base]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", None][i % 2], [None, "a", "b"][i % 3], None, "d", 1, "x", 0.5) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], "en", "a", 1, "d", 1, "x", 0.5), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def test_word_hashes(texts):
    import pyarrow as pa

    old = bytehash.PIECE
    try:
        for piece in (old, 64):
            bytehash.PIECE = piece
            h, first = bytehash.word_hashes(*bytehash.utf8(pa.array(texts, pa.string())))
            flat = [w for t in texts for w in split(t)]
            assert list(np.diff(first)) == [len(split(t)) for t in texts]
            assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    finally:
        bytehash.PIECE = old


@pytest.mark.parametrize(("collide", "sent"), [(False, 10), (True, 10), (False, 0), (True, 0)])
def test_exact_dedup(docs, collide, sent, monkeypatch):
    monkeypatch.setattr(exact, "HITS_SENT", sent)
    kw = {"digest": lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 0)} if collide else {}
    got = exact_dedup(docs, **kw).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_digest_index(spark):
    """Five batches one after the other against a dictionary: hits, levels, sorted runs, the smallest id and the number of entries."""
    rng = random.Random(5)
    index, held = DigestIndex("min"), {}
    for k in range(5):
        rows = [(bytes([rng.randrange(60 + 30 * k)]) * 32, rng.randrange(1000)) for _ in range(40)]
        got = sorted(bytes(r.digest) for r in index.add(spark.createDataFrame(rows, "digest binary, id long")).collect())
        digests = [d for d, _ in rows]
        assert got == sorted(d for d in set(digests) if d in held or digests.count(d) > 1)
        for d, i in rows:
            held.setdefault(d, []).append(i)
        assert [len(level) for level in index.levels] == [int(x) for x in reversed(f"{k + 1:b}")]
    asked = spark.createDataFrame([(bytes([b]) * 32,) for b in range(256)], "digest binary")
    assert {bytes(r.digest) for r in index.lookup(asked).collect()} == set(held)
    for run in index.runs:
        for part in run["rows"].select("digest", F.input_file_name().alias("f")).toPandas().groupby("f"):
            values = [bytes(d) for d in part[1].digest]
            assert values == sorted(values)
    assert {bytes(r.digest): (r.id, r.n) for r in index.compact().collect()} == {d: (min(i), len(i)) for d, i in held.items()} and len(index.runs) == 1


def test_index_of_few_rows_stays_in_one_task(spark, docs, monkeypatch):
    """No table that the index writes is dealt out, whatever the partitions of its batches; dealt out, results are the same."""
    from marketweave.llm import common

    wrote, save = [], exact.save
    monkeypatch.setattr(exact, "save", lambda df, **options: wrote.append(df.rdd.getNumPartitions()) or save(df, **options))
    index = DigestIndex()
    rows = [(bytes([i % 50]) * 32, i) for i in range(120)]
    parts = [spark.createDataFrame(rows[k::3], "digest binary, id long").repartition(5) for k in range(3)]
    hits = [sorted(bytes(r.digest) for r in index.add(p).collect()) for p in parts]
    held = sorted((bytes(r.digest), r.id, r.n) for r in index.compact().collect())
    assert set(wrote) == {1}
    got = sorted(map(repr, exact_dedup(docs).collect()))
    monkeypatch.setattr(common, "TASK_ROWS", 0)
    index = DigestIndex()
    assert hits == [sorted(bytes(r.digest) for r in index.add(p).collect()) for p in parts]
    assert held == sorted((bytes(r.digest), r.id, r.n) for r in index.compact().collect())
    assert got == sorted(map(repr, exact_dedup(docs).collect()))


def test_save_collects_the_heap_at_times(spark, monkeypatch):
    from marketweave.llm import common

    calls = []
    monkeypatch.setattr(common, "release", lambda session, rounds=3: calls.append(rounds))
    monkeypatch.setattr(common, "_collected", common.time.monotonic())
    common.drop(common.save(spark.range(3)))
    assert not calls
    monkeypatch.setattr(common, "_collected", common.time.monotonic() - common.COLLECT_S - 1)
    common.drop(common.save(spark.range(3)))
    assert calls == [1]


def test_exact_dedup_edges(spark):
    schema = "doc_id long, text string, norm string, digest int, batch int"
    assert exact_dedup(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "A"), (None, "a"), (None, "b"), (7, "b"), (7, "b"), (3, "B")]
    df = spark.createDataFrame([(i, t, "x", 1, 9) for i, t in rows], schema)
    for kw in ({}, {"digest": lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 0)}):
        got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df, **kw).collect()), key=repr)
        assert got == sorted([(None, None, 2, True)] * 2 + [(None, 7, 4, False), (7, 7, 4, True), (7, 7, 4, True), (3, 7, 4, False)], key=repr)


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: min(y for y in parent if find(y) == find(x)) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links(spark, monkeypatch):
    """Few links stay in one task and make a table a round; dealt out over all partitions they have the same components."""
    from marketweave.llm import components as module

    edges = [(i, i + 1) for i in range(1, 40)] + [(100, b) for b in range(101, 140)] + [(7, 7), (None, 3), (60, 50), (50, 60)]
    links = spark.createDataFrame(edges, "a long, b long")
    wrote, save = [], module.save
    monkeypatch.setattr(module, "save", lambda df, **options: wrote.append(df.rdd.getNumPartitions()) or save(df, **options))
    got = {r.id: r.component_id for r in components(links).collect()}
    assert set(wrote) == {1}
    assert len(wrote) < 10
    monkeypatch.setattr(module, "TASK_EDGES", 0, raising=False)
    assert got == {r.id: r.component_id for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)} | {50: 50, 60: 50}


@pytest.mark.parametrize("width", [4, 5])
def test_near_dedup(spark, docs, texts, width):
    rng = random.Random(4)
    extra = []
    base = words(60, 9)
    for k in range(60):  # a family of near copies with more and fewer edits
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        extra.append((100 + k, " ".join(copy)))
    rows = docs.select("doc_id", "text", "size").unionByName(spark.createDataFrame([(i, t, 1) for i, t in extra], "doc_id long, text string, size int"))
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup(rows, width=width).collect()}

    def shingles(t):
        w = split(t)
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = {i: shingles(t) for i, t in [*enumerate(texts), *extra]}
    comp = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(comp)
        for a, b in itertools.combinations(sets, 2):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    for i, s in sets.items():
        assert got[(i, len(s))] == (comp[i], comp[i] == i), i
    assert got[(None, 0)] == (None, True)
    assert near_dedup(rows.limit(0)).count() == 0


def test_near_dedup_repeated_ids(spark):
    """An id with two texts has the links of both; many pairs with one text; columns with names used inside."""
    a, b, c = (" ".join(words(100, s)) for s in (21, 22, 23))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, c), (5, c + " y"), (5, "alone"), (6, "alone"), (6, None), (7, b)]
    near = " ".join(words(200, 24))
    rows += [(1000 + k, f"{near} tail{k}") for k in range(700)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, digest int, node string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dedup(df).collect()}
    assert {k: v for k, v in got.items() if k[0] < 1000} == {(1, 96): 1, (2, 97): 1, (3, 97): 1, (7, 96): 1, (4, 96): 4, (5, 97): 4, (5, 1): 4, (6, 1): 4, (6, 0): 6}
    assert {v for k, v in got.items() if k[0] >= 1000} == {1000}


def test_mixing(spark, docs):
    got = pareto_mix(docs).collect()
    again = pareto_mix(docs.repartition(5)).collect()
    key = lambda r: repr((r.doc_id, r.size, r.source_size, r.target, r.taken))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == docs.count()
    assert all(r.size == 0 and r.taken == 0 or r.taken % r.size == 0 and r.taken <= 2 * r.size for r in got)
    rows = [(i, f"s{i % 3}", " ".join(["w"] * (1 + i * 7 % 40)), 1.0 + i % 4) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, weight double")
    for importance in (None, "weight"):
        out = pareto_mix(df, importance_col=importance, seed=5).toPandas()
        out["source"] = [f"s{i % 3}" for i in out.doc_id]
        for _, g in out.groupby("source"):
            assert abs(g.taken.sum() - g.target.iloc[0]) <= 20
    # Odds: rows of weight 4 are taken more often than those of weight 1.
    taken = out[out.target < out.source_size].assign(w=1 + out.doc_id % 4)
    rate = taken.assign(t=taken.taken > 0).groupby("w").t.mean()
    assert rate[4] > rate[1]
    assert pareto_mix(df.limit(0)).count() == 0
    clash = [F.lit("c").alias(c) for c in ("q", "b1", "odds", "factor", "words", "classes", "copies")]
    assert sorted(map(tuple, pareto_mix(df.select("*", *clash)).collect())) == sorted(map(tuple, pareto_mix(df).collect()))
    hot = spark.range(400).select(F.lit(1).alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"))
    assert len({r.taken for r in pareto_mix(hot).collect()}) == 1


def test_mixing_inclusion(spark):
    """Inclusion frequencies over 600 sources with the same sizes (each source is a draw of its own) against the probabilities."""
    sizes = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233] * 4
    rows = [(s * 100 + k, f"s{s:04d}", " ".join(["w"] * n)) for s in range(600) for k, n in enumerate(sizes)]
    out = pareto_mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(8)).toPandas()
    out["turn"] = (out.doc_id // 100) % 3
    seen = 0
    for _, g in out.groupby("turn"):
        e = g.target.iloc[0] / sum(sizes)
        if abs(e - round(e)) < 1e-9:
            assert (g.copies == round(e)).all()
            continue
        x = np.array([2.0 ** ((int(n).bit_length() - 1) // 2) for n in sizes])
        lo, hi = 0.0, 1e6
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (np.array(sizes) * mid * x / (1 + mid * x)).sum() < (e % 1) * sum(sizes) else (lo, mid)
        p = lo * x / (1 + lo * x)
        got = g.assign(extra=g.copies - int(e)).groupby("size").extra.mean()
        for n, want in sorted(set(zip(sizes, p.tolist()))):
            assert got[n] == pytest.approx(want, abs=0.06), (n, want)
        assert len(set(p)) > 3 and p.max() - p.min() > 0.2
        seen += 1
    assert seen


def test_targets(spark):
    sizes = {"b": 100, "a": 1000, None: 50, "c": 10, "é": 1000}
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted(n for n in sizes if n is not None) + [None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(2 * sizes[n] for n in names if n not in open_)
        target = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if target[n] > 2 * sizes[n]}
        if not over:
            break
        open_ -= over
    for n in names:
        assert got[n] == pytest.approx(target.get(n, 2 * sizes[n]))


def test_interval_classes():
    rng = random.Random(1)
    for length in (3, 5):
        segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(length, 12))) for _ in range(40)]
        size = np.array([len(s) for s in segments])
        rows = substrings._rows(np.frombuffer(b"".join(segments), np.uint8), np.cumsum(size) - size, size, 16)
        got, want = {}, {}
        for r, o, c in zip(*substrings.interval_classes(rows, size, length)):
            got.setdefault(int(c), set()).add((int(r), int(o)))
        for i, s in enumerate(segments):
            for j in range(len(s) - length + 1):
                want.setdefault(s[j : j + length], set()).add((i, j))
        assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


def test_remove_repeats(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdé ") for _ in range(130))
    rows = []
    for i in range(40):
        t = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 300)))
        if i % 3 == 0:
            cut = rng.randrange(0, 40)
            t = t[:50] + passage[cut : cut + rng.randrange(50, 130)] + t[50:]
        rows.append((i * 2, t))
    rows += [(1, rows[3][1]), (200, rows[3][1]), (201, None), (202, ""), (203, "z" * 400), (204, "z" * 120), (None, rows[3][1]), (300, rows[6][1]), (300, rows[6][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df).collect())
    first, want = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49) if i is not None else ():
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i if i is not None else -1, len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_embeddings(spark, caplog):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(260, 24))
    x[100:140] = x[100] + rng.normal(size=(40, 24)) * 0.12
    x[200] = x[201]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(None, [1.0] * 24, 1), (906, [0.0, None] * 12, 1), (907, [float("inf")] * 24, 1), (908, [1e200, 1e-200], 1), (909, [1e300, 0.0], 1), (5, [float(v) for v in x[5]], 0), (900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None] * 24, 1), (904, [], 1), (905, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    df = df.select("*", F.lit(1).alias("id"), F.lit("x").alias("unit"), F.lit(2).alias("rep"))
    with caplog.at_level("INFO", logger=embeddings.__name__):
        out = embeddings.embedding_dedup(df, k=12, rounds=5).collect()
    assert float(caplog.messages[-1].split("recall ")[1].split(")")[0]) >= 0.9
    assert [(r.n_links, r.component_id, r.kept) for r in out if r.vec_id is None] == [(0, None, True)] and sum(r.vec_id == 5 for r in out) == 2
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert got[908] == (1, 908) and got[909] == (1, 908) and got[906] == (0, 906) and got[907] == (0, 907)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    comp = np.arange(260)
    for _ in range(260):
        new = np.array([min([comp[i], *comp[np.flatnonzero(hit[i])]]) for i in range(260)])
        if (new == comp).all():
            break
        comp = new
    for i in range(260):
        assert got[i] == (hit[i].sum(), comp[i])
    assert all(got[i] == (0, i) for i in range(900, 906))
    assert embeddings.embedding_dedup(df.limit(0)).count() == 0


def test_embeddings_dense_groups(spark):
    """Two linked groups whose members all have more nearer neighbours inside than a list holds."""
    rng = np.random.default_rng(5)
    centre = np.eye(200)[0], np.eye(200)[0] * 0.922 + np.eye(200)[1] * (1 - 0.922**2) ** 0.5
    x = np.concatenate([c + rng.normal(size=(80, 200)) * (0.022 / 200) ** 0.5 for c in centre])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    hit = sim >= 0.9
    np.fill_diagonal(hit, False)
    assert sim[:80, :80].min() > sim[:80, 80:].max() and hit[:80, 80:].mean() > 0.2
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_dedup(df, k=2, rounds=2).collect()}
    assert got == {i: (hit[i].sum(), 0) for i in range(160)}


def test_language_id(spark):
    vocab = {"en": ["the", "house", "water", "with", "this"], "de": ["das", "haus", "wasser", "nicht", "über"], "fr": ["la", "maison", "avec", "été", "leau"]}
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(vocab[l], k=40)), l) for i in range(240) for l in [list(vocab)[i % 3]]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 456 !!", "en"), (1003, rows[0][1] * 500, None), (1004, " ".join(rng.choices(vocab["en"], k=60) + rng.choices(vocab["de"], k=40)), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id(df).collect()}
    assert sum(got[i].lang_pred == l for i, _, l in rows[:240]) >= 238
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "en" and 0 <= got[1003].score <= 1
    assert set(got[1004].mix) == {"en", "de"} and 0.45 < got[1004].mix["en"] < 0.75
    assert {r.lang_pred for r in language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixture_against_loops():
    """Expectation-maximisation with penalised sets against plain loops over trigrams and languages."""
    rng = np.random.default_rng(0)
    table = rng.dirichlet(np.full(langmix.BUCKETS, 0.02), 3).T + 1e-9
    for share in ([1, 0, 0], [0.5, 0.5, 0], [0.2, 0.2, 0.6]):
        grams = np.concatenate([rng.choice(langmix.BUCKETS, int(400 * s), p=table[:, k] / table[:, k].sum()) for k, s in enumerate(share)])
        got = langmix.mixture(grams, table)

        def em(langs, pi):
            for _ in range(20):
                new = {k: 0.0 for k in langs}
                for g in grams.tolist():
                    total = sum(pi[k] * table[g, k] for k in langs)
                    for k in langs:
                        new[k] += pi[k] * table[g, k] / total / len(grams)
                done = max(abs(new[k] - pi[k]) for k in langs) < 1e-4
                pi = new
                if done:
                    break
            return pi, sum(np.log(sum(pi[k] * table[g, k] for k in langs)) for g in grams.tolist())

        langs = [0, 1, 2]
        pi, like = em(langs, dict.fromkeys(langs, 1 / 3))
        while len(langs) > 1:
            rest = [k for k in langs if k != min(langs, key=lambda k: pi[k])]
            z = sum(pi[k] + 1e-3 for k in rest)
            fewer, less = em(rest, {k: (pi[k] + 1e-3) / z for k in rest})
            if langmix.EVIDENCE * (like - less) > 0.5 * np.log(len(grams)):
                break
            langs, pi, like = rest, fewer, less
        assert {k: got[k] for k in range(3) if got[k]} == pytest.approx(pi, abs=1e-6) and set(langs) == {k for k, s in enumerate(share) if s}


def test_toxicity(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        w, bad = [f"w{rng.randrange(300)}" for _ in range(50)], int(i % 5 == 0)
        for _ in range(4 * bad):
            w[rng.randrange(50)] = rng.choice(["vilex", "vilez!", "Vilest,"])
        rows.append((i, " ".join(w), "en"))
        labels.append((i, bad))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "...", "en"), (None, "vilex vilex", "en")]
    labels += [(1000, 1), (None, 1), (3, None)]
    rows += [(5, rows[5][1], "en"), (1003, "filler " * 300_000 + "vilex vilez vilest", "en")]
    labels.append((1003, 1))
    clash = [F.lit(1).alias(c) for c in ("_id", "_y", "h", "id", "y", "row", "score")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *clash), spark.createDataFrame(labels, "doc_id long, toxic int").select("*", *clash)
    out = toxicity(docs, labels, carry=docs.columns).collect()
    truth = {i: int(i % 5 == 0) for i in range(400)}
    held = [r for r in out if r.held_out]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.row.doc_id == r.doc_id for r in out) and len(out) == 406
    assert len({r.score for r in out if r.doc_id == 5}) == 1 and [r.predicted for r in out if r.doc_id == 1003] == [1]
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_against_loops():
    """The sliced network against plain loops over words, filters and widths."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["bad", "Good,", "(odd)", "..", "x", "end."]) for _ in range(n)) for n in (0, 1, 2, 5, 40, 700)]
    rows = [(toxic_.encoded(f"{'bad' if i % 3 == 0 else 'fine'} word {i} {rng.choice(['x', 'y'])}".encode()), int(i % 3 == 0), "en") for i in range(90)]
    m = toxic_.train(rows, epochs=2)
    old, toxic_.SLICE = toxic_.SLICE, 64
    try:
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        w, f, first = toxic_.tokens(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        got = m.raw(w, f, first)
        best, spots = m.pooled(w, f, first, where=True)
    finally:
        toxic_.SLICE = old
    for t in range(len(texts)):
        own = range(first[t], first[t + 1])
        assert len(own) == sum(any(c not in ".,()" for c in x) for x in texts[t].split())
        total = m.out_bias
        for j, k in enumerate(toxic_.WIDTHS):
            for c in range(toxic_.FILTERS):
                values = [sum(float(m.conv[j][i * toxic_.DIM + d, c]) * float(m.word[w[p + i], d] + m.front[f[p + i], d]) for i in range(k) if p + i < first[t + 1] for d in range(toxic_.DIM)) for p in own]
                top = (max(values) if values else 0.0) + float(m.bias[j][c])
                assert best[t, j * toxic_.FILTERS + c] == pytest.approx(top, abs=1e-4)
                assert not values or values[spots[j][t, c] - first[t]] == pytest.approx(max(values), abs=1e-4)
                total += max(top, 0.0) * float(m.out[j * toxic_.FILTERS + c])
        assert got[t] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-4)


def test_quality(spark):
    rng = random.Random(0)
    rows = []
    for i in range(600):
        g = i % 3
        t = " ".join(f"w{rng.randrange(200)}" for _ in range(40))
        rows.append((i, t.upper().replace(" ", "!! ") if g == 0 else t + " vile vile vile" if g == 1 else t, g))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "a"), (0, rows[0][1]), (1002, "w1 w2 " * 300_000)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows] + [(1000, None), (1002, 2)], "doc_id long, grade int")
    clash = [F.lit("c").alias(c) for c in ("_id", "_y", "h", "id", "y", "row", "kept", "body")]
    docs, ratings = docs.select("*", *clash), ratings.select("*", *clash)
    found = quality(docs, ratings).collect()
    out = {r.doc_id: r for r in found}
    assert len(found) == 605 and len({r.score for r in found if r.doc_id == 0}) == 1 and quality(docs.limit(0), ratings).count() == 0
    held = [i for i, _, _ in rows if out[i].held_out]
    assert np.corrcoef([out[i].expected_grade for i in held], [i % 3 for i in held])[0, 1] > 0.9
    assert sum(out[i].kept == (i % 3 > 0) for i in held) / len(held) > 0.95
    assert all(0 <= r.top <= r.score <= 1 for r in out.values())
    assert {r.score for r in quality(docs, ratings.limit(0)).collect()} == {1.0}
    model = train([(quality_.encoded(t.encode()), g) for _, t, g in rows[:200]], 3)
    assert (np.diff(model.thresholds) > 0).all()
    row = spark.range(1).select(grade(F.lit(0), F.lit(1)).alias("a"), grade(F.lit(1), F.lit(1)).alias("b"), grade(F.lit(1), F.lit(0)).alias("c"), grade(F.lit(None), F.lit(0)).alias("d")).first()
    assert list(row) == [0, 1, 2, None]


def test_quality_against_loops():
    """Features in slices against counts of one text, and tail probabilities against the formula."""
    texts = ["", "a", "One one, two  (two)!", "x " * 300 + "é\n" * 50, "Same same SAME 12 34"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    old, bytehash.PIECE = bytehash.PIECE, 64
    try:
        text, feature, value = quality_.features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    finally:
        bytehash.PIECE = old
    for i, t in enumerate(raw):
        own = dict(zip(feature[text == i].tolist(), value[text == i].tolist()))
        n = len(re.findall(rb"[^\x20\x09-\x0D]+", t))
        words, pairs, seen, shape = ([v for k, v in own.items() if lo <= k < hi] for lo, hi in ((0, 1 << 15), (1 << 15, 2 << 15), (2 << 15, 3 << 15), (3 << 15, 4 << 15)))
        assert sum(v * v for v in words) == pytest.approx(float(n > 0)) and sum(v * v for v in pairs) == pytest.approx(max(0, len(t) - 1) / max(1, len(t)))
        assert len(words) == len({w.lower() for w in t.split()}) and len(pairs) == len({t[k : k + 2] for k in range(len(t) - 1)})
        assert len(seen) == len({w.strip(b"(),.!").lower() for w in t.split()}) and set(seen) <= {1.0} and shape == [0.5] * 4
        alone = np.frombuffer(t, np.uint8), np.array([0, len(t)])
        _, f1, v1 = quality_.features(*alone)
        assert own == pytest.approx(dict(zip(f1.tolist(), v1.tolist())))
        m = quality_.OrdinalModel(np.sin(np.arange(quality_.FEATURES)), np.array([-0.5, 0.25]))
        s = sum(np.sin(k) * v for k, v in own.items())
        assert m.tails(*alone)[0] == pytest.approx([1 / (1 + np.exp(-s - 0.5)), 1 / (1 + np.exp(0.25 - s))])


PAGE = (
    '<!DOCTYPE html><html><head><title>T{i}</title><script>if (a < b) "<p>no</p>"</script></head><body><header class="site"><a href="/">Home</a></header><nav><ul>{links}</ul></nav>'
    '<div class="sidebar"><p>side {i}</p></div><article><h1>Title &amp; {i}</h1><p>First <b>para\n  {i}</b>&nbsp;x.<p>Second {i}{extra}<aside>ad</aside></article>'
    '<section class="comments"><p>nice {i}</p></section><form><button>go</button></form><!-- c --><footer>&copy; x</footer></body></html>')


def test_wrappers(spark):
    pages = [PAGE.format(i=i, links="<li><a href=a>l</a></li>" * (2 + i % 3), extra="<ul><li>item one</li><li>item two</li></ul>" if i % 2 else "") for i in range(8)]
    wrapper = infer(pages)
    assert "(<li><a>#CONSTANT</a></li>)+" in expression(wrapper) and ")?" in expression(wrapper)
    want = lambda i: f"Title & {i}\n\nFirst para {i} x.\n\nSecond {i}" + ("\n\nitem one\n\nitem two" if i % 2 else "")
    assert [read(p, wrapper) for p in pages] == [want(i) for i in range(8)]
    deep = "<div>" * 3000 + "<nav>menu</nav>" + "<article>" + "<section>" * 500 + "deep<nav>" + "<i>" * 200 + "menu</nav></article>"
    rows = [(i, f"http://h.example.com/{i}", p) for i, p in enumerate(pages)] + [(100, None, None), (101, "x", ""), (102, "http://h.example.com/o", "<div><p>only &lt;this&gt;</div><p"), (103, "http://deep.example.com", deep)]
    rows += [(None, "http://h.example.com/0", pages[0]), (0, "http://h.example.com/0", pages[0]), (104, "http://long.example.com", "<article>" + "<p>word &amp; word</p>" * 30000 + "</article>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, wrapper int")
    out = extract_html(df.repartition(3)).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == len(rows) and all(got[i].text == want(i) and got[i].n_chars == len(want(i)) for i in range(8))
    assert got[None].text == want(0) and sum(r.page_id == 0 for r in out) == 2
    assert got[100].text == got[101].text == "" and got[102].text == "only <this>" and got[103].text == "deep"
    assert got[104].text == "\n\n".join(["word & word"] * 30000)
    assert extract_html(df.limit(0)).count() == 0


def test_wrapper_beats_one_page():
    """Boilerplate without telling tags: only pages side by side show which texts belong to the site."""
    site = '<div><div>Site of many things and more</div><div>{m}</div><div><h2>T{i}</h2>{body}</div><div>The imprint is the same long text on each page of this site, longer than some articles, and says so often.</div></div>'
    menu = "<span>Home</span><span>News of the day</span><span>All about us</span>"
    bodies = [["The same first sentence on all pages."] + [f"text {i} {k}" for k in range(1 + i % 3)] for i in range(9)]
    pages = [site.format(i=i, m=menu, body="".join(f"<p>{x}</p>" for x in b)) for i, b in enumerate(bodies)]
    wrapper = infer(pages)
    want = ["\n\n".join([f"T{i}", *b]) for i, b in enumerate(bodies)]
    assert [read(p, wrapper) for p in pages] == want
    assert read(pages[0], infer(pages[:1])) != want[0]
    # A rare template of the same host, whose prose is where the others have nothing.
    rare = '<div class="other"><section><p>rare words of an own template</p><p>and a second line</p></section></div><div>The imprint</div>'
    assert read(rare, infer([*pages, rare])) == "rare words of an own template\n\nand a second line"


def test_wrapper_keeps_all_of_the_article():
    """Lists of links, telling class words and repeated sentences stay when they are in the article; named parts outside it or small in it go."""
    body = '<h1>T{0}</h1><p class="share price">price {0}</p><p class="side-by-side">both {0}</p><div class="comment-free">free {0}</div><p class="cookie-recipe">bake {0}</p><p>same</p><ul><li><a href=x>link {0}</a></li><li><a href=y>same link</a></li></ul><div class="ad">buy</div><p>long text of page {0}</p>'
    want = "T{0}|price {0}|both {0}|free {0}|bake {0}|same|link {0}|same link|long text of page {0}"
    for tag in ("article", "div"):
        pages = [f"<nav>m</nav><{tag}>{body.format(i)}</{tag}><div class=comments><p>me too {i}</p></div>" for i in range(6)]
        wrapper = infer(pages)
        assert [read(p, wrapper) for p in pages] == [want.format(i).replace("|", "\n\n") for i in range(6)]
    noticed = [f"<div class=notice><p>a whole article number {i} under a telling name</p><p>goes on</p></div><div>x</div>" for i in range(5)]
    assert read(noticed[1], infer(noticed)) == "a whole article number 1 under a telling name\n\ngoes on"

def test_near_dedup_empty_row_of_a_linked_id(spark):
    """An id's row without words neither hides its set nor takes its component, whether or not other ids have several sets."""
    a = " ".join(words(100, 31))
    rows = [(1, a)] + [(2, t) for t in (None, "", " \t", a + " z")] + [(3, a + " y"), (4, None)]
    rows += [(2, None)] * 40
    for more in ([], [(8, "one text"), (8, "another text")]):
        df = spark.createDataFrame(rows + more, "doc_id long, text string").repartition(5)
        got = sorted({(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup(df).collect() if r.doc_id < 8})
        assert got == [(1, 96, 1, True), (2, 0, 2, True), (2, 97, 1, False), (3, 97, 1, False), (4, 0, 4, True)]


def test_remove_repeats_edges(spark):
    """Clashing columns, a long text that repeats itself and others, a passage common to texts of many partitions."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefé ") for _ in range(90))
    long = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    rows = [(0, long), (1, long + long), (2, long[7:30_000] + "#" + long[100:40_000])] + [(10 + i, f"<{i}>{passage}<{i}>") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("uid", "id", "body", "keys", "lo", "hi", "part", "n")]).repartition(6)
    got = {r.doc_id: r for r in substrings.remove_repeats(df).collect()}
    assert (got[0].n_removed, got[0].n_spans) == (0, 0) and bytes(got[0].kept) == long.encode()
    # Windows over the seam of a doubled text start in no other document.
    assert got[1].n_removed == 2 * len(long) and bytes(got[1].kept) == b""
    assert got[2].n_spans == 2 and bytes(got[2].kept) == b"#"
    size = len(passage.encode())
    assert got[10].n_removed == 0 and all(got[10 + i].n_removed >= size and got[10 + i].n_spans == 1 for i in range(1, 300))


def test_language_id_edges(spark):
    rows = [(i, "the house with water " * 3, "en") for i in range(20)] + [(20 + i, "das haus nicht über wasser " * 3, "de") for i in range(20)]
    rows += [(None, "the house with water", "en"), (3, rows[3][1], "en"), (41, "the water with this house " * 60_000, None)]
    clash = [F.lit("x").alias(c) for c in ("held_out", "lang_pred", "score", "mix", "_body", "_lettered", "counts", "n", "body")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *clash).repartition(3)
    found = language_id(df).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and sum(r.doc_id == 3 for r in found) == 2 and got[None].lang_pred == "en" and not got[None].held_out
    assert got[41].lang_pred == "en" and got[25].lang_pred == "de"
    assert language_id(df.limit(0)).count() == 0
