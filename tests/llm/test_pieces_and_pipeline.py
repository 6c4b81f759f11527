"""SentencePiece against its library and a brute-force Viterbi; the pipeline on a small corpus."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from marketweave.llm.pieces import PieceModel, decode, encode, fold_bpe, fold_viterbi, lattice, load_model, merge_long
from marketweave.llm.queries import tokenizer_path

TEXTS = ["Hello  world\nthis is élève 漢字 \U0001f600 123", "", None, " ", "   lead", "trail  ", "tab\there", "x" * 300 + " the " + "ab" * 200, "the the The THE", "-" * 100, "a"]


@pytest.fixture(scope="module")
def model():
    try:
        return load_model(tokenizer_path())
    except ImportError:
        pytest.skip("no tokenizer files")


@pytest.mark.parametrize("hot", [0, 5, 1 << 20])
def test_ids_equal_the_library(spark, model, hot):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x")], "doc_id long, text string, h string")
    out = encode(docs, model, hot=hot)
    got = out.collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert r.ids == library.encode(TEXTS[r.doc_id] or "") and r.n_pieces == len(r.ids) and r.round_trip
    back = {r.doc_id: r.text for r in decode(out, model).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    marked = encode(spark.createDataFrame([(1, "a▁b")], "doc_id long, text string"), model).first()
    assert marked.ids == library.encode("a▁b") and not marked.round_trip
    assert encode(docs.limit(0), model).count() == 0


def test_long_units_merge_alike(spark, model):
    vocabulary = {p: (s, i) for p, i, s in model.pieces}
    unit = "▁thenthereforehereafter"
    words = spark.createDataFrame([(1, unit)], "h long, unit string")
    kept = fold_bpe(lattice(words, model.table(spark), model.longest, scores=False)).first()["kept"]
    assert sorted((e["start"], e["start"] + e["len"]) for e in kept) == merge_long(unit, vocabulary)


def test_viterbi(spark):
    pieces = [("a", 0, -1.0), ("b", 1, -1.2), ("ab", 2, -1.5), ("aba", 3, -2.6), ("ba", 4, -1.4)]
    toy = PieceModel("unigram", pieces, [], 9, False)
    units = ["ababa", "abba", "b", "aac"]
    kept = {r.h: r.kept for r in fold_viterbi(lattice(spark.createDataFrame(list(enumerate(units)), "h long, unit string"), toy.table(spark), toy.longest), -20.0).collect()}
    score = {p: s for p, _, s in pieces}
    for h, u in enumerate(units):
        def total(cuts):
            parts = [u[a:b] for a, b in itertools.pairwise([0, *cuts, len(u)])]
            return sum(score.get(p, -20.0 if len(p) == 1 else -1e9) for p in parts)
        best = max(total(c) for k in range(len(u)) for c in itertools.combinations(range(1, len(u)), k))
        got = sum(score[u[e["start"] : e["start"] + e["len"]]] for e in kept[h]) - 20.0 * (len(u) - sum(e["len"] for e in kept[h]))
        assert got == pytest.approx(best)


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = [" ".join(f"w{(i * 37 + j * (i + 3)) % 211}" for j in range(80)) for i in range(60)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[i].upper(), "en", "s0", 1) for i in range(5)]  # exact copies but for case: the larger id stays
    rows += [(200 + i, base[10 + i] + " tail", "en", "s1", 1) for i in range(5)]  # near copies: the smaller id stays
    rows += [(300 + i, base[i + 20] + " vilex vilez vilest" * 3, "en", "s2", 1) for i in range(40)]  # toxic
    rows += [(500, None, None, None, None), (None, "vilex vilez vilest vilex", "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(300 <= (i or 0) < 400)) for i, *_ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(path := f"{tmp_path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(path)
        kept.append(sorted((r[0] for r in docs.select("doc_id").collect()), key=lambda x: (x is None, x)))
    toxic = [i for i in range(300, 340) if i in kept[0]]
    assert len(toxic) <= 2 and set(range(60)) <= set(kept[0]) and None not in kept[0]
    assert not set(range(5)) & set(kept[1]) and set(range(100, 105)) <= set(kept[1])
    assert set(range(10, 15)) <= set(kept[2]) and not set(range(200, 205)) & set(kept[2])
    words = lambda df: df.select(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"\S+"))), F.lit(0))).first()[0]
    before = spark.read.parquet(f"{tmp_path}/minhash_near-dedup")
    assert abs(words(docs) - 1.5 * words(before)) < 200
    final = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert final.count() == docs.count() and final.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == final.count()
    assert os.path.isdir(f"{tmp_path}/documents.parquet")
