"""Language identification by multilingual mixture inference.

Each language has smoothed probabilities of hashed byte trigrams of its letters. Expectation-maximisation finds the proportions
with which a document mixes the languages; languages are then dropped while the penalised likelihood gains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.llm import bytehash
from marketweave.llm.common import small_batches

BUCKETS = 1 << 15
#: At most about so many documents of each language are learned from, those with the smallest hash of their id.
DOCS_PER_LANGUAGE = 3000
#: Trigrams overlap and repeat, so a document's likelihood counts at this rate against the penalty of ln(n)/2 for each language.
EVIDENCE = 0.2

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids are in no fold (null)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def trigrams(body: np.ndarray) -> np.ndarray:
    """Hashed letter trigrams of one text's bytes; everything that isn't a letter is a space, and spaces collapse."""
    b = _LETTER[body]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    b = np.concatenate([[32], b[keep], [32]]).astype(np.uint64)
    code = b[:-2] * np.uint64(0x9E3779B1) + b[1:-1] * np.uint64(0x85EBCA6B) * np.uint64(257) + b[2:] * np.uint64(0xC2B2AE3D) * np.uint64(65537)
    return (bytehash.mix(code) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            sums[lang] += np.bincount(trigrams(np.frombuffer(body, np.uint8)), minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table["counts"].to_pylist())
    return pa.table({"lang": table["lang"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def learn_languages(rows: DataFrame, lang_col: str, text_col: str, hash_col: Column) -> tuple[list[str], np.ndarray]:
    """Languages (by code point) and their trigram probabilities, BUCKETS x languages, from rows with both columns."""
    small_batches(rows.sparkSession)
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    shares = rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    if not shares:
        return [], np.zeros((BUCKETS, 0))
    share = F.create_map(*[F.lit(x) for r in shares for x in (r[0], min(1.0, DOCS_PER_LANGUAGE / r[1]))])
    drawn = rows.where(F.pmod(hash_col, F.lit(1 << 30)) <= share[F.col(lang_col)] * float(1 << 30))
    parts = drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("body")).mapInArrow(_count, "lang string, counts binary")
    found = sorted(parts.groupBy("lang").applyInArrow(_add, "lang string, counts binary").collect(), key=lambda r: r[0].encode())
    counts = np.stack([np.frombuffer(bytes(r[1]), np.int64) for r in found], 1) + 0.5 if found else np.zeros((BUCKETS, 0))
    return [r[0] for r in found], counts / counts.sum(0)


def _em(p: np.ndarray, c: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    n = c.sum()
    for _ in range(rounds):
        s = p @ pi
        new = pi * ((c / s) @ p) / n
        if np.abs(new - pi).max() < 1e-4:
            pi = new
            break
        pi = new
    return pi, float(c @ np.log(p @ pi))


def mixture(grams: np.ndarray, table: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Proportions of the languages in a text; 0 for those outside the chosen set."""
    counts = np.bincount(grams, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    p, c = table[at], counts[at].astype(float)
    chosen = np.arange(table.shape[1])
    pi, like = _em(p, c, np.full(len(chosen), 1 / len(chosen)), rounds)
    penalty = 0.5 * np.log(max(2.0, c.sum()))
    while len(chosen) > 1:
        rest = np.delete(np.arange(len(chosen)), pi.argmin())
        q = pi[rest] + 1e-3
        without, less = _em(p[:, rest], c, q / q.sum(), rounds)
        if EVIDENCE * (like - less) > penalty:
            break
        p, chosen, pi, like = p[:, rest], chosen[rest], without, less
    out = np.zeros(table.shape[1])
    out[chosen] = pi
    return out


def predict_languages(docs: DataFrame, languages: list[str], table: np.ndarray, id_col: str = "doc_id", text_col: str = "text", extra: list[Column] | None = None) -> DataFrame:
    """id, extra columns, lang_pred, score (its proportion) and mix (language -> proportion) of every row; `und`, 0.0 and an empty map where the text is null or has no letter, or nothing was learned."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((languages, table))
    extra = extra or []
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("mix", pa.map_(pa.string(), pa.float64()))])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, probs = shared.value
        for batch in batches:
            out = []
            for body, lettered in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                grams = trigrams(np.frombuffer(body.as_buffer(), np.uint8)) if lettered and names else np.zeros(0, np.int64)
                if not len(grams):
                    out.append(("und", 0.0, []))
                    continue
                pi = mixture(grams, probs)
                best = int(pi.argmax())
                out.append((names[best], min(1.0, float(pi[best])), [(names[i], float(pi[i])) for i in np.flatnonzero(pi)]))
            cols = [pa.array([o[i] for o in out], schema.field(i).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *cols], names=[*batch.schema.names[2:], *schema.names])

    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(text_col).cast("binary").alias("_body"), lettered.alias("_lettered"), F.col(id_col), *extra)
    kinds = [f.simpleString().replace(":", " ", 1) for f in rows.schema.fields[2:]]
    return rows.mapInArrow(predict, ", ".join([*kinds, "lang_pred string, score double, mix map<string, double>"]))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """id, held_out, lang_pred, score, mix. Learns from rows outside fold 0 with a language; see predict_languages for empty texts.

    The language, source and id never enter a prediction. Rows with a null id are neither held out nor learned from. Repeated rows have
    equal results. With no labelled row every prediction is `und`. Texts are read whole.
    """
    train = docs.where(fold(id_col, folds) != 0)
    languages, table = learn_languages(train, lang_col, text_col, F.xxhash64(F.col(id_col)))
    held = F.coalesce(fold(id_col, folds) == 0, F.lit(False)).alias("held_out")
    return predict_languages(docs, languages, table, id_col, text_col, [held])
