"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - f(text)): all grades share one vector of hashed-text weights and differ by ordered thresholds.
The expected grade and the tail probability P(grade >= 1) rank documents for selection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.llm import bytehash
from marketweave.llm.common import small_batches
from marketweave.llm.langmix import fold
from marketweave.llm.toxicity import tokens
from marketweave.llm.sample import fit, labelled_sample, sigmoid

WORDS = BYTES = SEEN = 1 << 15
SHAPE = 64
FEATURES = WORDS + BYTES + SEEN + SHAPE
#: A word that occurs at all counts, in texts of any length, by how many standard errors over this the mean grade of its documents is off.
NOISE = 3.0
#: Documents to learn from: at most so many of each grade, and features of them; a text is taken whole or not at all.
PER_GRADE, FIT_FEATURES = 3000, 1 << 23


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (text, feature, value): square roots of the shares of hashed words and of byte pairs, which hashed words (without ASCII
    punctuation around them) occur at all, and deciles of the share of words that are distinct, that repeat the word before, and of
    bytes that are letters. Long texts pass in slices; what is held is a few numbers a word and the distinct features."""
    words, first = bytehash.word_hashes(data, offsets)
    n_texts = len(offsets) - 1
    n_words, n_bytes = np.diff(first), np.diff(offsets)
    text_w = np.repeat(np.arange(n_texts), n_words)
    bare, _, bare_first = tokens(data, offsets)
    found = [_counted(text_w * FEATURES + (words % np.uint64(WORDS)).astype(np.int64))]
    found.append(_counted(np.repeat(np.arange(n_texts), np.diff(bare_first)) * FEATURES + WORDS + BYTES + bare.astype(np.int64) % SEEN))
    letters = np.zeros(n_texts, np.int64)
    for lo in range(0, len(data), bytehash.PIECE):
        b = data[lo : lo + bytehash.PIECE + 1].astype(np.uint64)  # with the first byte of the next slice
        own = np.searchsorted(offsets, np.arange(lo, lo + len(b)), "right") - 1
        same = own[:-1] == own[1:]
        pair = (bytehash.mix(b[:-1] * np.uint64(256) + b[1:]) % np.uint64(BYTES)).astype(np.int64)
        found.append(_counted(own[:-1][same] * FEATURES + WORDS + pair[same]))
        letters += np.bincount(own[: bytehash.PIECE][_LETTERS[data[lo : lo + bytehash.PIECE]]], minlength=n_texts)
    key, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    count = np.bincount(inverse, np.concatenate([n for _, n in found]), len(key))
    text, feature = key // FEATURES, key % FEATURES
    value = np.sqrt(count / np.where(feature < WORDS, np.maximum(n_words, 1)[text], np.maximum(n_bytes, 1)[text]))
    value[feature >= WORDS + BYTES] = 1.0
    distinct = np.bincount(text[feature < WORDS], minlength=n_texts)
    repeat = np.bincount(text_w[1:][(words[1:] == words[:-1]) & (text_w[1:] == text_w[:-1])], minlength=n_texts) if len(words) > 1 else np.zeros(n_texts)
    decile = lambda a, n: np.minimum(9, (10 * a / np.maximum(n, 1)).astype(np.int64))
    shape = [decile(distinct, n_words), 10 + decile(repeat, n_words), 20 + decile(letters, n_bytes), 30 + np.minimum(19, np.log2(n_words + 1).astype(np.int64))]
    extra = np.concatenate(shape) + WORDS + BYTES + SEEN
    return np.concatenate([text, np.tile(np.arange(n_texts), 4)]), np.concatenate([feature, extra]), np.concatenate([value, np.full(len(extra), 0.5)])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def encoded(body: bytes) -> bytes:
    """Features of one text, eight bytes each."""
    _, feature, value = features(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
    return feature.astype(np.int32).tobytes() + value.astype(np.float32).tobytes()


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256), 32]] = True


@dataclass
class OrdinalModel:
    weights: np.ndarray  # of features whose values were multiplied by how telling they are
    thresholds: np.ndarray

    def tails(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K, one row per text."""
        text, feature, value = features(data, offsets)
        f = np.bincount(text, weights=self.weights[feature] * value, minlength=len(offsets) - 1)
        return sigmoid(f[:, None] - self.thresholds)


def train(rows: list[tuple], grades: int, epochs: int = 12, rate: float = 0.1, l2: float = 1e-5, seed: int = 5) -> OrdinalModel | None:
    """rows: (encoded text, grade 0 .. grades-1); None without rows of two grades. Adagrad on batches of 64; gaps between thresholds stay positive."""
    y = np.array([r[1] for r in rows], int)
    if not rows or y.min() == y.max():
        return None
    first = np.concatenate([[0], np.cumsum([len(r[0]) // 8 for r in rows])])
    feature = np.concatenate([np.frombuffer(r[0], np.int32, len(r[0]) // 8) for r in rows])
    value = np.concatenate([np.frombuffer(r[0], np.float32, offset=len(r[0]) // 2) for r in rows])
    told = np.repeat(np.arange(len(rows)), np.diff(first))
    n = np.bincount(feature, minlength=FEATURES)
    off = (np.bincount(feature, y[told] - y.mean(), FEATURES)) / np.sqrt(np.maximum(n, 1)) / y.std()
    telling = np.where(np.arange(FEATURES) // SEEN == 2, np.clip(np.sign(off) * np.maximum(np.abs(off) - NOISE, 0) / 4, -3, 3), 1.0)
    value = value * telling[feature].astype(np.float32)
    share = np.array([(y >= k).mean() for k in range(1, grades)]).clip(0.01, 0.99)
    w, gaps = np.zeros(FEATURES), np.diff(-np.log(share / (1 - share)), prepend=0.0)
    base, gaps = gaps[0], np.log(np.maximum(gaps[1:], 0.05))
    seen_w, seen_t = np.full(FEATURES, 1e-4), np.full(grades - 1, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in batch])
            own = np.repeat(np.arange(len(batch)), first[batch + 1] - first[batch])
            t = base + np.concatenate([[0], np.cumsum(np.exp(gaps))])
            f = np.bincount(own, weights=w[feature[at]] * value[at], minlength=len(batch))
            # With s_k = P(y >= k), P(y = k) = s_k - s_{k+1}; its log's slope in f is 1 - s_k - s_{k+1}.
            s = np.concatenate([np.ones((len(batch), 1)), sigmoid(f[:, None] - t), np.zeros((len(batch), 1))], 1)
            yb, i = y[batch], np.arange(len(batch))
            hi, lo = s[i, yb], s[i, yb + 1]
            p = np.maximum(hi - lo, 1e-9)
            df = -(hi * (1 - hi) - lo * (1 - lo)) / p
            dt = np.zeros(grades + 1)
            np.add.at(dt, yb, hi * (1 - hi) / p)
            np.add.at(dt, yb + 1, -lo * (1 - lo) / p)
            dt = dt[1:grades]
            u, inv = np.unique(feature[at], return_inverse=True)
            g = np.bincount(inv, weights=df[own] * value[at]) + l2 * w[u] * len(batch)
            seen_w[u] += g * g
            w[u] -= rate * g / np.sqrt(seen_w[u])
            g_t = np.concatenate([[dt.sum()], [dt[k:].sum() * np.exp(gaps[k - 1]) for k in range(1, grades - 1)]])
            seen_t += g_t * g_t
            base -= rate * g_t[0] / np.sqrt(seen_t[0])
            gaps -= rate * g_t[1:] / np.sqrt(seen_t[1:])
    return OrdinalModel(w * telling, base + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def grade(quality: Column, toxic: Column) -> Column:
    """Ratings of the labels: 0 low quality, 1 good but toxic, 2 good and clean; null without a quality."""
    return F.when(quality == 0, 0).when(quality == 1, F.when(toxic == 1, 1).otherwise(2))


def quality(docs: DataFrame, ratings: DataFrame, grades: int = 3, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", folds: int = 4, held_fold: int = 3, keep_at: float = 0.5) -> DataFrame:
    """id, held_out, expected_grade, score = P(grade >= 1), top = P(grade = highest) and kept (score >= keep_at) of every row.

    ratings: id and an integer grade, 0 .. grades-1; nulls are ignored, and the highest of several counts. Learns from a bounded sample
    (PER_GRADE, FIT_FEATURES) outside the held-out fold, in one executor task. Only the text enters a score; null and empty texts score as
    texts without words. Without ratings of two grades, as in empty tables, every score is 1 and all is kept. Repeated rows score
    alike; rows with a null id aren't learned from. Other columns of either table are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    known = ratings.where(fold(id_col, folds) != held_fold)
    rows = labelled_sample(docs, known, id_col, text_col, F.col(grade_col).cast("int"), dict.fromkeys(range(grades), PER_GRADE))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, encoded, lambda found: train(found, grades), 8 * FIT_FEATURES))
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("expected_grade", pa.float64()), ("score", pa.float64()), ("top", pa.float64()), ("kept", pa.bool_())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in bytehash.texts(batches, 1 << 19):
            t = model.tails(*bytehash.utf8(part.column(2))) if model else np.ones((part.num_rows, grades - 1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(t.sum(1)), pa.array(t[:, 0]), pa.array(t[:, -1]), pa.array(t[:, 0] >= keep_at)], schema=schema)

    held = F.coalesce(fold(id_col, folds) == held_fold, F.lit(False)).alias("held_out")
    scored = docs.select(F.col(id_col).cast("long").alias("id"), held, F.col(text_col).cast("binary").alias("body"))
    scored = scored.mapInArrow(predict, "id long, held_out boolean, expected_grade double, score double, top double, kept boolean")
    return scored.withColumnRenamed("id", id_col)
