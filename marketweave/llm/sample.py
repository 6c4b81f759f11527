"""Classifiers fitted in one executor task on a bounded sample of labelled rows; the driver sees the model alone."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.llm.bytehash import trim
from marketweave.llm.common import drop, save


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, target: Column, per_class: dict[int, int], extra: Iterable[str] = ()) -> DataFrame:
    """h, id, y, body and extra columns of at most per_class[c] ids of each class c: of those with a text that isn't empty, the ones with the smallest hash h.

    A target given more than once for an id counts with its largest value; of rows that repeat an id the least text is taken.
    Only ids of the sample are broadcast (bounded by per_class). Texts are whole.
    """
    body = F.col(text_col).cast("binary")
    usable = docs.where(F.col(id_col).isNotNull() & (F.octet_length(body) > 0)).select(F.col(id_col).alias("id"))
    rated = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), target.alias("y")).where("y is not null").groupBy("id").agg(F.max("y").alias("y"))
    rated = rated.join(usable, "id", "left_semi").withColumn("h", F.xxhash64("id"))
    picked = None
    for value, most in per_class.items():
        part = rated.where(F.col("y") == value).orderBy("h", "id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    picked = save(picked)
    own = docs.select(F.col(id_col).alias("id"), F.struct(body.alias("body"), *extra).alias("row")).where(F.octet_length("row.body") > 0)
    found = own.join(F.broadcast(picked), "id").groupBy("id", "y", "h").agg(F.min("row").alias("row"))
    return found.select("h", "id", "y", "row.*")


def fit(rows: DataFrame, encode: Callable[[bytes], bytes], learn: Callable[[list[tuple]], object], budget: int):
    """learn's result over (encode(body), y, *extra) of the sample, by hash, until more than `budget` bytes are encoded.

    Texts are encoded where they are read; only what was encoded goes to the one task that learns.
    """
    names = rows.columns[4:]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[4:])

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [encode(v.as_buffer().to_pybytes()) for v in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary()), *b.columns[4:]], names=["h", "y", "x", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                if held and size + len(row[1]) > budget:
                    continue
                size += len(row[1])
                held.append((row[1], row[0], *row[2:]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(held))], pa.binary())], names=["model"])
        del held
        trim()

    short = rows.mapInArrow(shorten, f"h long, y int, x binary{', ' if kinds else ''}{kinds}")
    found = save(short.repartition(1).sortWithinPartitions("h", "x").mapInArrow(run, "model binary"))
    model = found.first()
    drop(found)
    return pickle.loads(bytes(model[0])) if model else learn([])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
