"""A training corpus from raw documents: toxic documents go, then exact and near copies, then sources are mixed and encoded.

Each stage reads all that the one before kept; stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.llm.common import lower_ascii, release, save
from marketweave.llm.exact import exact_dedup
from marketweave.llm.minhash import near_dedup
from marketweave.llm.mixing import draw, pareto_mix, word_count
from marketweave.llm.pieces import encode, load_model
from marketweave.llm.queries import tokenizer_path
from marketweave.llm.toxicity import toxicity

#: The toxicity network is trained and a text's pieces come from a tokenizer's merges: SQL has neither.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold, rows with a null id and with null or empty texts too; all stay without labels of both classes."""
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=docs.columns)
    return scored.where("predicted = 0").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text (A-Z in lower case): the one with the largest id; of rows that repeat id and text, one.

    Null text counts as empty; a null id stays only where no other has its text. Rows come along whole, whatever their columns' names.
    """
    verdicts = save(exact_dedup(docs).select(F.col("doc_id").alias("other"), "kept", F.unhex("text_sha256").alias("theirs")))
    release(spark, 1)
    mine = docs.select(F.struct(*docs.columns).alias("row")).select("row", F.unhex(F.sha2(lower_ascii(F.coalesce("row.text", F.lit(""))), 256)).alias("sha"))
    same = F.col("row.doc_id").eqNullSafe(F.col("other")) & (F.col("sha") == F.col("theirs"))
    out = mine.join(verdicts.where("not kept").select("other", "theirs").distinct(), same, "left_anti")
    if not verdicts.where("kept").groupBy("other", "theirs").count().where("count > 1").isEmpty():
        out = out.withColumn("id", F.col("row.doc_id")).groupBy("id", "sha").agg(F.min("row").alias("row"))
    return out.select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard similarity of at least 0.8): the one with the smallest id.

    Rows without words or with a null id stay; rows that share an id share its fate. Other columns come along, whatever their names.
    """
    gone = save(near_dedup(docs, width=5, percent=80).where("not kept").select(F.col("doc_id").alias("gone")).distinct())
    release(spark, 1)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; a document taken twice is two rows, one without words none.

    A row's copies follow from its id, source, number of words and draw, so they find it by these without any doubt.
    """
    key = ["doc_id", "source", "size", "u"]
    taken = pareto_mix(docs).where("copies > 0").groupBy(*key).agg(F.max("copies").alias("copies"))
    taken = save(taken.select(*[F.col(c).alias(f"t_{c}") for c in key], "copies"))
    release(spark, 1)
    rows = docs.select(F.struct(*docs.columns).alias("row")).select("row", word_count(F.col("row.text")).alias("size"), draw("row.doc_id", "row.text").alias("u"))
    same = F.col("row.doc_id").eqNullSafe(F.col("t_doc_id")) & F.col("row.source").eqNullSafe(F.col("t_source")) & (F.col("size") == F.col("t_size")) & (F.col("u") == F.col("t_u"))
    return rows.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip of every row of the mix; null and empty texts have no pieces."""
    return encode(docs, load_model(tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
