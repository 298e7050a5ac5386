"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

1. quality classifier: documents it rejects go;
2. near-duplicates (Jaccard similarity of five-word shingles at least 0.8): one document of each group stays;
3. secret scan: found spans are replaced by their kind, all documents stay;
4. mixing: each source is cut or repeated to its target, a document as often as it is taken;
5. piece encoding: ids, their number and the scores of the best encodings.

Every stage works on all rows that the one before it kept.  All but the last return the columns of
``documents``.  Null texts pass (with the lowest scores) as far as the classifier keeps them and get
null ids.  SQL can express neither the classifier nor the encodings, so there is no ``ORACLE_SQL``;
``tests/llm/test_pipeline.py`` holds the stages against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import cotraining, mixing, pieces, secrets, simhash
from cairn.llm.queries import piece_model_path
from cairn.llm.shared import fresh_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotraining.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_similar(docs, shingle=5, least=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.redact(docs)
    return found.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pieces.encode(docs, piece_model_path(), n_best=3, keep=["doc_id", "source"], paths=False, cache_bytes=32 << 20)
    return found.select("doc_id", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.col("ids_score").alias("score"), F.col("ids_n_best.score").alias("n_best_scores"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("encoding", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
