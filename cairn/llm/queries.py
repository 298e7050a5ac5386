"""Registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import cotraining, embeddings, html_text, mixing, oracles, pieces, quality_rules, secrets, simhash, substrings, tokenshards


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"), min_len=200, keep="none")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Per document the three best encodings' scores and digests, and whether the best one decodes to the text."""
    model = model or piece_model_path()
    found = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, n_best=3, decoded="decoded")
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.col("ids_score").alias("score"),
        F.col("ids_n_best.score").alias("n_best_scores"),
        F.transform("ids_n_best", lambda x: F.crc32(x["ids"])).alias("n_best_crc32"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_shards(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    manifest = tokenshards.write_shards(table(spark, sf_dir, "documents"), tokenizer or tokenizer_path(), end_id=2)
    return tokenshards.read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotraining.fit(docs, table(spark, sf_dir, "labels"))
    found = cotraining.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.col("quality_text").alias("p_text"), F.col("quality_meta").alias("p_metadata"), F.col("quality").alias("score"), F.col("quality_kept").alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "layered")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substrings": op1_substrings,
        "op2_simhash": op2_simhash,
        "op3_pieces": op3_pieces,
        "op4_mixing": op4_mixing,
        "op5_token_shards": op5_token_shards,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_quality_rules": op7_quality_rules,
        "op8_html_text": op8_html_text,
        "op9_embeddings": op9_embeddings,
        "op10_secrets": op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
