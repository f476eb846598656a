"""Registered queries of the training-data operators, and the SQL some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .clusters import cluster
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .langid import fit_langid, fold, predict_langid
from .licenses import license_scan
from .minhash import near_duplicates
from .packing import pack_documents, packed_by_fewer
from .passages import repeated_passages
from .secret_scan import secret_scan
from .token_files import read_token_files, write_token_files
from .toxicity import fit_toxicity, predict_toxicity
from .warc import read_warc, write_warc
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("text_sha256")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(files)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return secret_scan(documents, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(_table(spark, sf_dir, "pages")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id")) % 4 == 2
    model = fit_toxicity(documents, _table(spark, sf_dir, "labels").filter(~held_out))
    scored = predict_toxicity(documents, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.concat_ws(",", F.col("item_ids").cast("array<string>"))).drop("hits")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id")) % 5 == 0
    model = fit_langid(documents.filter(~held_out))
    return predict_langid(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents")).drop("spans", "kept_text")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(packed_by_fewer(_table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents")).drop("detections")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(_table(spark, sf_dir, "embeddings"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (
        op1_exact_dedup,
        op2_minhash_near_dedup,
        op3_token_files,
        op4_secret_scan,
        op5_warc,
        op6_toxicity,
        op7_benchmark_decontamination,
        op8_language_id,
        op9_repeated_passages,
        op10_best_fit_packing,
        op11_license_scan,
        op12_centroid_clustering,
        op13_embedding_whitening,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": sql.EXACT_DEDUP,
    "op4_secret_scan": sql.SECRET_SCAN,
    "op5_warc": sql.WARC,
    "op11_license_scan": sql.LICENSE_SCAN,
    "op12_centroid_clustering": sql.CLUSTERING,
}
