"""Corpus pipeline: from documents to packed sequences of clean, unique text.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps, with
their columns as they were; the last returns pieces placed in sequences. ``run``
writes each stage's result as Parquet to the shared folder and reads it for the
next, so a lost executor costs at most one stage's work. Stages take the columns
``doc_id`` and ``text`` by name; others pass through. Rows without an id pass the
stages that compare documents by id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.decontaminate import benchmark_hits
from textloom.llm.exact_dedup import exact_dedup, lower_ascii
from textloom.llm.langid import UNKNOWN, fit_langid, fold, language
from textloom.llm.minhash import near_duplicates
from textloom.llm.packing import pack_documents, packed_by_fewer
from textloom.session import kept

#: A language with a calibrated probability below this is a guess; such documents go, as do those without a letter.
LEAST_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or a likely language; learn from the rows with ``lang`` that are not held out."""
    model = fit_langid(docs.filter(fold(F.col("doc_id")) % 5 != 0))
    found = language(spark, model, F.col("text"))
    known = (found["lang_pred"] != UNKNOWN) & (found["score"] >= LEAST_LANGUAGE_SCORE)
    return docs.filter(known) if model.languages else docs.filter(F.col("text").rlike(r"\p{L}"))


def _chosen(docs: DataFrame, keys: list, keepers: DataFrame, order: list) -> DataFrame:
    """Rows of ``docs`` whose keys are among the keepers, one for each key; rows of a null key all stay."""
    taken = {c.lower() for c in docs.columns}
    prefix = next(p for p in ("__key", *(f"__key{i}" for i in range(len(taken) + 1))) if not any(c.startswith(p) for c in taken))
    names, row = [f"{prefix}_{i}" for i in range(len(keys))], f"{prefix}_row"
    keyed = docs.withColumns(dict(zip(names, keys, strict=True)))
    joined = keyed.join(keepers.toDF(*names).distinct(), names, "left_semi")
    first = Window.partitionBy(*names).orderBy(*order)
    joined = joined.withColumn(row, F.row_number().over(first)).filter(F.col(row) == 1).drop(row)
    null = F.lit(False)
    for name in names:
        null = null | F.col(name).isNull()
    return joined.unionByName(keyed.filter(null)).drop(*names)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the row with the largest id stays."""
    keepers = exact_dedup(docs).filter("kept").select("doc_id", "text_sha256")
    text = F.sha2(lower_ascii(F.col("text")), 256)
    # A null id stays only if no row of its text has one.
    lone = keepers.filter("doc_id IS NULL").select("text_sha256")
    named = _chosen(docs.filter("doc_id IS NOT NULL"), [F.col("doc_id"), text], keepers.filter("doc_id IS NOT NULL"), ["doc_id"])
    return named.unionByName(_chosen(docs.filter("doc_id IS NULL"), [text], lone, ["doc_id"]))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    keepers = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id", "text_sha256")
    return _chosen(docs, [F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)], keepers, ["doc_id"])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return docs.filter(F.size(benchmark_hits(benchmark, F.col("text"))) == 0)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, packed into sequences of 2048 ids."""
    return pack_documents(packed_by_fewer(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("minhash_near_dedup", near_duplicate_groups),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language identification, sketches and packing are not expressible in SQL; a brute-force version checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
