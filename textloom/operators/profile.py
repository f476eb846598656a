"""Counts that describe a labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, largest first; null is not a value."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )


def kept_counts(df: DataFrame, keep, by: list[str] | None = None) -> DataFrame:
    """Rows before and after a filter."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n_before"), F.count_if(keep).alias("n_after"))


def class_balance(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Class sizes, their ratio in percent, and the number of classes."""
    positive, negative = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return df.groupBy(*(by or [])).agg(
        positive.alias("n_positive"),
        negative.alias("n_negative"),
        (positive / F.nullif(negative, F.lit(0)) * 100).alias("imbalance_pct"),
        F.count_distinct("label").alias("n_classes"),
    )


def longest_text(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.max(F.size(tx.words(F.col("text")))).cast("long").alias("max_words"))


def longest_sequence(df: DataFrame, ids: str, pad: int = 0) -> DataFrame:
    """Greatest unpadded length and the first row that has it."""
    n = F.size(F.filter(ids, lambda x: x != pad)).cast("long")
    return df.select("id", n.alias("n")).agg(
        F.max("n").alias("max_len"), F.max_by("id", F.struct("n", -F.col("id"))).alias("id")
    )


def majority_minority(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Largest and smallest class with their sizes; the lower label wins a tie."""
    by = by or []
    counts = df.groupBy(*by, "label").agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(
        F.max_by("label", F.struct("n", -F.col("label"))).alias("majority"),
        F.max("n").alias("n_majority"),
        F.min_by("label", F.struct("n", "label")).alias("minority"),
        F.min("n").alias("n_minority"),
    )
