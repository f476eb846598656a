"""Fixed-length token-id sequences for sequence classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as ar

MAX_LEN = 512


def longest_train(df: DataFrame, length: Column) -> int:
    """Greatest length among the train rows: one number."""
    return df.filter(F.col("split") == "train").agg(F.max(length)).first()[0] or 0


def static_sequences(df: DataFrame, longest: int, n: int = MAX_LEN) -> DataFrame:
    """Cut from the front to the longest train text, keep the first ``n``, pad at the end."""
    width = min(longest, n)
    kept = ar.drop_front_keep_first(F.col("ids"), longest, n)
    return df.withColumn("seq", ar.pad_end(kept, width))


def encoder_sequences(df: DataFrame, limit: int = 510) -> DataFrame:
    """First ``limit`` ids, padded (and cut) to the longest train row."""
    df = df.withColumn("_kept", ar.keep_first(F.col("ids"), limit))
    width = longest_train(df, F.size("_kept"))
    return df.withColumn("seq", ar.pad_end(ar.keep_first(F.col("_kept"), width), width)).drop("_kept")


def decoder_sequences(df: DataFrame, limit: int = 1024, n: int = MAX_LEN) -> DataFrame:
    """The tokenizer's own limit from the front, then the last ``n`` ids, padded at the end."""
    kept = ar.keep_last(ar.keep_first(F.col("ids"), limit), n)
    return df.withColumn("seq", ar.pad_end(kept, n))


def batch_sequences(df: DataFrame, first: int | None, last: int | None, limit: int = MAX_LEN) -> DataFrame:
    """At most ``limit`` ids including special ones, width of the longest train row, and a mask.

    ``first`` and ``last`` are the special ids; ``None`` leaves them out.
    """
    special = (first is not None) + (last is not None)

    def framed(width: int) -> Column:
        parts = [ar.keep_first(F.col("ids"), max(width - special, 0))]
        if first is not None:
            parts.insert(0, F.array(F.lit(first)))
        if last is not None:
            parts.append(F.array(F.lit(last)))
        return F.concat(*parts)

    width = longest_train(df, F.size(framed(limit)))
    df = df.withColumn("_kept", framed(width))
    return df.select(
        *[c for c in df.columns if c != "_kept"],
        ar.pad_end(F.col("_kept"), width).alias("seq"),
        ar.attention_mask(F.col("_kept"), width).alias("mask"),
    )
