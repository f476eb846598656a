"""Column choice and row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_labelled(df: DataFrame, ident: str, text: str, label: str | Column, project: str | None = None) -> DataFrame:
    """Choose and rename to ``(id, text, label, project)``."""
    label = F.col(label) if isinstance(label, str) else label
    source = F.col(project) if project else F.lit(None)
    return df.select(
        F.col(ident).cast("long").alias("id"),
        F.col(text).alias("text"),
        label.cast("int").alias("label"),
        source.cast("string").alias("project"),
    )


def exclude_project(df: DataFrame, project: str) -> DataFrame:
    """Drop one project; rows without a project stay."""
    return df.filter(~F.col("project").eqNullSafe(project))


def drop_null_text(df: DataFrame) -> DataFrame:
    """Drop null and empty text; blanks and words such as ``null`` stay."""
    return df.filter(F.col("text") != "")


def with_label(df: DataFrame, label: int) -> DataFrame:
    return df.withColumn("label", F.lit(label))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy("id").limit(n)
