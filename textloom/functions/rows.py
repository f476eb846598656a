"""Arrays to rows.

The outer generators are used on purpose: for the inner ones the optimizer adds
a filter on the array's size below, which evaluates an expensive array
expression (a tokenizer, say) a second time. Rows of empty arrays are dropped
after the fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, array: Column | str, name: str) -> DataFrame:
    """One row per element; null elements are dropped."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def unnest_structs(df: DataFrame, keep: list, array: Column | str) -> DataFrame:
    """One row per struct with its fields as columns; the first field must not be null."""
    rows = df.select(*keep, F.inline_outer(array))
    return rows.filter(F.col(rows.columns[len(keep)]).isNotNull())
