"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to its smallest one.

    The minimum is aggregated first and joined back, so a hub is never one group.
    """
    if larger:
        near = _both(links)
        low = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        pairs = near.filter("b > a").join(low, "a").select(F.col("b").alias("x"), "m")
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = near.groupBy("a").agg(F.min("b").alias("m"))
        pairs = near.join(low, "a").select(F.col("b").alias("x"), "m").union(low.select(F.col("a").alias("x"), "m"))
    return pairs.filter("x != m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def _state(links: DataFrame):
    """Count and order-free checksum: stars that change nothing leave both as they are."""
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of the links ``(a, b)``; a component is named by its smallest node.

    Rounds of a large and a small star until nothing changes: some logarithm of the
    longest chain. Every round is written, so lineage stays short. Links with a null
    end and links of a node to itself are no links.
    """
    links = kept(links.select("a", "b").filter("a != b").distinct(), "links")
    state = _state(links)
    while True:
        links = kept(_star(_star(links, True), False), "stars")
        after = _state(links)
        if after == state:
            break
        state = after
    lone = links.select("a").distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        lone.select(F.col("a").alias("node"), F.col("a").alias("component"))
    )
