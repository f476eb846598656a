"""Exact dedup: a tree merge of sorted digest runs, in DataFrame operators only.

Every input partition makes one run: its distinct digests, sorted, each with the
winning row and a count. Runs are then merged in rounds, ``FAN_IN`` of them at a
time, until one is left; a digest's winner climbs the tree and is handed back
down along the same edges. A group of copies of any size is one row per run
after the first level, and no later merge or join sees more than ``FAN_IN`` rows
of a digest, so a hot text needs no salt. Rows merge only if SHA-256, a second
hash and the byte length agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FAN_IN_BITS = 3
KEY = ["digest", "witness", "n_bytes"]


def lower_ascii(text):
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def _merged(rows: DataFrame, pick) -> DataFrame:
    best = pick(F.struct("id", "row")).alias("best")
    groups = rows.groupBy("run", *KEY).agg(best, F.sum("n").alias("n"))
    groups = groups.select("run", *KEY, F.col("best.id").alias("id"), F.col("best.row").alias("row"), "n")
    return groups.sortWithinPartitions("run", "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: ``(id_col, keep_id, group_size, kept, text_sha256)``.

    Texts are equal if identical after lower-casing A-Z; null counts as empty, so
    null and empty texts are one group. ``keep`` says whether the row with the
    largest or the smallest id stays; exactly one row of a group has ``kept``, also
    if an id repeats (any one of the tied rows). A null id is below every other. An
    empty table gives no rows; other columns, whatever their names, are not read.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    pick = F.max if keep == "largest" else F.min
    text = lower_ascii(F.col(text_col))
    leaves = docs.select(
        F.col(id_col).alias("id"),
        F.sha2(text, 256).alias("digest"),
        F.xxhash64(text).alias("witness"),
        F.octet_length(text).alias("n_bytes"),
        F.spark_partition_id().cast("long").alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = kept(leaves, "digest-leaves")
    last = leaves.agg(F.max("run")).first()[0] or 0

    levels = [kept(_merged(leaves.withColumn("n", F.lit(1)), pick), "digest-runs")]
    while last > 0:
        merged = levels[-1].withColumn("run", F.shiftright("run", FAN_IN_BITS))
        levels.append(kept(_merged(merged, pick), "digest-runs"))
        last >>= FAN_IN_BITS

    names = ["run", *KEY]
    winners = levels[-1].select(*names, F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), "n")
    for level in levels[-2::-1]:
        child = level.select(F.col("run").alias("own"), F.shiftright("run", FAN_IN_BITS).alias("run"), *KEY)
        winners = child.join(winners, names).select(F.col("own").alias("run"), *KEY, "keep_id", "keep_row", "n")
    return leaves.join(winners, names).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
