"""Exact order, rank and cut points without a single-task sort.

Seeded order is the order of ``md5(seed|id)``: uniform, portable to SQL and
independent of partitioning. Its leading hex digits split any key, however
large, into equal buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .bounded import pin_small

PAGE_BITS = 20


def seeded_key(seed: Column | int, ident: Column, salt: str = "") -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat(seed.cast("string"), F.lit(salt + "|"), ident.cast("string")))


def digest_digits(rows: int) -> int:
    """Leading digits that leave a bucket some 2**16 rows at most, three at least."""
    digits = 3
    while rows >> 4 * digits > 1 << 16:
        digits += 1
    return digits


def digest_bucket(key: Column, digits: int = 3) -> Column:
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def page_of(ident: Column) -> Column:
    """Order-preserving page of a unique BIGINT: at most 2**20 rows share one."""
    return F.shiftright(ident, PAGE_BITS)


def _before(counts: DataFrame, keys: list[str], bucket: str, paged: bool) -> DataFrame:
    """Rows in earlier buckets of the same key.

    Page numbers are unbounded and summed in two levels, so no window sees more
    than 2**20 pages of one coarse group; digest buckets are few.
    """
    upto = lambda part, order: (
        Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    if not paged:
        before = F.coalesce(F.sum("_n").over(upto(keys, bucket)), F.lit(0))
        return counts.withColumn("_before", before)
    counts = counts.withColumn("_coarse", F.shiftright(bucket, PAGE_BITS))
    totals = counts.groupBy(*keys, "_coarse").agg(F.sum("_n").alias("_n"))
    totals = totals.select(
        *keys, "_coarse", F.coalesce(F.sum("_n").over(upto(keys, "_coarse")), F.lit(0)).alias("_base")
    )
    fine = F.coalesce(F.sum("_n").over(upto([*keys, "_coarse"], bucket)), F.lit(0))
    return (
        counts.withColumn("_fine", fine)
        .join(totals, [*keys, "_coarse"])
        .select(*keys, bucket, "_n", (F.col("_base") + F.col("_fine")).alias("_before"))
    )


def position_within(
    df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "pos", paged: bool = False
) -> DataFrame:
    """1-based position of each row inside its key.

    ``bucket`` must grow with ``order`` and hold a bounded number of rows. The
    local sort and the join with the offsets share one hash partitioning, so the
    rows are shuffled once; a hot key is spread over its buckets.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    offsets = pin_small(_before(counts, keys, "_bucket", paged).drop("_n"))
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        df.withColumn("_local", local)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_bucket", "_local", "_before")
    )


def shuffled_position(df: DataFrame, seed: Column | int, salt: str = "", name: str = "pos") -> DataFrame:
    """Position of every row in the seeded shuffle of the table."""
    df = df.withColumn("_key", seeded_key(seed, F.col("id"), salt))
    bucket = digest_bucket(F.col("_key"), digest_digits(df.count()))
    return position_within(df, [], bucket, ["_key", "id"], name).drop("_key")


def row_position(df: DataFrame, name: str = "pos") -> DataFrame:
    """Position of every row in ``id`` order."""
    return position_within(df, [], page_of(F.col("id")), ["id"], name, paged=True)


def seeded_shuffle(df: DataFrame, seed: int, salt: str = "") -> DataFrame:
    """The whole table in seeded order (a range-partitioned sort)."""
    return df.orderBy(seeded_key(seed, F.col("id"), salt), "id")


def rank_cuts(
    keys: DataFrame, group: list[str], order: str, bucket: Column, cuts: DataFrame, paged: bool = False
) -> DataFrame:
    """The ``order`` value at given 1-based ranks of each group.

    ``cuts`` holds ``(*group, cut, rank)``. Counts per bucket locate each rank;
    only the rows of the one bucket that holds it are sorted.
    Returns ``(*group, cut, at)``; a rank of 0 has no row.
    """
    keys = keys.select(*group, F.col(order), bucket.alias("_bucket"))
    counts = keys.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    spans = _before(counts, group, "_bucket", paged)
    inside = (F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_n"))
    wanted = pin_small(spans.join(cuts, group).filter(inside).select(*group, "_bucket", "_before", "cut", "rank"))
    sought = keys.join(wanted.select(*group, "_bucket").distinct(), [*group, "_bucket"])
    local = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(order))
    return (
        sought.withColumn("_local", local)
        .join(wanted, [*group, "_bucket"])
        .filter(F.col("_before") + F.col("_local") == F.col("rank"))
        .select(*group, "cut", F.col(order).alias("at"))
    )


def place(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Sort by range and checkpoint, adding ``_part`` and the row's place ``_row`` in it.

    The checkpoint fixes what each partition holds and cuts lineage. Ranges come
    from a sample of the whole sort key, so a key without repeats gives even
    partitions whatever its values.
    """
    shared_dir(df.sparkSession)
    placed = df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    return placed.withColumn("_part", F.shiftright("_row", 33)).withColumn(
        "_row", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    )


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """1-based rank over a whole table: place in the partition plus the sizes of earlier ones."""
    placed = place(df, order)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (
        placed.join(pin_small(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_row") + 1)
        .drop("_row", "_part", "_before")
    )


def top_within(df: DataFrame, key: list[str], order: list[Column], spread: Column, n: int) -> DataFrame:
    """First ``n`` rows of each key, taken in two levels.

    A key is first cut to ``n`` rows in each of 256 parts, so the last sort sees
    at most ``256 * n`` rows of it.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(256))
    first = Window.partitionBy(*key, "_part").orderBy(*order)
    last = Window.partitionBy(*key).orderBy(*order)
    return (
        df.withColumn("_part", part)
        .withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(last))
        .filter(F.col("_rn") <= n)
        .drop("_part", "_rn")
    )
