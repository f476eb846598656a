"""Splitting and rebalancing.

Every split is a comparison of a row's key with a few cut points per class. The
cut points come from counts on the key columns alone; the text is never
shuffled, and a class of any size is handled by all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import unnest_structs
from .bounded import pin_small
from .ordering import digest_bucket, digest_digits, page_of, rank_cuts, seeded_key

RATIO = 0.1


def positional_split(df: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Adds ``split``: the last share of ids is test, the share before it val.

    Fewer rows than ``1 / ratio`` would leave every split but one empty, so such
    a table is refused.
    """
    total = df.count()
    share = int(ratio * total)
    if share < 1:
        raise ValueError(f"{total} rows are too few to split by {ratio}")
    ranks = [(0, "test", total - share + 1), (0, "val", total - 2 * share + 1)]
    cuts = df.sparkSession.createDataFrame(ranks, "part int, cut string, rank long")
    keys = df.select(F.lit(0).alias("part"), "id")
    found = rank_cuts(keys, ["part"], "id", page_of(F.col("id")), cuts, paged=True).collect()
    at = {row["cut"]: row["at"] for row in found}
    split = F.when(F.col("id") >= at["test"], "test").when(F.col("id") >= at["val"], "val").otherwise("train")
    return df.withColumn("split", split)


def _quotas(counts: DataFrame, size: str, name: str) -> DataFrame:
    """Largest-remainder share of ``size`` rows for each class, lower label first on ties."""
    counts = counts.withColumn("_all", F.sum("n").over(Window.partitionBy("_one")))
    # Twenty digits times eighteen: the product of two counts never overflows.
    product = f"CAST({size} AS DECIMAL(20,0)) * CAST(n AS DECIMAL(18,0))"
    counts = counts.withColumn("_floor", F.expr(f"({product}) DIV _all"))
    counts = counts.withColumn("_rest", F.expr(f"({product}) % CAST(_all AS DECIMAL(20,0))"))
    order = Window.partitionBy("_one").orderBy(F.desc("_rest"), "label")
    left = F.col(size) - F.sum("_floor").over(Window.partitionBy("_one"))
    extra = (F.row_number().over(order) <= left).cast("long")
    return counts.withColumn(name, F.col("_floor") + extra).drop("_all", "_floor", "_rest")


def class_quotas(df: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``(label, n, n_test, n_val)``: test first, then val from what is left."""
    counts = df.groupBy("label").agg(F.count("*").alias("n")).withColumn("_one", F.lit(1))
    whole = F.sum("n").over(Window.partitionBy("_one"))
    counts = counts.withColumn("_size", F.ceil(F.lit(ratio) * whole).cast("long"))
    counts = _quotas(counts, "_size", "n_test").withColumnRenamed("n", "n_class")
    counts = counts.withColumn("n", F.col("n_class") - F.col("n_test"))
    counts = counts.withColumn("_size", F.ceil(F.lit(ratio) * whole).cast("long"))
    counts = _quotas(counts, "_size", "n_val")
    return counts.select("label", F.col("n_class").alias("n"), "n_test", "n_val")


def _seed_rows(df: DataFrame, seeds: list[int]) -> DataFrame:
    return df.withColumn("seed", F.explode(F.lit(seeds)))


def _per_class_cuts(df: DataFrame, seeds: list[int], ranks: DataFrame, salt: str) -> DataFrame:
    """``(seed, label, cut, at)`` for ranks given per seed and class."""
    keys = _seed_rows(df.select("id", "label"), seeds)
    keys = keys.withColumn("_key", seeded_key(F.col("seed"), F.col("id"), salt))
    return rank_cuts(keys, ["seed", "label"], "_key", digest_bucket(F.col("_key"), digest_digits(df.count())), ranks)


def assign_stratified(df: DataFrame, seeds: list[int], ratio: float = RATIO) -> DataFrame:
    """Adds ``assign``: for each seed in order, ``struct<seed, split>``.

    One row per document whatever the number of seeds, so text is tokenized once.
    Rows without a label belong to no class; a table that holds some is refused.
    """
    quotas = pin_small(class_quotas(df, ratio))
    unlabelled = quotas.filter("label IS NULL").first()
    if unlabelled:
        raise ValueError(f"{unlabelled['n']} rows have no label; drop them or give them one before splitting")
    steps = F.array(
        F.struct(F.lit("test").alias("cut"), F.col("n_test").alias("rank")),
        F.struct(F.lit("val").alias("cut"), (F.col("n_test") + F.col("n_val")).alias("rank")),
    )
    ranks = _seed_rows(unnest_structs(quotas, ["label"], steps), seeds)
    cuts = _per_class_cuts(df, seeds, ranks, "")
    last = lambda cut: F.max(F.when(F.col("cut") == cut, F.col("at"))).alias(cut)
    cuts = cuts.groupBy("label", "seed").agg(last("test"), last("val"))
    grid = _seed_rows(quotas.select("label"), seeds).join(cuts, ["label", "seed"], "left").fillna("")
    slot = F.array_position(F.lit(seeds), F.col("seed")).alias("slot")
    table = grid.groupBy("label").agg(
        F.sort_array(F.collect_list(F.struct(slot, "seed", "test", "val"))).alias("_cuts")
    )
    df = df.join(pin_small(table), "label")

    def choose(cut: Column) -> Column:
        key = seeded_key(cut["seed"], F.col("id"))
        split = F.when(key <= cut["test"], "test").when(key <= cut["val"], "val").otherwise("train")
        return F.struct(cut["seed"].alias("seed"), split.alias("split"))

    return df.withColumn("assign", F.transform("_cuts", choose)).drop("_cuts")


SURPLUS = "u"


def runs_of(seeds: list[int], treatments: list) -> list[tuple[int, int, int]]:
    """``(run, treatment, seed)`` of a study: runs are numbered, treatment by treatment.

    With one treatment a run is named by its seed. A run is never computed back into
    a seed; this list, or a join with it, says what it stands for.
    """
    if len(treatments) == 1:
        return [(seed, 0, seed) for seed in seeds]
    return [(place * len(seeds) + slot, place, seed) for place in range(len(treatments)) for slot, seed in enumerate(seeds)]


def assign_treatments(
    df: DataFrame, seeds: list[int], treatments: list[int | None], ratio: float = RATIO
) -> DataFrame:
    """``assign`` with one entry per treatment and seed, its ``seed`` being their run of ``runs_of``.

    A treatment is the undersampling ratio ``k``, or ``None`` for all train
    rows. Surplus train rows of the majority class get the split ``dropped``.
    All treatments share one split and one search for their cut points.
    """
    df = assign_stratified(df, seeds, ratio)
    ratios = sorted({k for k in treatments if k})
    kind = df.schema["assign"].dataType.elementType["seed"].dataType
    df = df.withColumn("_keep", F.lit(None).cast(f"map<struct<seed:{kind.simpleString()},k:int>,string>"))
    if ratios:
        train = unnest_structs(df, ["id", "label"], "assign").filter(F.col("split") == "train").drop("split")
        cuts = undersample_cuts(train, ratios)
        entry = F.struct(F.struct("seed", "k"), "at")
        kept = pin_small(cuts.groupBy("label").agg(F.map_from_entries(F.collect_list(entry)).alias("_keep")))
        df = df.drop("_keep").join(kept, "label", "left")

    def entries(place: int, k: int | None) -> Column:
        def choose(e: Column, slot: Column) -> Column:
            split = e["split"]
            run = e["seed"] if len(treatments) == 1 else (slot + place * len(seeds)).cast(kind)
            if k:
                last = F.col("_keep")[F.struct(e["seed"].alias("seed"), F.lit(k).alias("k"))]
                surplus = (split == "train") & (seeded_key(e["seed"], F.col("id"), SURPLUS) > last)
                split = F.when(F.coalesce(surplus, F.lit(False)), "dropped").otherwise(split)
            return F.struct(run.alias("seed"), split.alias("split"))

        return F.transform("assign", choose)

    parts = [entries(place, k) for place, k in enumerate(treatments)]
    return df.withColumn("assign", F.concat(*parts)).drop("_keep")


def undersample_report(train: DataFrame, k: int) -> DataFrame:
    """Per seed: majority class, its size, the target, and whether it can be met.

    Only two-class tables are rebalanced; a target above the class size keeps
    every row and is reported.
    """
    counts = train.groupBy("seed", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("seed").agg(
        F.max_by("label", F.struct("n", -F.col("label"))).alias("majority"),
        F.max("n").alias("n_majority"),
        (F.min("n") * k).alias("target"),
        F.count("*").alias("n_classes"),
    ).withColumn("reachable", (F.col("n_classes") == 2) & (F.col("target") <= F.col("n_majority")))


def undersample_cuts(train: DataFrame, ratios: list[int]) -> DataFrame:
    """``(seed, label, k, at)``: last key kept of each majority class that shrinks."""
    ranks = [
        undersample_report(train, k)
        .filter("reachable")
        .select("seed", F.col("majority").alias("label"), F.lit(k).alias("cut"), F.col("target").alias("rank"))
        for k in ratios
    ]
    ranks = pin_small(reduce(DataFrame.unionByName, ranks))
    keys = train.select("seed", "label", seeded_key(F.col("seed"), F.col("id"), SURPLUS).alias("_key"))
    cuts = rank_cuts(keys, ["seed", "label"], "_key", digest_bucket(F.col("_key"), digest_digits(train.count())), ranks)
    return cuts.withColumnRenamed("cut", "k")


def undersample(train: DataFrame, k: int) -> DataFrame:
    """Random undersampling of ``(seed, id, label, …)`` without replacement."""
    cuts = pin_small(undersample_cuts(train, [k]).drop("k"))
    key = seeded_key(F.col("seed"), F.col("id"), SURPLUS)
    return (
        train.join(cuts, ["seed", "label"], "left")
        .filter(F.col("at").isNull() | (key <= F.col("at")))
        .drop("at")
    )


def stratified_split(
    df: DataFrame, seeds: list[int], ratio: float = RATIO, undersample: int | None = None
) -> DataFrame:
    """One row per seed and document with its ``split``; dropped rows are left out."""
    df = assign_treatments(df, seeds, [undersample], ratio)
    keep = [c for c in df.columns if c != "assign"]
    return unnest_structs(df, keep, "assign").filter(F.col("split") != "dropped")


def given_split(frames: dict[str, DataFrame]) -> DataFrame:
    """Union of tables that are already split, named by their split."""
    from .clean import union_all

    return union_all([frame.withColumn("split", F.lit(name)) for name, frame in frames.items()])
