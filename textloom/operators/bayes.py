"""Gaussian naive Bayes on sparse weights, all seeds in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dense
from ..functions.rows import unnest_structs
from .bounded import pin_small

SMOOTHING = 1e-9


def fit_bayes(weighed: DataFrame, terms: DataFrame) -> DataFrame:
    """``(seed, model)`` with one entry per class: base score and two arrays over terms.

    Sums of x and x squared per (seed, class, term) combine map-side; absent
    terms are the zeros implied by the class size.
    """
    train = weighed.filter(F.col("split") == "train")
    sizes = train.groupBy("seed", "label").agg(F.count("*").alias("n"))
    weight = F.col("weight")
    sums = (
        unnest_structs(train, ["seed", "label"], "features")
        .groupBy("seed", "label", "idx")
        .agg(F.sum(weight).alias("s1"), F.sum(weight * weight).alias("s2"))
    )
    grid = sizes.join(terms.select("seed", "idx"), "seed").join(sums, ["seed", "label", "idx"], "left")
    grid = grid.fillna(0.0, ["s1", "s2"])

    whole = Window.partitionBy("seed", "idx")
    rows, total, squares = (F.sum(c).over(whole) for c in ("n", "s1", "s2"))
    grid = grid.withColumn("_var", squares / rows - (total / rows) * (total / rows))
    floor = F.max("_var").over(Window.partitionBy("seed")) * SMOOTHING
    mean = F.col("s1") / F.col("n")
    grid = grid.withColumn("mean", mean).withColumn("var", F.col("s2") / F.col("n") - mean * mean + floor)

    at_zero = -0.5 * (F.log(2 * F.pi() * F.col("var")) + F.col("mean") * F.col("mean") / F.col("var"))
    a, b = F.col("mean") / F.col("var"), 0.5 / F.col("var")
    entries = F.sort_array(F.collect_list(F.struct("idx", a.alias("a"), b.alias("b"))))
    per_class = grid.groupBy("seed", "label", "n").agg(F.sum(at_zero).alias("zero"), entries.alias("e"))
    prior = F.log(F.col("n") / F.sum("n").over(Window.partitionBy("seed")))
    per_class = per_class.select(
        "seed",
        F.struct(
            F.col("label"),
            (prior + F.col("zero")).alias("base"),
            dense(F.col("e"), "a").alias("a"),
            dense(F.col("e"), "b").alias("b"),
        ).alias("c"),
    )
    return pin_small(per_class.groupBy("seed").agg(F.sort_array(F.collect_list("c")).alias("model")))


def predict_bayes(weighed: DataFrame, model: DataFrame) -> DataFrame:
    """``(seed, id, split, label, pred)``: scores are sums over a row's own terms."""

    def score(c: Column) -> Column:
        seen = F.aggregate(
            "features",
            F.lit(0.0),
            lambda acc, p: acc
            + p["weight"] * (F.get(c["a"], p["idx"]) - p["weight"] * F.get(c["b"], p["idx"])),
        )
        return F.struct((c["base"] + seen).alias("score"), (-c["label"]).alias("order"))

    best = F.array_max(F.transform("model", score))
    return weighed.join(model, "seed").select(
        "seed", "id", "split", "label", (-best["order"]).cast("int").alias("pred")
    )
