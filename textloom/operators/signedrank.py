"""Paired comparison of two methods over seeds: Wilcoxon signed-rank test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.05
EXACT_PAIRS = 50


def run_path() -> Column:
    """``model/method[/classifier]`` of a result row."""
    return F.concat_ws("/", "model", "method", "classifier")


def paired_runs(
    rows: DataFrame, metrics: list[str] | None = None, methods: list[str] | None = None
) -> DataFrame:
    """All method pairs of ``(method, seed, metric, value)``, joined by seed.

    To compare runs of several models or classifiers, let ``method`` be their path
    (``run_path``): a method must have one value per seed and metric.
    """
    if methods:
        rows = rows.filter(F.col("method").isin(methods))
    if metrics:
        rows = rows.filter(F.col("metric").isin(metrics))
    a = rows.select("seed", "metric", F.col("method").alias("method_a"), F.col("value").alias("a"))
    b = rows.select("seed", "metric", F.col("method").alias("method_b"), F.col("value").alias("b"))
    pairs = a.join(b, ["seed", "metric"]).filter(F.col("method_a") < F.col("method_b"))
    return pairs.withColumn("diff", F.round(F.col("a") - F.col("b"), 12))


PAIR = ["method_a", "method_b", "metric"]


def signed_ranks(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Average ranks of the sizes of nonzero differences.

    Equal sizes are counted first; their shared rank is the number of smaller
    ones plus the middle of their own.
    """
    sizes = pairs.filter(F.col("diff") != 0).withColumn("size", F.abs("diff"))
    groups = sizes.groupBy(*by, "size").agg(
        F.count("*").alias("n_tied"), F.count_if(F.col("diff") > 0).alias("n_plus")
    )
    smaller = Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("n_tied").over(smaller), F.lit(0)) + (F.col("n_tied") + 1) / 2
    return groups.withColumn("rank", rank)


def _exact_p(n: Column, w_plus: Column) -> Column:
    """Two-sided p from the number of rank subsets with each sum.

    The counts are the coefficients of the product of (1 + x^k), built up by
    adding a shifted copy of the array for each rank.
    """
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    counts = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")),
        F.array(F.lit(1.0)),
        lambda acc, k: F.zip_with(F.concat(acc, zeros(k)), F.concat(zeros(k), acc), lambda x, y: x + y),
    )
    at = F.floor(w_plus).cast("int")
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    less = add(F.slice("_counts", F.lit(1), at + 1))
    more = add(F.slice("_counts", at + 1, F.size("_counts")))
    middle = at == F.floor((F.size("_counts") - 1) / 2)
    return counts, F.when(middle, 1.0).otherwise(2 * F.least(less, more) / F.pow(F.lit(2.0), n))


def _normal_p(z: Column) -> Column:
    """Two-sided normal tail from the series of the distribution function.

    Beyond 8 standard deviations the tail is below double precision of one.
    """
    x = F.abs(z)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(200)),
        F.struct(x.alias("term"), x.alias("sum")),
        lambda acc, k: F.struct(
            (acc["term"] * x * x / (2 * k + 1)).alias("term"),
            (acc["sum"] + acc["term"] * x * x / (2 * k + 1)).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    density = F.exp(-x * x / 2) / F.sqrt(2 * F.pi())
    tail = 1 - 2 * density * series
    return F.when(x > 8, 0.0).when(tail < 0, 0.0).otherwise(tail)


def wilcoxon(pairs: DataFrame, by: list[str], alpha: float = ALPHA) -> DataFrame:
    """``(…, n, n_zero, w, p, significant)``.

    Zero differences are dropped. Up to 50 pairs without zeros use the exact
    distribution, others the normal one with a correction for ties. Pairs that
    do not differ at all have null results.
    """
    zeros = pairs.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("diff") == 0).alias("n_zero"))
    ranks = signed_ranks(pairs, by)
    tied = F.col("n_tied") * (F.col("n_tied") * F.col("n_tied") - 1)
    sums = ranks.groupBy(*by).agg(
        F.sum("n_tied").alias("n"),
        F.sum(F.col("rank") * F.col("n_plus")).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("n_tied") - F.col("n_plus"))).alias("w_minus"),
        F.sum(tied).alias("_ties"),
    )
    rows = zeros.join(sums, by, "left").withColumn("w", F.least("w_plus", "w_minus"))
    n = F.col("n")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_ties") / 2) / 24)
    rows = rows.withColumn("_z", (F.col("w") - n * (n + 1) / 4) / spread)
    exact = (F.col("n_pairs") <= EXACT_PAIRS) & (F.col("n_zero") == 0)
    counts, exact_p = _exact_p(n, F.col("w_plus"))
    rows = rows.withColumn("_counts", F.when(exact, counts))
    rows = rows.withColumn("p", F.when(exact, exact_p).otherwise(_normal_p(F.col("_z"))))
    return rows.select(
        *by,
        F.coalesce("n", F.lit(0)).alias("n"),
        "n_zero",
        "w",
        "p",
        (F.col("p") < alpha).alias("significant"),
    )
