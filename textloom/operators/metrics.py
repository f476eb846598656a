"""Classification metrics from predictions ``(…, label, pred)``.

Each metric is one map-side combined aggregate over (key, label, pred); what
follows works on that tiny table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bounded import pin_small
from .ordering import place, row_position

EPSILON = 1e-7


def ratio(top: Column, bottom: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def f_beta(precision: Column, recall: Column, beta2: int) -> Column:
    return (1 + beta2) * precision * recall / (beta2 * precision + recall)


def f1_of(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def f2_of(precision: Column, recall: Column) -> Column:
    """Null for 0/0."""
    bottom = 4 * precision + recall
    return F.when(bottom != 0, 5 * precision * recall / bottom)


def label_pred_counts(preds: DataFrame, by: list[str]) -> DataFrame:
    return preds.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(preds: DataFrame, by: list[str]) -> DataFrame:
    """Every (label, pred) cell of the classes in labels or predictions, zeros included."""
    counts = label_pred_counts(preds, by)
    seen = counts.groupBy(*by).agg(
        F.array_sort(F.array_union(F.collect_set("label"), F.collect_set("pred"))).alias("_classes"),
        F.map_from_entries(F.collect_list(F.struct(F.struct("label", "pred"), "n"))).alias("_cells"),
    )
    cells = seen.withColumn("label", F.explode("_classes")).withColumn("pred", F.explode("_classes"))
    n = F.coalesce(F.col("_cells")[F.struct("label", "pred")], F.lit(0))
    return cells.select(*by, "label", "pred", n.alias("n"))


def confusion_cells(preds: DataFrame, by: list[str]) -> DataFrame:
    label, pred = F.col("label"), F.col("pred")
    return preds.groupBy(*by).agg(
        F.count_if((label == 0) & (pred == 0)).alias("tn"),
        F.count_if((label == 0) & (pred == 1)).alias("fp"),
        F.count_if((label == 1) & (pred == 0)).alias("fn"),
        F.count_if((label == 1) & (pred == 1)).alias("tp"),
    )


def hard_auc(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """ROC-AUC of 0/1 predictions; null when only one class occurs."""
    return F.when((tp + fn > 0) & (tn + fp > 0), (tp / (tp + fn) + tn / (tn + fp)) / 2)


def binary_report(preds: DataFrame, by: list[str]) -> DataFrame:
    """``accuracy, precision, recall, f1, f2, roc_auc`` of class 1."""
    cells = confusion_cells(preds, by)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    cells = cells.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    precision, recall = F.col("precision"), F.col("recall")
    return cells.select(
        *by,
        ((tp + tn) / (tn + fp + fn + tp)).alias("accuracy"),
        "precision",
        "recall",
        f1_of(precision, recall).alias("f1"),
        f2_of(precision, recall).alias("f2"),
        hard_auc(tn, fp, fn, tp).alias("roc_auc"),
    )


def per_class(preds: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each class in labels or predictions."""
    counts = label_pred_counts(preds, by)
    n, hit = F.col("n"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("class"), n.alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("pred").alias("class"), zero.alias("support"), n.alias("predicted"), zero.alias("tp")),
    )
    sums = counts.select(*by, F.inline(sides)).groupBy(*by, "class")
    sums = sums.agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return sums.select(
        *by,
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        f1_of(precision, recall).alias("f1"),
        "support",
        "tp",
    )


def macro_report(preds: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and class-averaged precision, recall, F1; F2 from the averages, no AUC."""
    averaged = per_class(preds, by).groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
    )
    return averaged.select(
        "*",
        f2_of(F.col("precision"), F.col("recall")).alias("f2"),
        F.lit(None).cast("double").alias("roc_auc"),
    )


def report(preds: DataFrame, by: list[str], n_classes: int) -> DataFrame:
    """Binary metrics for two classes, macro averages above."""
    return macro_report(preds, by) if n_classes > 2 else binary_report(preds, by)


def class_report(preds: DataFrame, by: list[str]) -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg`` and ``weighted avg``."""
    classes = per_class(preds, by)
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    weighted = [(F.sum(F.col(c) * F.col("support")) / total).alias(f"w_{c}") for c in names]
    summary = classes.groupBy(*by).agg(
        (F.sum("tp") / total).alias("accuracy"),
        total.alias("support"),
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *weighted,
    )
    nothing = F.lit(None).cast("double")

    def row(name: str, precision: Column, recall: Column, f1: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1")
        )

    rows = F.array(
        row("accuracy", nothing, nothing, F.col("accuracy")),
        row("macro avg", *[F.col(f"m_{c}") for c in names]),
        row("weighted avg", *[F.col(f"w_{c}") for c in names]),
    )
    totals = summary.select(*by, F.inline(rows), "support")
    return classes.select(*by, F.col("class").cast("string"), *names, "support").unionByName(totals)


def score_auc(preds: DataFrame, by: list[str]) -> DataFrame:
    """ROC-AUC of real-valued scores, ties counted half.

    Equal scores are added up first; running counts over the distinct scores
    come from a range-partitioned sort plus the sums of earlier partitions.
    """
    counts = preds.groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    placed = place(counts, [*by, "score"])
    parts = placed.groupBy(*by, "_part").agg(F.sum("neg").alias("_neg"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_part", F.coalesce(F.sum("_neg").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_base") + F.col("_lower")
    return (
        placed.withColumn("_lower", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
        .join(pin_small(parts), [*by, "_part"])
        .groupBy(*by)
        .agg(
            F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("_wins"),
            (F.sum("pos").cast("double") * F.sum("neg")).alias("_pairs"),
        )
        .select(*by, F.when(F.col("_pairs") > 0, F.col("_wins") / F.col("_pairs")).alias("auc"))
    )


def in_batches(df: DataFrame, size: int) -> DataFrame:
    """Adds ``batch``: consecutive groups of ``size`` rows in id order."""
    return row_position(df, "_pos").withColumn("batch", F.floor((F.col("_pos") - 1) / size)).drop("_pos")


def smoothed_batch_metrics(batched: DataFrame) -> DataFrame:
    """Per-batch recall, precision, F1, F2 with epsilon on both sides of each ratio.

    ``(batch, label, score)``; products are clipped to [0, 1] and rounded half to even.
    """
    step = lambda c: F.bround(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 0)
    label = F.col("label").cast("double")
    sums = batched.groupBy("batch").agg(
        F.sum(step(label * F.col("score"))).alias("tp"),
        F.sum(step(label)).alias("possible"),
        F.sum(step(F.col("score"))).alias("predicted"),
    )
    recall = (F.col("tp") + EPSILON) / (F.col("possible") + EPSILON)
    precision = (F.col("tp") + EPSILON) / (F.col("predicted") + EPSILON)
    rows = sums.select("batch", recall.alias("recall"), precision.alias("precision"))
    product = F.col("precision") * F.col("recall")
    return rows.select(
        "*",
        (2 * (product / (F.col("precision") + F.col("recall") + EPSILON))).alias("f1"),
        (5 * (product / (4 * F.col("precision") + F.col("recall") + EPSILON))).alias("f2"),
    )


def epoch_mean(per_batch: DataFrame) -> DataFrame:
    return per_batch.agg(*[F.avg(c).alias(c) for c in per_batch.columns if c != "batch"])


def cross_entropy(label: Column, probability: Column) -> Column:
    """Loss of one row from the probability of class 1."""
    return -F.log(F.when(label == 1, probability).otherwise(1 - probability))


def batch_loss(batched: DataFrame, loss: Column) -> DataFrame:
    """Mean over batches of each batch's mean loss."""
    per_batch = batched.groupBy("batch").agg(F.avg(loss).alias("loss"))
    return per_batch.agg(F.avg("loss").alias("loss"), F.count("*").alias("n_batches"))
