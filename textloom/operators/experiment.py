"""Runs of a study: epoch logs, metric averages, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import METRIC_NAMES

SPAN = 1024


def _running(df: DataFrame, value, name: str, inclusive: bool) -> DataFrame:
    """Running maximum of ``value`` over the epochs of a run.

    Epochs are cut into spans of 1024; a maximum over earlier spans joins one
    inside the span, so a run of any length is spread over tasks.
    """
    df = df.withColumn("_value", value).withColumn("_span", F.floor(F.col("epoch") / SPAN))
    spans = df.groupBy("run", "_span").agg(F.max("_value").alias("_top"))
    earlier = Window.partitionBy("run").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("run", "_span", F.max("_top").over(earlier).alias("_base"))
    last = 0 if inclusive else -1
    inside = Window.partitionBy("run", "_span").orderBy("epoch").rowsBetween(Window.unboundedPreceding, last)
    return (
        df.withColumn("_inner", F.max("_value").over(inside))
        .join(spans, ["run", "_span"])
        .withColumn(name, F.greatest("_base", "_inner"))
        .drop("_value", "_span", "_base", "_inner")
    )


def early_stopping(log: DataFrame, patience: int) -> DataFrame:
    """Per epoch: best score before it, whether it improved, epochs without improvement.

    Every score improves on a missing one, as the first epoch does.
    """
    seen = _running(log.select("run", "epoch", "val_f1"), F.col("val_f1"), "best_before", inclusive=False)
    improved = F.col("best_before").isNull() | (F.col("val_f1") > F.col("best_before"))
    seen = seen.withColumn("improved", improved)
    seen = _running(seen, F.when(F.col("improved"), F.col("epoch")), "last_improved", inclusive=True)
    return seen.withColumn("waited", F.col("epoch") - F.col("last_improved")).withColumn(
        "stops", F.col("waited") >= patience
    )


def stop_and_best(log: DataFrame, patience: int) -> DataFrame:
    """Per run: stop epoch (null without a stop), last epoch run, best epoch and score.

    The best epoch up to the stop is the last one that improved, which the
    replay carries on the stopping row, or on the last row without a stop.
    """
    best = F.greatest("best_before", "val_f1")
    state = F.struct("epoch", F.col("last_improved").alias("best"), best.alias("score"))
    ends = early_stopping(log, patience).groupBy("run")
    ends = ends.agg(F.min(F.when(F.col("stops"), state)).alias("s"), F.max(state).alias("e"))
    end = F.coalesce("s", "e")
    return ends.select(
        "run",
        F.col("s.epoch").alias("stop_epoch"),
        end["epoch"].alias("last_epoch"),
        end["best"].alias("best_epoch"),
        end["score"].alias("best_val_f1"),
    )


def best_epoch(log: DataFrame) -> DataFrame:
    """First epoch with the greatest validation score of each run, without a window."""
    return log.groupBy("run").agg(
        F.max_by("epoch", F.struct("val_f1", -F.col("epoch"))).alias("best_epoch"),
        F.max("val_f1").alias("best_val_f1"),
    )


def curves(log: DataFrame) -> DataFrame:
    """Train and validation curves in long form: ``(run, epoch, curve, value)``."""
    return log.unpivot(["run", "epoch"], ["loss", "f1", "val_loss", "val_f1"], "curve", "value")


def metric_rows(metrics: DataFrame, ids: list[str]) -> DataFrame:
    """Metric columns as rows ``(…, metric, value)``."""
    return metrics.unpivot(ids, METRIC_NAMES, "metric", "value")


def metric_map(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Rows ``(…, metric, value)`` as one map per run."""
    entries = F.collect_list(F.struct("metric", "value"))
    return rows.groupBy(*ids).agg(F.map_from_entries(entries).alias("metrics"))


def average_metrics(metrics: DataFrame, by: list[str], file: str) -> DataFrame:
    """Sum of each metric over the number of files it came from."""
    return metrics.groupBy(*by).agg(
        *[(F.sum(m) / F.count_distinct(file)).alias(m) for m in METRIC_NAMES],
        F.count_distinct(file).alias("n_files"),
    )


def describe(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Count, mean, sample deviation, extremes and linear quartiles of runs."""
    x = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.percentile(x, 0.25).alias("q25"),
        F.percentile(x, 0.5).alias("q50"),
        F.percentile(x, 0.75).alias("q75"),
        F.max(x).alias("max"),
        F.round(F.avg(x), 6).alias("mean_rounded"),
    )
