"""The given tables as inputs of the study operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(scan: DataFrame, by: str) -> DataFrame:
    """Use every core on a table file that comes in fewer splits than there are cores.

    Takes a bare scan, whose splits are known without running anything. Tables
    of many files or row groups, as on a cluster, pass unchanged.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, by) if scan.rdd.getNumPartitions() < cores else scan


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("project")
    )
    return spread(scan, "id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry a label: ``(id, text, label, project, lang)``."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("label")
    )
    return documents(spark, sf_dir).join(labels, "id")
