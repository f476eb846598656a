"""The store of metrics, averages and epoch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EPOCH_LOG, METRICS_CSV

RUN = ["model", "method", "classifier", "seed"]


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One partition per run; a repeated run replaces only its own partition."""
    (
        metrics.repartition(*RUN)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*RUN)
        .parquet(path)
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("seed", F.col("seed").cast("int"))


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """The same as a tree of CSV files, folders named by run."""
    (
        metrics.repartition(*RUN)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*RUN)
        .csv(path, header=True)
    )


def write_average_csv(averages: DataFrame, path: str) -> None:
    """One file per model and method, apart from the runs: ``avg.csv/model=…/method=…``."""
    averages.coalesce(1).write.mode("overwrite").partitionBy("model", "method").csv(f"{path.rstrip('/')}/avg.csv", header=True)


def read_average_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{name} DOUBLE" for name in METRICS_CSV.fieldNames())
    rows = spark.read.schema(f"{schema}, n_files LONG, model STRING, method STRING")
    return rows.csv(f"{path.rstrip('/')}/avg.csv", header=True)


def read_metrics_tree(spark: SparkSession, path: str) -> DataFrame:
    """Every metrics CSV below ``path`` except averages, with its run taken from the folders.

    Folders are either plain ``model/method[/classifier]/seed`` or ``key=value``.
    """
    root = path.rstrip("/").split(":")[-1].lstrip("/")
    rows = (
        spark.read.schema(METRICS_CSV)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(path, header=True)
        .select("*", F.col("_metadata.file_path").alias("file"))
        .filter(~F.col("file").contains("/avg.csv"))
    )
    below = F.substring_index(F.col("file"), root + "/", -1)
    folders = F.transform(
        F.slice(F.split(below, "/"), 1, F.size(F.split(below, "/")) - 1),
        lambda part: F.substring_index(part, "=", -1),
    )
    rows = rows.withColumn("_folders", folders)
    return rows.select(
        F.get("_folders", 0).alias("model"),
        F.get("_folders", 1).alias("method"),
        F.when(F.size("_folders") > 3, F.get("_folders", 2)).alias("classifier"),
        F.element_at("_folders", -1).cast("int").alias("seed"),
        *METRICS_CSV.fieldNames(),
        "file",
    )


def append_epochs(log: DataFrame, path: str) -> None:
    log.select(*EPOCH_LOG.fieldNames()).write.mode("append").parquet(path)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EPOCH_LOG).parquet(path)
