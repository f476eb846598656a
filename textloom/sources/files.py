"""Flat datasets: CSV with quoted line breaks, JSON arrays, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.bounded import pin_small
from ..operators.clean import union_all

_QUOTING = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV whose quoted fields hold line breaks and doubled quotes.

    Columns are taken by the header's names, in any order; columns that the schema
    doesn't name are left out, a missing one is an error, and a value that isn't of
    its type is null. All files of one path share a header. Such a file cannot be
    split; give it as many files, or convert it once with ``write_dataset``.
    """
    return _by_name(spark, path, schema, [])


def _by_name(spark: SparkSession, path: str, schema: StructType, more: list) -> DataFrame:
    rows = spark.read.csv(path, multiLine=True, **_QUOTING)
    named = [F.col(f"`{field.name}`").try_cast(field.dataType).alias(field.name) for field in schema]
    return rows.select(*named, *more)


def write_csv(df: DataFrame, path: str) -> None:
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").csv(path, quoteAll=True, emptyValue="", **keep, **_QUOTING)


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files that each hold one JSON array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_labelled_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON array with ``func`` and ``target`` as flat ``(func, vul)`` rows."""
    return read_json_array(spark, path, schema).select("func", F.col("target").alias("vul"))


def read_by_label(spark: SparkSession, paths: dict[int, str], schema: StructType) -> DataFrame:
    """One JSON source per class: each gets its label, then they are united."""
    return union_all(
        [read_json_array(spark, p, schema).withColumn("target", F.lit(label)) for label, p in paths.items()]
    )


def concat_csv(spark: SparkSession, paths: dict[str, str], schema: StructType) -> DataFrame:
    """Several CSV sources as one table.

    ``split_file`` names the source and ``file_no`` its place in the list;
    ``file_path`` is the row's file, and ``file_pos`` grows with its place there.
    """
    frames = []
    for number, (name, path) in enumerate(paths.items()):
        place = [F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("file_pos")]
        frame = _by_name(spark, path, schema, place)
        frames.append(frame.withColumn("split_file", F.lit(name)).withColumn("file_no", F.lit(number)))
    return union_all(frames)


def with_ids(rows: DataFrame) -> DataFrame:
    """Adds ``id``: 0, 1, … in the order of sources, of file names, and of rows in a file.

    Takes a table of ``concat_csv`` before any filter. A file is read by one task, so
    its positions have no gaps; only a count per file is aggregated, no text moves.
    """
    key = ["file_no", "file_path"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.min("file_pos").alias("_first"))
    earlier = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*key, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return (
        rows.join(pin_small(bases), key)
        .withColumn("id", F.col("_base") + F.col("file_pos") - F.col("_first"))
        .drop("_base", "_first")
    )


def write_dataset(df: DataFrame, path: str) -> None:
    """The flat dataset as splittable, column-pruned Parquet."""
    df.write.mode("overwrite").parquet(path)
