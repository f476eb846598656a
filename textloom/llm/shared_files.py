"""Files that tasks write to the folder all executors share, and workers that can import this package."""

from __future__ import annotations

import os

from pyarrow import fs
from pyspark.sql import SparkSession

from ..session import scratch_path


def ready(spark: SparkSession) -> None:
    """Let local Python workers import the package from where the driver has it.

    On a cluster the package is installed or sent with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, made by the driver."""
    folder = scratch_path(spark, name)
    where, path = place(folder)
    where.create_dir(path, recursive=True)
    return folder


def tasks_for(spark: SparkSession, pieces: int) -> int:
    """Tasks that read so many pieces of files: one for each, up to some for each core.

    A list of files is a few kB, which Spark would give to one task.
    """
    return max(1, min(pieces, 16 * spark.sparkContext.defaultParallelism))


def fewer_tasks(spark: SparkSession, tasks: int) -> int:
    """Tasks for work that begins with a table to fill: a quarter of as many, but two for each core.

    Every task of the tokenizers learns its words anew, some seconds whatever its input.
    """
    return max(1, min(tasks, max(2 * spark.sparkContext.defaultParallelism, tasks // 4)))


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of an absolute path."""
    return fs.FileSystem.from_uri(uri.replace("file:///", "/", 1) if uri.startswith("file:///") else uri)
