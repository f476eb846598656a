"""Session for tests and bench, and the folder all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "textloom") -> SparkSession:
    """Local session for tests and bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEM", "12g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written tables that every executor can reach.

    Taken from ``spark.checkpoint.dir``. Only a local session without that
    setting gets a fresh temporary folder; on a cluster a missing setting is
    an error, since a machine-local folder would not survive a lost executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="textloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def import_in_workers(spark: SparkSession) -> None:
    """Let local Python workers import the package from where the driver has it.

    On a cluster the package is installed or sent with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has used."""
    unique = spark._jvm.java.util.UUID.randomUUID().toString()
    return f"{shared_dir(spark).rstrip('/')}/{name}-{unique}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write an intermediate result to the shared folder once and read it from there.

    For results that several later steps use: they are computed once, their
    lineage is cut, and a lost executor costs no recomputation. ``tidy``: the
    shuffle files behind it go with the write, not whenever the driver collects garbage.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    if tidy:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a kept result that nothing reads any more."""
    files = df.inputFiles()
    if files:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
