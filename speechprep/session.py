"""The shared folder for written tables, and a local session for tests and bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "speechprep") -> SparkSession:
    parallel = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; our own only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="speechprep-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def settled(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back; ``compression`` as Spark's writer has it.

    Its rows are then fixed, and its size is known when a join is planned: Spark
    broadcasts it below ``spark.sql.autoBroadcastJoinThreshold`` and joins by
    shuffle above. Before that it would have to guess, and would move the large
    side for a small table.
    """
    path = new_table_path(df.sparkSession, name)
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixed_blocks(spark: SparkSession) -> SparkSession:
    """A session like this one, whose readers cut files into the same blocks in all jobs.

    Spark cuts them anew in each job, by the settings and the cores there are then; a reader asks the session it was made in.
    """
    fixed = spark.newSession()
    settings = spark.conf.getAll
    for key, value in settings.items():
        if not key.startswith("spark.") or spark.conf.isModifiable(key):
            fixed.conf.set(key, value)
    if "spark.sql.files.minPartitionNum" not in settings:
        parts = settings.get("spark.sql.leafNodeDefaultParallelism", str(spark.sparkContext.defaultParallelism))
        fixed.conf.set("spark.sql.files.minPartitionNum", parts)
    return fixed


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/speechprep/{name}-{uuid.uuid4().hex}"
