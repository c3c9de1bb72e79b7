"""Session settings and the shared scratch folder.

Anything written between two stages of a job (checkpoints, table versions,
landing folders of a streaming run) goes below one folder that every executor
can reach: the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Of a key given twice in a JSON object the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app_name: str = "lotwatch", **extra: str) -> SparkSession:
    """Session with the settings the operators are tested under.

    ``extra`` takes further settings with dots written as double underscores,
    for example ``spark__master="local[8]"``.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> str:
    """Give this package to the executors of a cluster where it is not installed.

    The archive is made in a temporary folder of the driver, which Spark serves
    to every executor.  Functions that run in Python workers are found in it.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lotwatch-"), "lotwatch"), "zip", root, "lotwatch")
    spark.sparkContext.addPyFile(archive)
    return archive


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    Read from ``spark.checkpoint.dir``.  Only a local-mode session, where the
    driver's disk is every executor's disk, falls back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="lotwatch-")
    return _local_folders[context.applicationId]


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from reliable checkpoint files."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is below it; one that does not exist is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, purpose: str = "stage", below: str | None = None, **options: str | int) -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared folder and read it from there.

    For frames that several passes need: the passes become column scans instead
    of repeating the joins and shuffles behind the frame.  With ``below`` it
    lies in that folder, so that its owner can delete it.  ``options`` are the
    writer's.
    """
    path = f"{below}/{purpose}" if below else fresh_folder(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
