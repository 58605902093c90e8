"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "imgcurate", cores: int | str = "*") -> SparkSession:
    """A session for tests and benches. On a cluster, bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for data that must outlive an executor.

    ``spark.checkpoint.dir`` names it. Only a local session may do without; a
    cluster whose executors cannot see one common folder is refused.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


#: The folder of each application, and those of the scopes that are open, innermost last.
_FOLDERS: dict[str, str] = {}
_SCOPES: list[str] = []


def _application_folder(spark: SparkSession) -> str:
    """A folder in the shared one that is deleted when the application ends."""
    key = spark.sparkContext.applicationId
    if key not in _FOLDERS:
        folder = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        system, known = file_system(spark, folder)
        system.mkdirs(known)
        system.deleteOnExit(known)
        _FOLDERS[key] = folder
    return _FOLDERS[key]


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """A run, at whose end all tables in the shared folder that were made in it are deleted.

    Read or write its results inside. Without a scope, tables stay to the end of the application.
    """
    folder = f"{_application_folder(spark)}/run-{uuid.uuid4().hex}"
    _SCOPES.append(folder)
    try:
        yield folder
    finally:
        _SCOPES.remove(folder)
        delete_path(spark, folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses, deleted at the end of its scope or application."""
    return f"{_SCOPES[-1] if _SCOPES else _application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    known = jvm.org.apache.hadoop.fs.Path(path)
    return known.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), known


def path_exists(spark: SparkSession, path: str) -> bool:
    system, known = file_system(spark, path)
    return system.exists(known)


def delete_path(spark: SparkSession, path: str) -> None:
    system, known = file_system(spark, path)
    system.delete(known, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Unlike a checkpoint its size is known to the planner, which can then choose to
    broadcast it or not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
