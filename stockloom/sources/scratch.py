"""Intermediate tables written to the cluster's shared folder.

Writing a table cuts its lineage in a way that outlives lost executors, lets the
next step read only the columns it needs, and gives the planner a measured size:
whether a join broadcasts the table is then Spark's own decision, by
``spark.sql.autoBroadcastJoinThreshold``, on a size that has been seen.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints.

    Only a local session without the setting gets a folder of its own, which is
    removed when Python ends. On a cluster the setting is required, because a
    machine's temporary folder is not seen by the other machines.
    """
    context = spark.sparkContext
    named = spark.conf.get(_SETTING, None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    folder = _local_folders.get(context.applicationId)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="stockloom-")
        _local_folders[context.applicationId] = folder
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def enable_checkpoints(spark: SparkSession) -> None:
    """Let the iterative estimators checkpoint, in the same folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables this session has written.

    They are as large as the data they hold. Call this when the reports are
    written: results that were not are built on these tables and end with them.
    """
    configuration = spark._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(configuration).delete(folder, True)


def discard(kept: DataFrame) -> None:
    """Delete what ``keep`` has written and nothing reads any more, before ``release`` does."""
    spark = kept.sparkSession
    written = _written.get(spark.sparkContext.applicationId, [])
    folders = {file.rsplit("/", 1)[0] for file in kept.inputFiles()}
    for path in [path for path in written if any(folder.endswith(path) for folder in folders)]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        written.remove(path)


def keep(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table once and go on with what was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Write several independent tables at the same time."""
    with ThreadPoolExecutor(max_workers=max(1, len(tables))) as pool:
        jobs = {name: pool.submit(keep, df, name) for name, df in tables.items()}
        return {name: job.result() for name, job in jobs.items()}
