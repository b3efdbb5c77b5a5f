"""Where plans cut their lineage: tables in the folder all executors share.

A table of a session lies in a folder of that session's own, which is removed
at its end, or earlier by clear().
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; local sessions without one get a
    temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or _folders.get("local")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _folders["local"] = tempfile.mkdtemp(prefix="quarry-checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def session_folder(spark: SparkSession) -> str:
    """The folder of this session's intermediate tables."""
    name = spark.sparkContext.applicationId
    if name not in _folders:
        _folders[name] = f"{shared_folder(spark)}/quarry-{name}"
        atexit.register(clear, spark)
    return _folders[name]


def clear(spark: SparkSession) -> None:
    """Removes the session's intermediate tables; none of them may be read later."""
    try:
        folder = _folders.pop(spark.sparkContext.applicationId, None)
        if folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def checkpointed(df: DataFrame, **options: str) -> DataFrame:
    """df, written to the shared folder and read from there: later plans start
    from files that outlive any executor, and know their size."""
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that checkpointed has written and nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has the driver collect plans that nothing refers to any more, upon which
    Spark removes their shuffle files; they'd stay until memory runs short."""
    spark._jvm.System.gc()
