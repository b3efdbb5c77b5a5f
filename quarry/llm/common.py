"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in
    local runs, where that is unset, a temporary folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_remove, found.removeprefix("file://"))
    # a path without a scheme is one of the default file system, as Spark itself takes it
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", found).rstrip("/")


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine find the package where the driver
    has found it; on a cluster it is installed or sent with --py-files."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new path of its own below the shared folder."""
    return f"{shared_dir(spark)}/quarry-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df below the shared folder and reads it again: later plans start
    from files that outlive any executor."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes tables that materialize has written and nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column can clash or be read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def crc_fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of an id's decimal text, modulo folds; null ids fall in no fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % folds


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def vocabulary(name: str) -> str:
    """A tokenizer file: a path as it is, or the name of an installed one."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
