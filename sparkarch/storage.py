"""Where intermediate results are stored: the folder of ``spark.checkpoint.dir``, which all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one on a local master and an error on a cluster."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sparkarch-")
        atexit.register(shutil.rmtree, folder, True)
        folder = f"file://{folder}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` stored once in the shared folder, without its lineage; the files go when nothing refers to them any more."""
    shared_dir(df.sparkSession)
    # read when a checkpoint is written, so it may be set on a running context
    df.sparkSession.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on any file system that Spark knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is left there goes when the Python driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended: the folder's owner clears it
            pass

    atexit.register(drop)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` as compressed Parquet in the shared folder: a fraction of a checkpoint's size, kept until the Python driver ends."""
    path = new_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
