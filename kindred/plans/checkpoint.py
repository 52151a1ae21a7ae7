"""Lineage cuts in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to spark.checkpoint.dir and read from there; in local mode a folder of our own where none is set."""
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in that folder, for loops: unlike a checkpoint it carries neither constraints nor sizes of the plan it
    came from, which grow from step to step, and :func:`forget` deletes it."""
    path = f"{_folder(df.sparkSession)}/kindred-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kindred_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a written table once nothing that is still to run reads it."""
    _remove(df.sparkSession, df._kindred_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  at exit the JVM may be gone already
        pass


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="kindred-checkpoint-"))
    return sc.getCheckpointDir()
