"""Where jobs keep checkpoints and intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share, or pass a folder")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and its lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    remove_folder(spark, df._written_path)


def _on_store(spark: SparkSession, path: str):
    """A path and the file system it lies in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def is_folder(spark: SparkSession, path: str) -> bool:
    place, store = _on_store(spark, path)
    return store.getFileStatus(place).isDirectory()


def remove_folder(spark: SparkSession, folder: str) -> None:
    place, store = _on_store(spark, folder)
    store.delete(place, True)
