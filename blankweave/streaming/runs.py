"""Running a stream over what is there, to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blankweave.sources.paths import fresh_path, is_folder, remove_folder
from blankweave.streaming.keyed import KeyedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables as a file stream with the schema of its files; a table is one file or a folder of part files."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # A stream reads folders only: the folder of the table, or the one that its file lies in and of that the file alone.
    return reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream to its end into a table in the shared folder."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    query = (
        stream.writeStream.format("parquet").option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    remove_folder(spark, f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def run_keyed(stream: DataFrame, name: str, keys: list[str], rows_of=lambda batch: batch, mode: str = "update") -> KeyedTable:
    """Run a stream to its end into a table of current values: each batch writes the keys it changed.

    ``rows_of`` makes at most one row per key of a micro-batch.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    table = KeyedTable(spark, f"{path}/table", keys)
    query = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: table.upsert(rows_of(batch), batch_id))
        .option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    remove_folder(spark, f"{path}/checkpoint")
    return table
