"""Session settings the library is tuned for."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

# Static advice, applied only where the caller has not set the key already.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Files of up to 10 MB travel to Python in batches of bounded size; streams keep their state on disk.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    # Spark 4.1.2 takes a union of two inputs that are clustered alike for clustered, but adaptive execution may coalesce
    # the partitions of each in its own way; a grouping on top then returns a key twice.
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "blankweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword settings win (dots as ``__``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULTS, **{key.replace("__", "."): value for key, value in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return share_package(builder.getOrCreate())


def share_package(spark: SparkSession) -> SparkSession:
    """Python workers find this package where the driver has it, whatever folder the driver was started in.

    That serves local sessions and clusters whose machines share the folder; elsewhere install the wheel on the
    executors or pass it with ``--py-files``.
    """
    folder, known = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment.get("PYTHONPATH", "")
    if folder not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{folder}:{known}".rstrip(":")
    # Decides results, so it holds in sessions that others have built, too.
    spark.conf.set("spark.sql.unionOutputPartitioning", DEFAULTS["spark.sql.unionOutputPartitioning"])
    return spark
