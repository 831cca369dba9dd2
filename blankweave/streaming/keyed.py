"""A table of current values that micro-batches update by key.

Each batch writes only the rows whose keys changed, into a folder of its own that a rerun
overwrites, parted by a hash bucket of the key. A reader takes the last batch of each key, and
who wants some keys only reads their buckets. ``compact`` folds old batches into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blankweave.sources.paths import remove_folder

BUCKETS = 64


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def _bucket(self) -> Column:
        # By the first key alone, so that all rows of it lie together.
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, batch: int, run: int) -> None:
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/_batch={batch}/_run={run}")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: at most one row per key of the batch."""
        self._write(batch, batch_id, 0)

    def _rows(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/_batch=*")

    def _last(self, rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in (*self.keys, "_batch", "_run", "_bucket")]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), F.struct("_batch", "_run")).alias("_v"))
        return last.select(*self.keys, *[F.col("_v")[c].alias(c) for c in values])

    def current(self) -> DataFrame:
        return self._last(self._rows())

    def current_of(self, wanted: DataFrame, by: list[str] | None = None) -> DataFrame:
        """The current rows of the keys in ``wanted``, or of what it has of them (``by``, the first key at least); only
        their buckets are read."""
        by = by or self.keys
        keys = wanted.select(*by).distinct()
        # At most ``buckets`` numbers.
        own = [r["b"] for r in keys.select(self._bucket().alias("b")).distinct().collect()]
        return self._last(self._rows().where(F.col("_bucket").isin(own)).join(keys, by, "left_semi"))

    def compact(self, upto: int) -> None:
        """Batches 0 to ``upto`` as one. The merged rows come last of all they replace, so a stop in between loses nothing."""
        rows = self._rows()
        old = sorted({(r["_batch"], r["_run"]) for r in rows.select("_batch", "_run").distinct().collect() if r["_batch"] <= upto})
        self._write(self._last(rows.where(F.col("_batch") <= upto)), upto, max([run for batch, run in old if batch == upto], default=0) + 1)
        for batch, run in old:
            remove_folder(self.spark, f"{self.path}/_batch={batch}/_run={run}")
