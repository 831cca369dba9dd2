"""Joins whose key may be hot on one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: Rows of a key beyond which it is split, and the most keys that are; no other key holds more than 1 / HOT_KEYS of all rows.
SLICE_ROWS, HOT_KEYS = 4096, 1024
#: Rows that a task gets of a table dealt by its keys.
TASK_ROWS = 2**18


def salted_join(
    many: DataFrame, few: DataFrame, keys: list[str], spread_by: Column, salts: int = SALTS, how: str = "inner"
) -> DataFrame:
    """Equi-join with the ``many`` side of each key spread over ``salts`` slices.

    ``few`` holds few rows per key and repeats once per slice. The rows are
    those of the plain join (inner, left or left_semi from ``many``). Nothing is
    forced to broadcast: Spark does so only where the size it knows allows it.
    """
    spread = many.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def hot_keys(many: DataFrame, keys: list[str], slice_rows: int = SLICE_ROWS, most: int = HOT_KEYS) -> DataFrame:
    """(keys, _slices) of the keys with the most rows: at most ``most`` of them, each with over ``slice_rows`` rows."""
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > slice_rows)
    return counts.orderBy(F.desc("_n"), *keys).limit(most).select(*keys, F.ceil(F.col("_n") / slice_rows).cast("int").alias("_slices"))


def counted_keys(many: DataFrame, keys: list[str]) -> tuple[int, int]:
    """All rows, and those of the key that has most. Counted at once, as plans depend on it."""
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
    return counts[0] or 0, counts[1] or 0


def dealt_by(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` of so many rows dealt out by its keys, about TASK_ROWS to a task at most however large it is.

    What follows per key needs no other exchange, and as rows may be exploded and sorted there, their number counts, not
    their size in the files of the exchange.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(parts, *keys)


def even_join(
    many: DataFrame, few: DataFrame, keys: list[str], spread_by: Column, how: str = "inner",
    slice_rows: int = SLICE_ROWS, counted: DataFrame | None = None,
) -> DataFrame:
    """The plain join, which leaves rows where they are dealt by their keys; ``hot_join`` if a key has more than ``slice_rows`` rows."""
    if counted_keys(many if counted is None else counted, keys)[1] > slice_rows:
        return hot_join(many, few, keys, spread_by, how, slice_rows, counted=counted)
    return many.join(few, keys, how)


def hot_join(
    many: DataFrame, few: DataFrame, keys: list[str], spread_by: Column, how: str = "inner",
    slice_rows: int = SLICE_ROWS, most: int = HOT_KEYS, counted: DataFrame | None = None,
) -> DataFrame:
    """Equi-join whose hot keys, and only they, are spread over slices by their share of ``many``.

    The rows of ``few`` repeat once per slice of a hot key; those of cold keys stay single. The list of hot keys has
    ``most`` rows at most, so it may go to all tasks. Rows are those of the plain join (inner, left or left_semi);
    rows of ``many`` without a key are spread, too. Keys are counted in ``counted``, a table with the keys of ``many``
    that is cheaper to read, or in ``many``.
    """
    hot = F.broadcast(hot_keys(many if counted is None else counted, keys, slice_rows, most))
    spread = F.xxhash64(spread_by)
    nameless = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    slice_of = F.when(nameless, F.pmod(spread, F.lit(4096))).otherwise(F.coalesce(F.pmod(spread, F.col("_slices")), F.lit(0)))
    dealt = many.join(hot, keys, "left").withColumn("_slice", slice_of.cast("int")).drop("_slices")
    slices = F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1)
    copies = few.join(hot, keys, "left").withColumn("_slice", F.explode(slices)).drop("_slices")
    return dealt.join(copies, [*keys, "_slice"], how).drop("_slice")
