"""Ordered computations over keys that may hold any share of all rows.

A plain window puts all rows of a key into one task. Where some key has too many
for that, the leading order columns that the caller names are a band: rows are
aggregated per (key, band) with map-side combine, the small band table is scanned
per key, and its result comes back by an equi-join on (key, band). The remaining
window is per (key, band). Where no key has, ``numbered`` and ``running_total``
need the plain window alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blankweave.operators.skew import SLICE_ROWS, counted_keys, dealt_by


def with_op_index(edits: DataFrame) -> DataFrame:
    """Edits with their place in the request, ``op_index``; without one all count as simultaneous."""
    return edits if "op_index" in edits.columns else edits.withColumn("op_index", F.lit(0).cast("bigint"))


def by_op_index(edits: Column) -> Column:
    """An array of structs in the order of ``op_index``; the structs may hold maps, which have no order of their own."""
    return F.array_sort(
        edits, lambda a, b: F.when(a["op_index"] < b["op_index"], -1).when(a["op_index"] > b["op_index"], 1).otherwise(0)
    )


def _whole(columns: list[str]) -> Column:
    """Every one of the columns has a value."""
    return ~F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False))


def numbered(
    df: DataFrame, keys: list[str], band: list[str], order: list[str], name: str,
    slice_rows: int = SLICE_ROWS, counted: DataFrame | None = None,
) -> DataFrame:
    """Exact 1-based row number per key; ``order`` has to start with the band order. Rows without a key or band count but go.

    Keys are counted in ``df``, whose rows are then dealt out by them, or in ``counted``: a table that holds the rows of ``df``
    and others, is cheaper to read, and was dealt by its keys, as ``df`` then is.
    """
    df = df.where(_whole(keys))
    rows, most = counted_keys(df if counted is None else counted.where(_whole(keys)), keys)
    if most <= slice_rows:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        return (dealt_by(df, keys, rows) if counted is None else df).withColumn(name, place.cast("bigint")).where(_whole(band))
    sizes = df.groupBy(*keys, *band).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy(*band).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, *band, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    local = F.row_number().over(W.partitionBy(*keys, *band).orderBy(*order))
    return (
        df.join(starts, [*keys, *band])
        .withColumn(name, (F.col("_skip") + local).cast("bigint"))
        .drop("_skip")
    )


def running_total(
    df: DataFrame, keys: list[str], band: Column, order: list[str], value: Column, name: str,
    slice_rows: int = SLICE_ROWS, counted: DataFrame | None = None,
) -> DataFrame:
    """Exact sum of ``value`` over the rows before each row of a key; ``band`` has to rise with the order.

    Rows without a key or band count but go. Keys are counted in ``counted``, a table with those of ``df`` that is cheaper
    to read, or in ``df``.
    """
    banded = df.withColumn("_band", band).withColumn("_value", value).where(_whole(keys))
    if counted_keys(df if counted is None else counted, keys)[1] <= slice_rows:
        earlier = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        total = F.coalesce(F.sum("_value").over(earlier), F.lit(0)).cast("bigint")
        return banded.withColumn(name, total).where(_whole(["_band"])).drop("_band", "_value")
    sums = banded.groupBy(*keys, "_band").agg(F.sum("_value").alias("_s"))
    earlier = W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, "_band", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_skip"))
    local = F.sum("_value").over(W.partitionBy(*keys, "_band").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    total = (F.col("_skip") + F.coalesce(local, F.lit(0))).cast("bigint")
    return banded.join(starts, [*keys, "_band"]).withColumn(name, total).drop("_skip", "_band", "_value")


def previous_value(
    df: DataFrame, keys: list[str], band: str, order: list[str], value: Column, name: str
) -> DataFrame:
    """Last non-NULL ``value`` strictly before each row of a key."""
    marked = df.withColumn("_v", value)
    ends = marked.where("_v IS NOT NULL").groupBy(*keys, band).agg(
        F.max_by("_v", F.struct(*order)).alias("_end")
    )
    bands = marked.select(*keys, band).distinct().join(ends, [*keys, band], "left")
    earlier = W.partitionBy(*keys).orderBy(band).rowsBetween(W.unboundedPreceding, -1)
    starts = bands.select(*keys, band, F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    local = W.partitionBy(*keys, band).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        marked.join(starts, [*keys, band])
        .withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(local), F.col("_carry")))
        .drop("_v", "_carry")
    )


def top_k(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark limits each group before the shuffle, so a hot key moves ``k`` rows per task."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k).withColumn(name, F.col(name).cast("bigint"))


def argmax_first(df: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """The row order value with the best positive score per key, the earliest on ties: one aggregate."""
    return (
        df.where(F.col(score) > 0).groupBy(*keys)
        .agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"))).alias("_b"))
        .select(*keys, F.col("_b.s").alias(score), (-F.col("_b.o")).alias(order))
    )
