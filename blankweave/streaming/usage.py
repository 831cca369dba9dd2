"""Running token counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blankweave.operators.drafts import COUNTERS, complete_usage


def usage_meter(usage: DataFrame) -> DataFrame:
    """Token totals per template and step; each step counts from zero. Run it in update or complete mode."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in COUNTERS]
    return complete_usage(usage).groupBy("template_id", "step").agg(*sums)
