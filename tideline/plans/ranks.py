"""Global row numbers without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.plans.shared import Scratch

#: Bits of a row's number within its part in what ``monotonically_increasing_id`` gives.
_WITHIN = 33


def global_rank(df: DataFrame, order: Sequence[str], scratch: Scratch, name: str = "rank") -> DataFrame:
    """``df`` with a row number from 0 in the given order. The rows are dealt out by range, sorted within
    their part and written with their number there; a part's offset is the number of rows in the parts before
    it (a row a part). One shuffle, and rows of a part stand in order."""
    columns = [F.col(c) for c in order]
    dealt = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__id", F.monotonically_increasing_id())
    parts = scratch.keep(dealt.select("*", F.shiftright("__id", _WITHIN).alias("__part"), F.col("__id").bitwiseAND(F.lit((1 << _WITHIN) - 1)).alias("__in")).drop("__id"), f"{name}-parts")
    sizes = parts.groupBy("__part").count()
    before = sizes.withColumn("__offset", F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", F.coalesce("__offset", F.lit(0)).alias("__offset"))
    return parts.join(F.broadcast(before), "__part").withColumn(name, F.col("__offset") + F.col("__in")).drop("__part", "__offset", "__in")
