"""Synthetic points at both ends of many series, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.options import parse_option


def padded(df: DataFrame, x: str, y: str, by: Sequence[str], k: Column | int, boundary: str = "extend") -> DataFrame:
    """``by``, rank, x and y of each series with ``k`` points (one less than the series has, at most) added
    on both sides; rank is from 0 in the order of x. An empty input gives no rows, a series of one point
    stays as it is; rows with a null x or y are left out; null keys are a series."""
    policy = parse_option("boundary", boundary)
    keys = [F.col(f"`{c}`") for c in by]
    rows = df.select(*keys, F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    w = Window.partitionBy(*keys)
    ordered = w.orderBy("x", "y")
    ends = {"x0": F.first("x"), "xn": F.last("x"), "y0": F.first("y"), "yn": F.last("y"), "x1": F.nth_value("x", 2), "xm": F.min(F.when(F.col("i") == F.col("n") - 2, F.col("x")))}
    rows = rows.withColumn("i", (F.row_number().over(ordered) - 1).cast("long")).withColumn("n", F.count("*").over(w))
    rows = rows.withColumn("k", F.lit(0).cast("long") if policy == "noboundary" else F.greatest(F.lit(0), F.least(F.lit(k), F.col("n") - 1)).cast("long"))
    if policy == "noboundary":
        return rows.select(*keys, F.col("i").alias("rank"), "x", "y")
    whole = w.orderBy("x", "y").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("*", *(e.over(whole).alias(c) for c, e in ends.items()))
    i, n, size = F.col("i"), F.col("n"), F.col("k")
    point = lambda rank, px, py: F.struct(rank.cast("long").alias("rank"), px.alias("x"), py.alias("y"))
    own = F.array(point(i + size, F.col("x"), F.col("y")))
    none = F.array().cast("array<struct<rank:bigint,x:double,y:double>>")
    if policy == "reflect":
        low = F.when((i >= 1) & (i <= size), F.array(point(size - i, 2 * F.col("x0") - F.col("x"), F.col("y")))).otherwise(none)
        high = F.when((i >= n - 1 - size) & (i <= n - 2), F.array(point(size + 2 * (n - 1) - i, 2 * F.col("xn") - F.col("x"), F.col("y")))).otherwise(none)
    else:
        ly, ry = (F.col("y0"), F.col("yn")) if policy == "extend" else (F.lit(0.0), F.lit(0.0))
        steps = lambda make: F.when((i == 0) & (size > 0), F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(size, F.lit(1))), make)).otherwise(none)
        low = steps(lambda s: point(size - s, F.col("x0") - s * (F.col("x1") - F.col("x0")), ly))
        high = steps(lambda s: point(size + n - 1 + s, F.col("xn") + s * (F.col("xn") - F.col("xm")), ry))
    return rows.select(*keys, F.inline(F.concat(own, low, high)))
