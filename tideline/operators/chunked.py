"""Smoothing in overlapping chunks, and point by point over a sliding window.

A chunk's fit depends on its own rows and the last ``overlap`` rows before it, so all chunks are fitted at
once: overlap rows are given to both their chunks, and only they meet again to be merged. A window of
``capacity`` rows depends on the capacity - 1 rows before, so a long stream is cut in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import kernel
from tideline.operators.batch import prepared
from tideline.options import InvalidData, Options, UnsupportedFeature
from tideline.plans.ranks import global_rank
from tideline.plans.shared import Scratch

_CHUNK_FIELDS = ("y_smooth", "residual", "robustness_weight", "chunk")
_ONLINE_FIELDS = ("y_smooth", "residual", "robustness_weight", "window_size")


def merged(merge: str, previous: Column, current: Column, share: Column) -> Column:
    """The value of a row in an overlap. share: its place in the overlap, from 0 up to 1."""
    return {"average": 0.5 * (previous + current), "weighted_average": previous * (1 - share) + current * share, "take_first": previous, "take_last": current}[merge]


def _ranked(base: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    if by:
        return base.withColumn(name, F.row_number().over(Window.partitionBy(*(F.col(f"`{c}`") for c in by)).orderBy(*order)).cast("long") - 1)
    return global_rank(base, order, Scratch(base.sparkSession, "rank"), name)


def smooth_chunked(df: DataFrame, x: str, y: str, by: Sequence[str] = (), *, dropna: bool = False, **options) -> DataFrame:
    """``df`` with ``y_smooth``, ``residual`` and ``robustness_weight``, fitted in chunks of ``chunk_size``
    rows in the order of x; rows that tie in x are ordered by y. Every row is returned once, also where the
    last chunk is shorter than the overlap. The span is a share of the chunk with its overlap. ``chunk`` is
    the number, from 0, of the chunk with which a row is sent."""
    options = {"delta": 0.0} | options
    o = Options.of(**options)
    if o.wants_se and o.level is not None:
        raise UnsupportedFeature("intervals need the whole series")
    by = list(by)
    base = prepared(df, x, y, by, None, dropna, _CHUNK_FIELDS)
    own = [c for c in base.columns if not c.startswith("__")]
    size, lap = F.lit(o.chunk_size), o.overlap
    ranked = _ranked(base, by, ["__x", "__y"], "__rank")
    place, chunk = F.col("__rank") % size, F.floor(F.col("__rank") / size).cast("long")
    twice = F.when(place >= size - lap, F.array(F.struct(chunk.alias("c"), F.lit(False).alias("lap")), F.struct((chunk + 1).alias("c"), F.lit(True).alias("lap")))).otherwise(F.array(F.struct(chunk.alias("c"), F.lit(False).alias("lap"))))
    rows = ranked.select(*(F.col(f"`{c}`") for c in own), "__x", "__y", "__rank", F.explode(twice if lap else F.array(F.struct(chunk.alias("c"), F.lit(False).alias("lap")))).alias("__s")).select("*", F.col("__s.c").alias("__chunk"), F.col("__s.lap").alias("__lap")).drop("__s")
    schema = T.StructType([*(base.schema[c] for c in own), *(T.StructField(n, t) for n, t in (("__rank", T.LongType()), ("__lap", T.BooleanType()), ("__y", T.DoubleType()), ("__fit", T.DoubleType()), ("__rw", T.DoubleType())))])

    def run(group):
        order = np.argsort(group.column("__rank").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        gx, gy, late = (group.column(c).to_numpy(zero_copy_only=False) for c in ("__x", "__y", "__lap"))
        if late.all():  # the rows of an overlap after which nothing comes
            return group.slice(0, 0).select([*own, "__rank", "__lap", "__y"]).append_column("__fit", pa.array([], pa.float64())).append_column("__rw", pa.array([], pa.float64()))
        if len(gx) > 1:
            kernel.check(gx.astype(float), gy.astype(float))
            fit, _, rw, _ = kernel.fit_sorted(gx, gy, None, o, o.fraction, o.delta if o.delta is not None else kernel.auto_delta(gx))
        else:
            fit, rw = gy, np.ones(1)
        return group.select([*own, "__rank", "__lap", "__y"]).append_column("__fit", pa.array(fit)).append_column("__rw", pa.array(rw))

    fitted = rows.groupBy(*by, "__chunk").applyInArrow(run, schema)
    if not lap:
        alone = fitted
        out = alone
    else:
        in_lap = F.col("__rank") % size >= size - lap
        alone = fitted.where(~in_lap)
        keys = [F.col(f"`{c}`") for c in own]
        both = fitted.where(in_lap)
        share = ((F.col("__rank") % size) - (size - lap)) / lap
        # a row and its copy in the next chunk; in the last chunk there is no copy
        group = both.groupBy(*(F.col(f"`{c}`") for c in by), "__rank").agg(F.first(F.struct(*keys)).alias("__row"), F.max("__y").alias("__y"), *(F.max(F.when(~F.col("__lap"), F.col(v))).alias(f"{v}p") for v in ("__fit", "__rw")), *(F.max(F.when(F.col("__lap"), F.col(v))).alias(f"{v}c") for v in ("__fit", "__rw")))
        value = lambda v: F.when(F.col(f"{v}c").isNull(), F.col(f"{v}p")).otherwise(merged(o.merge, F.col(f"{v}p"), F.col(f"{v}c"), share)).alias(v)
        joined = group.select(*(F.col(f"__row.`{c}`").alias(c) for c in own), "__rank", F.lit(False).alias("__lap"), "__y", value("__fit"), value("__rw"))
        out = alone.union(joined)
    # the rows of an overlap are sent with the next chunk, the last ones of all with the end
    sent = F.when(place >= size - lap, chunk + 1).otherwise(chunk) if lap else chunk
    return out.select(*(F.col(f"`{c}`") for c in own), F.col("__fit").alias("y_smooth"), (F.col("__y") - F.col("__fit")).alias("residual"), F.col("__rw").alias("robustness_weight"), sent.alias("chunk"))


def chunk_diagnostics(smoothed: DataFrame, y: str, by: Sequence[str] = (), *, running: bool = False) -> DataFrame:
    """The cumulative measures of chunked results: the residual SD is the sample's, not the MAD's. With
    ``running`` a row for each chunk, of what has been sent up to it."""
    r, v = F.col("residual"), F.col(f"`{y}`").cast("double")
    if running:
        return _running_measures(smoothed, r, v, by)
    s = smoothed.groupBy(*(F.col(f"`{c}`") for c in by)).agg(F.count("*").alias("n"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"), F.sum(r * r).alias("_rr"), F.sum(v * v).alias("_yy"), F.sum(v).alias("_y"), F.stddev_samp(r).alias("_sd"))
    total = F.col("_yy") - F.col("_y") * F.col("_y") / F.col("n")
    r2 = F.when(total > 1e-12 * F.abs("_yy"), 1 - F.col("_rr") / total).when((F.col("_rr") < 1e-12 * F.abs("_yy")) | (F.col("_rr") == 0), 1.0).otherwise(0.0)
    return s.select(*(F.col(f"`{c}`") for c in by), "n", "rmse", "mae", r2.alias("r_squared"), F.when(F.col("n") > 1, F.col("_sd")).otherwise(F.col("rmse")).alias("residual_sd"))


def _running_measures(smoothed: DataFrame, r: Column, v: Column, by: Sequence[str]) -> DataFrame:
    keys = [F.col(f"`{c}`") for c in by]
    sums = {"n": F.count("*"), "_r": F.sum(r), "_rr": F.sum(r * r), "_a": F.sum(F.abs(r)), "_v": F.sum(v), "_vv": F.sum(v * v)}
    # a row a chunk goes through the window
    upto = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    s = smoothed.groupBy(*keys, "chunk").agg(*(c.alias(k) for k, c in sums.items()))
    s = s.select(*keys, "chunk", *(F.sum(k).over(upto).alias(k) for k in sums))
    n, total = F.col("n"), F.col("_vv") - F.col("_v") * F.col("_v") / F.col("n")
    r2 = F.when(total > 1e-12 * F.abs("_vv"), 1 - F.col("_rr") / total).when((F.col("_rr") < 1e-12 * F.abs("_vv")) | (F.col("_rr") == 0), 1.0).otherwise(0.0)
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("_rr") - F.col("_r") * F.col("_r") / n) / F.greatest(n - 1, F.lit(1))))
    rmse = F.sqrt(F.col("_rr") / n)
    return s.select(*keys, "chunk", "n", rmse.alias("rmse"), (F.col("_a") / n).alias("mae"), r2.alias("r_squared"), F.when(n > 1, sd).otherwise(rmse).alias("residual_sd"))


def online_values(x: np.ndarray, y: np.ndarray, o: Options, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed values and robustness weights of the rows from ``first``; NaN until min_points have come."""
    rows = np.arange(first, len(x))
    return online_at(x, y, rows, np.minimum(rows + 1, o.window_capacity), o)


def online_at(x: np.ndarray, y: np.ndarray, rows: np.ndarray, sizes: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """The values at the ends of windows: of ``sizes`` points up to ``rows``.

    They come from arrays of windows. Only incremental values of windows in which x falls, and full updates that choose their span, are worked out one by one."""
    asked, (fit, rw) = rows, (np.full(len(x), np.nan) for _ in range(2))
    rows, size = rows[sizes >= o.min_points], sizes[sizes >= o.min_points]
    rw[rows] = 1.0
    if len(two := rows[size == 2]):
        fit[two] = np.where(x[two] != x[two - 1], y[two], 0.5 * (y[two] + y[two - 1]))
    rows, size = rows[size > 2], size[size > 2]
    if o.update == "incremental" and len(rows):
        # x doesn't fall within the window: none of its steps but the first goes down
        falls = np.concatenate([[0], np.cumsum(x[1:] < x[:-1])])
        top = falls[rows] == falls[rows - size + 1]
        fit[rows[top]] = kernel.fit_last_of_windows(x, y, rows[top], size[top], o)
        rows, size = rows[~top], size[~top]
    elif o.update == "full" and not o.cv_fractions:
        fit[rows], rw[rows] = kernel.fit_windows(x, y, rows, size, o)
        rows, size = rows[:0], size[:0]
    for k, m in zip(rows.tolist(), size.tolist(), strict=True):
        wx, wy = x[k + 1 - m : k + 1], y[k + 1 - m : k + 1]
        if o.update == "incremental":
            fit[k] = kernel.fit_last(wx, wy, o)
        else:
            f = kernel.fit_series(wx, wy, None, o)
            fit[k], rw[k] = f.y_smooth[-1], f.robustness_weight[-1]
    return fit[asked], rw[asked]


def smooth_online(df: DataFrame, x: str, y: str, seq: Sequence[str], by: Sequence[str] = (), *, block: int | None = None, **options) -> DataFrame:
    """``df`` with ``y_smooth``, ``residual`` and ``robustness_weight`` as a window over the last
    ``window_capacity`` rows in the order of ``seq`` gives them: null until ``min_points`` rows have come;
    and ``window_size``, the rows that the window holds then.
    ``update="full"`` smooths the whole window, in the order of x, for each row. Series are cut into blocks
    of ``block`` rows, each with the rows before it that its windows reach."""
    options = {"delta": 0.0} | options
    o = Options.of(**options)
    if o.level is not None:
        raise UnsupportedFeature("intervals need the whole series")
    by, reach = list(by), o.window_capacity - 1
    block = max(block or 10 * o.window_capacity, reach, 1)
    base = prepared(df, x, y, by, None, False, _ONLINE_FIELDS)
    own = [c for c in base.columns if not c.startswith("__")]
    ranked = _ranked(base, by, [f"`{c}`" if not c.startswith("`") else c for c in seq], "__rank")
    chunk = F.floor(F.col("__rank") / block).cast("long")
    reached = F.when(F.col("__rank") % block >= block - reach, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    rows = ranked.withColumn("__chunk", F.explode(reached))
    schema = T.StructType([*(base.schema[c] for c in own), *(T.StructField(n, T.DoubleType()) for n in _ONLINE_FIELDS[:3]), T.StructField("window_size", T.LongType())])

    # the rows of a block stand together and in order, so windows of many series are worked out at once
    columns = [*(F.col(f"`{c}`") for c in by), "__chunk"]
    rows = rows.repartition(*columns).sortWithinPartitions(*columns, "__rank")
    rows = rows.select(*(F.col(f"`{c}`") for c in own), "__x", "__y", "__rank", "__chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0), np.zeros(0)]
        for batch in batches:
            new = [batch.column(len(own) + j).to_numpy(zero_copy_only=False).astype(float) for j in range(2)]
            rank, chunk = (batch.column(len(own) + j).to_numpy(zero_copy_only=False) for j in (2, 3))
            if not (np.isfinite(new[0]).all() and np.isfinite(new[1]).all()):
                raise InvalidData("x and y must be finite")
            gx, gy = (np.concatenate(pair) for pair in zip(held, new, strict=True))
            mine = rank >= chunk * block  # the others are only there for the windows of their block
            size = np.minimum(rank + 1, o.window_capacity)[mine]
            fit, rw = online_at(gx, gy, np.flatnonzero(mine) + len(held[0]), size, o)
            held = [gx[len(gx) - min(reach, len(gx)) :], gy[len(gy) - min(reach, len(gy)) :]]
            null = lambda v: pa.array(v, mask=np.isnan(v))
            kept = batch.filter(pa.array(mine))
            yield pa.RecordBatch.from_arrays([*kept.columns[: len(own)], null(fit), null(new[1][mine] - fit), null(rw), pa.array(size)], [*own, *_ONLINE_FIELDS])

    return rows.mapInArrow(run, schema)
