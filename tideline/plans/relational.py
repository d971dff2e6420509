"""One series too large for a task: the passes as aggregates over a table of ranked points.

With a delta the smoother fits a few hundred anchors and interpolates the rest, so a pass is fully told
by its knots, which fit in the driver (``MAX_ANCHORS`` at most, checked). Points never leave the
executors: in a pass each batch of points adds five weighted sums to the anchors whose windows reach it,
which are added up by anchor, and residuals and robustness weights follow from the last pass's knots. A
pass is one job, and its shuffle is a row for each anchor and task. Medians are found by counting in bins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import kernel
from tideline.operators.batch import prepared
from tideline.options import InvalidData, Options, UnsupportedFeature
from tideline.plans.ranks import global_rank
from tideline.plans.shared import Scratch

MAX_ANCHORS, COLLECT, WALK = 4096, 10_000, 1 << 22
#: Bits of a value that are left out of the numbers of bins, from level to level.
_LEVELS = (44, 24, 0)

Values = Callable[[pa.RecordBatch], np.ndarray]


def _ordered(v: np.ndarray) -> np.ndarray:
    """Doubles as integers in the same order, so that their upper bits are bins of about equal relative width."""
    bits = (v + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def _tally(points: DataFrame, values: Values, shift: int = 63, within: tuple[int, int] | None = None) -> list:
    """A row for each bin, in order: its number, how many values it has, the least, the largest and the sum
    of their sizes. ``within`` is the shift and number of a wider bin to look into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.ascontiguousarray(values(batch), float)
            v = v[~np.isnan(v)]
            if within is not None:
                v = v[_ordered(v) >> within[0] == within[1]]
            if not len(v):
                continue
            v = np.sort(v)
            at = _ordered(v) >> shift
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            ends = np.append(first[1:], len(v))
            yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(ends - first), pa.array(v[first]), pa.array(v[ends - 1]), pa.array(np.add.reduceat(np.abs(v), first))], ["b", "c", "lo", "hi", "size"])

    rows = points.mapInArrow(run, "b long, c long, lo double, hi double, size double")
    rows = rows.groupBy("b").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("size").alias("size"))
    return sorted(rows.collect(), key=lambda r: r.b)


def median_of(points: DataFrame, values: Values) -> tuple[float, float]:
    """The exact median of the values, and the mean of their sizes. Values are counted by their upper bits,
    and those of the bin that holds the two middle ones by more bits, at last by value; a bin of ``COLLECT``
    values at most is counted by value at once. What reaches the driver is a row a bin."""
    within, before, n = None, 0, 0
    for shift in _LEVELS:
        rows = _tally(points, values, shift, within)
        if within is None:
            n, size = sum(r.c for r in rows), sum(r.size for r in rows)
            ranks = ((n - 1) // 2, n // 2)
        passed, found = before, []
        for r in rows:
            found += [(passed, r) for k in ranks if passed <= k < passed + r.c]
            passed += r.c
        (at, low), (_, high) = found
        if low.b != high.b or low.lo == low.hi:  # the last of one bin and the first of the next, or one value
            break
        within, before = (shift, low.b), at
        if low.c <= COLLECT and shift:
            found, passed = [], before
            for r in _tally(points, values, 0, within):
                found += [r for k in ranks if passed <= k < passed + r.c]
                passed += r.c
            low, high = found
            break
    return 0.5 * (low.hi + high.lo), size / n


def exact_median(df: DataFrame, value: Column) -> float:
    """Of a column, of whatever size."""
    return median_of(df.select(value.cast("double").alias("v")), lambda batch: batch.column(0).to_numpy(zero_copy_only=False).astype(float))[0]


def _anchors(points: DataFrame, n: int, delta: float) -> tuple[list[tuple[int, int, float]], np.ndarray | None]:
    """(rank, last rank of its ties, x) of each, and all x where they are held. Up to ``WALK`` points their x go to the driver, 16 bytes each.
    Beyond, each step reads the rows between two anchors only: the table is in the order of x, so the
    others are skipped by their file statistics."""
    if n <= WALK:
        xs = np.sort(points.select("x").toArrow().column("x").to_numpy())
        at, copies = kernel.anchors(xs, delta)
        if len(at) > MAX_ANCHORS:
            raise UnsupportedFeature(f"more than {MAX_ANCHORS} anchors: delta is too small for a series of this size")
        ties = dict(copies.tolist())
        return [(a, ties.get(a, a), float(xs[a])) for a in at.tolist()], xs
    out, last, x = [], 0, points.where("rank = 0").first().x
    while True:
        ties = points.where(F.col("x") == x).agg(F.max("rank")).first()[0]
        out.append((last, ties, x))
        if len(out) > MAX_ANCHORS:
            raise UnsupportedFeature(f"more than {MAX_ANCHORS} anchors: delta is too small for a series of this size")
        if ties >= n - 1:
            return out, None
        ahead = points.where((F.col("x") > x) & (F.col("x") <= x + delta)).agg(F.max(F.struct("x", "rank")).alias("m")).first().m
        if ahead is None:
            ahead = points.where(F.col("rank") == ties + 1).select("x", "rank").first()
        last, x = ahead.rank, ahead.x


def _at(points: DataFrame, ranks: list[int]) -> dict[int, tuple[float, float]]:
    return {r.rank: (r.x, r.y) for r in points.where(F.col("rank").isin(sorted(set(ranks)))).select("rank", "x", "y").collect()}


@dataclass(frozen=True)
class Knots:
    """What a pass comes to: ranks, x and fits of the anchors and of the ends of their ties."""

    rank: np.ndarray
    x: np.ndarray
    fit: np.ndarray

    def at(self, rank: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The fits at points, on lines between the knots around their ranks."""
        if len(self.rank) == 1:
            return np.full(len(x), self.fit[0])
        right = np.clip(np.searchsorted(self.rank, rank, "right"), 1, len(self.rank) - 1)
        left = right - 1
        x0, x1, y0, y1 = self.x[left], self.x[right], self.fit[left], self.fit[right]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(x1 > x0, y0 + (x - x0) / (x1 - x0) * (y1 - y0), 0.5 * (y0 + y1))
        return np.where(rank == self.rank[left], y0, np.where(rank >= self.rank[right], y1, out))


@dataclass(frozen=True)
class Weighting:
    """Robustness weights from the residuals against a pass."""

    knots: Knots | None
    scale: float
    kind: str

    def at(self, rank: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.ones(len(y)) if self.knots is None else kernel.weights_of(y - self.knots.at(rank, x), self.scale, self.kind)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns))


def smooth_large(df: DataFrame, x: str, y: str, weight: str | None = None, *, dropna: bool = False, **options) -> DataFrame:
    """As :func:`tideline.operators.batch.smooth` for one series of any size. Needs a delta that leaves
    ``MAX_ANCHORS`` anchors at most; standard errors and cross-validation are not available."""
    o = Options.of(**options)
    if o.wants_se or o.cv_fractions:
        raise UnsupportedFeature("standard errors and cross-validation need the grouped smoother")
    fields = ("y_smooth", "residual", "robustness_weight")
    scratch = Scratch(df.sparkSession, "large")
    base = prepared(df, x, y, (), weight, dropna, fields)
    own = [c for c in base.columns if not c.startswith("__")]
    whole = global_rank(base, ["__x", "__y"], scratch, "__rank")
    w = F.col("__w") if weight else F.lit(1.0)
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    light = F.sum((bad("__w") | (F.col("__w") < 0)).cast("int")) if weight else F.lit(0)
    n, wrong, unfit, x0, x1 = whole.agg(F.count("*"), F.sum((bad("__x") | bad("__y")).cast("int")), light, F.min("__x"), F.max("__x")).first()
    if n == 0:
        return whole.select(*own, *(F.lit(None).cast("double").alias(f) for f in fields))
    if n < 2 or wrong or unfit:
        raise InvalidData("two points at least are needed" if n < 2 else f"{wrong} rows have a null or non-finite x or y" if wrong else f"{unfit} rows have a weight that isn't finite or is negative")
    if o.fraction >= 1:
        from tideline.operators.batch import _line

        return _line(base, own, [])
    delta = 0.01 * (x1 - x0) if o.delta is None else o.delta
    q = kernel.span(n, o.fraction)
    k = 0 if o.boundary == "noboundary" else min(q // 2, n - 1)
    points = whole.select((F.col("__rank") + k).alias("rank"), F.col("__x").alias("x"), F.col("__y").alias("y"), w.alias("w"))
    if k:
        points = points.union(_padding(df, whole, o, n, k))
    total = n + 2 * k
    points = scratch.keep(points, "points")
    marks, xs = _anchors(points, total, delta)
    q = min(q, total)
    at, ends_of_ties, ax = (np.array(c) for c in zip(*marks, strict=True))
    if xs is not None:
        left = kernel.window_starts(xs, at, q)
        edge = {r: (xs[r],) for r in [*left.tolist(), *(left + q - 1).tolist()]}
    else:
        left = _window_starts(points, 2 * ax, q, total)
        edge = _at(points, [*left.tolist(), *(left + q - 1).tolist()])
    h = np.array([max(x - edge[lo][0], edge[lo + q - 1][0] - x) for x, lo in zip(ax.tolist(), left.tolist(), strict=True)])
    place = np.array([r for a, b in zip(at.tolist(), ends_of_ties.tolist(), strict=True) for r in dict.fromkeys((a, b))])
    of = np.searchsorted(at, place, "right") - 1
    instead = None if o.fallback == "use_local_mean" else _at(points, at.tolist())
    knots, weighting = None, Weighting(None, 0.0, o.robustness)
    for t in range(o.iterations + 1):
        fits = _pass(points, weighting, at, ax, left, left + q - 1, h, instead, o)
        new = Knots(place, ax[of], fits[of])
        if knots is not None and o.auto_converge is not None and _largest_change(points, knots, new) <= o.auto_converge:
            knots = new
            break
        knots = new
        if t < o.iterations:
            weighting = Weighting(knots, _scale(points, knots, o.scale), o.robustness)
    scratch.drop("points")
    ranked = whole.select(*(F.col(f"`{c}`") for c in own), (F.col("__rank") + k).alias("__rank"), "__x", "__y")
    schema = T.StructType([*(base.schema[c] for c in own), *(T.StructField(f, T.DoubleType()) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, x, y = (batch.column(len(own) + j).to_numpy(zero_copy_only=False) for j in range(3))
            fit = knots.at(rank, x)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(fit), pa.array(y - fit), pa.array(weighting.at(rank, x, y))], [*own, *fields])

    return ranked.mapInArrow(run, schema)


def _window_starts(points: DataFrame, twice: np.ndarray, q: int, total: int) -> np.ndarray:
    """Ranks l with x[l] + x[l + q] below twice the anchor's x are passed over."""
    sums = points.select("rank", "x").join(points.select((F.col("rank") - q).alias("rank"), F.col("x").alias("x2")), "rank").select((F.col("x") + F.col("x2")).alias("s"))
    edges = np.unique(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, c = np.unique(np.searchsorted(edges, batch.column(0).to_numpy(), "right"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(c)], ["p", "c"])

    counts = {r.p: r.c for r in sums.mapInArrow(run, "p long, c long").groupBy("p").agg(F.sum("c").alias("c")).collect()}
    passed = np.cumsum([counts.get(p, 0) for p in range(len(edges) + 1)])
    return np.minimum(passed[np.searchsorted(edges, twice)], total - q)


def _padding(df: DataFrame, whole: DataFrame, o: Options, n: int, k: int) -> DataFrame:
    ends = {r["__rank"]: (r["__x"], r["__y"]) for r in whole.where(F.col("__rank").isin(0, 1, n - 2, n - 1)).select("__rank", "__x", "__y").collect()}
    (x0, y0), (x1, _), (xm, _), (xn, yn) = ends[0], ends[1], ends[n - 2], ends[n - 1]
    one = F.lit(1.0)
    if o.boundary == "reflect":
        i = F.col("__rank")
        lower = whole.where((i >= 1) & (i <= k)).select((F.lit(k) - i).alias("rank"), (2 * x0 - F.col("__x")).alias("x"), F.col("__y").alias("y"), one.alias("w"))
        upper = whole.where((i >= n - 1 - k) & (i <= n - 2)).select((F.lit(2 * (n - 1) + k) - i).alias("rank"), (2 * xn - F.col("__x")).alias("x"), F.col("__y").alias("y"), one.alias("w"))
        return lower.union(upper)
    i = F.col("id")
    steps = df.sparkSession.range(1, k + 1, 1, 1 + k // (1 << 20))
    ly, ry = (y0, yn) if o.boundary == "extend" else (0.0, 0.0)
    lower = steps.select((F.lit(k) - i).alias("rank"), (F.lit(x0) - i * (x1 - x0)).alias("x"), F.lit(ly).alias("y"), one.alias("w"))
    upper = steps.select((F.lit(n - 1 + k) + i).alias("rank"), (F.lit(xn) + i * (xn - xm)).alias("x"), F.lit(ry).alias("y"), one.alias("w"))
    return lower.union(upper)


def _pass(points: DataFrame, weighting: Weighting, at, ax, lo, hi, h, instead, o: Options) -> np.ndarray:
    """The fits at all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(at), 7))
        for batch in batches:
            rank, x, y, w = _columns(batch)
            w = w * weighting.at(rank, x, y)
            if (rank[1:] < rank[:-1]).any():
                order = np.argsort(rank)
                rank, x, y, w = rank[order], x[order], y[order], w[order]
            first, last = np.searchsorted(rank, lo, "left"), np.searchsorted(rank, hi, "right")
            for a in np.flatnonzero(last > first).tolist():
                rows = slice(int(first[a]), int(last[a]))
                d, yy = x[rows] - ax[a], y[rows]
                k = w[rows] * kernel.window_weight(np.abs(d), h[a], o.kernel) if h[a] > 0 else w[rows]
                kd = k * d
                sums[a] += (k.sum(), kd.sum(), k @ yy, kd @ d, kd @ yy, yy.sum(), len(d))
        there = np.flatnonzero(sums[:, 6])
        yield pa.RecordBatch.from_arrays([pa.array(there), *(pa.array(c) for c in sums[there].T)], ["a", *_SUMS])

    got = points.select("rank", "x", "y", "w").mapInArrow(run, "a long, " + ", ".join(f"{c} double" for c in _SUMS))
    rows = np.array(sorted(map(tuple, got.groupBy("a").agg(*(F.sum(c) for c in _SUMS)).collect())))
    sw, sx, sy, sxx, sxy, total, n = rows[:, 1:].T
    with np.errstate(divide="ignore", invalid="ignore"):
        ym, var = sy / sw, sxx - sx * sx / sw
        flat = (h <= 0) | (var <= np.maximum(1e-7, np.finfo(float).eps * h * h))
        fit = np.where(flat, ym, ym - (sxy - sx * ym) / var * (sx / sw))
    if o.fallback == "use_local_mean":
        other = total / n
    else:
        other = np.array([np.nan if o.strict_none and o.fallback == "return_none" else instead[r][1] for r in at.tolist()])
    return np.where(sw > 0, fit, other)


_SUMS = ("sw", "sx", "sy", "sxx", "sxy", "total", "n")


def _scale(points: DataFrame, knots: Knots, scale: str) -> float:
    def residuals(batch):
        rank, x, y, _ = _columns(batch)
        return y - knots.at(rank, x)

    rows = points.select("rank", "x", "y", "w")
    if scale == "mean":
        parts = _tally(rows, residuals)
        s = mean = sum(r.size for r in parts) / sum(r.c for r in parts)
    elif scale == "mar":
        s, mean = median_of(rows, lambda batch: np.abs(residuals(batch)))
    else:
        middle, mean = median_of(rows, residuals)
        s, _ = median_of(rows, lambda batch: np.abs(residuals(batch) - middle))
    return max(mean, s) if s <= max(1e-7 * mean, 1e-12) else s


def _largest_change(points: DataFrame, old: Knots, new: Knots) -> float:
    def changes(batch):
        rank, x, *_ = _columns(batch)
        return np.abs(new.at(rank, x) - old.at(rank, x))

    return _tally(points.select("rank", "x", "y", "w"), changes)[-1].hi
