"""The smoother of one series in NumPy: what runs inside a grouped task.

Neighbour windows need no walk: with S(l) = x[l] + x[l + q], the q nearest neighbours of x_i start at the
first l with S(l) >= 2 x_i, so all windows come from one binary search and all local fits from block
sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from tideline.options import InvalidData, Options

#: Elements of windows that are worked on at once, and numbers that are kept from pass to pass.
BLOCK, _KEPT = 1 << 18, 1 << 24
#: Windows from this width on are taken one by one.
_WIDE = 1 << 11
#: Elements of short series that are fitted together, so that they stay in a core's cache.
_PART = 1 << 16
_TINY = np.finfo(float).tiny


def _cube(a: np.ndarray) -> np.ndarray:
    return a * a * a


def kernel_weight(u: np.ndarray, kernel: str) -> np.ndarray:
    """K(u) for u >= 0. Bounded kernels are 0 from 1 on, the Gaussian is beyond 6 at its floor."""
    if kernel == "gaussian":
        return np.where(u > 6, 0.0, np.maximum(np.exp(-0.5 * u * u), _TINY))
    k = {
        "tricube": lambda: _cube(1 - u * u * u),
        "epanechnikov": lambda: 1 - u * u,
        "biweight": lambda: np.square(1 - u * u),
        "triangle": lambda: 1 - u,
        "cosine": lambda: np.cos(0.5 * math.pi * u),
        "uniform": lambda: np.ones_like(u),
    }[kernel]()
    return np.where(u < 1, k, 0.0)


def window_weight(d: np.ndarray, h, kernel: str) -> np.ndarray:
    """Weights of distances d under bandwidth h: 1 up to 0.001 h, 0 beyond 0.999 h, K(d / h) between."""
    with np.errstate(divide="ignore", invalid="ignore"):
        k = kernel_weight(d / h, kernel)
    k[d > 0.999 * h] = 0.0
    k[d <= 0.001 * h] = 1.0
    return k


def span(n: int, fraction: float) -> int:
    return max(2, min(n, int(fraction * n + 1e-5)))


def window_starts(x: np.ndarray, at: np.ndarray, q: int, centred: bool = False) -> np.ndarray:
    """The first index of the q nearest neighbours of each x[at]; from a centred start, ties stay there."""
    n = len(x)
    if q >= n:
        return np.zeros(len(at), np.int64)
    s = x[: n - q] + x[q:]
    left = np.minimum(np.searchsorted(s, 2 * x[at], "left"), n - q)
    if not centred:
        return left
    start = np.clip(at - q // 2, 0, n - q)
    return np.where(left > start, left, np.minimum(start, np.searchsorted(s, 2 * x[at], "right")))


class LocalFits:
    """The weighted lines at the indices ``at``, pass after pass. Only the robustness weights change between
    passes, so the products of kernel weights and distances are kept where they fit into ``_KEPT`` numbers,
    and a pass is five sums over windows of one array each. ``left``: where the windows start, if known."""

    def __init__(self, x, y, at, q: int, w, o: Options, left: np.ndarray | None = None):
        self.x, self.y, self.at, self.q, self.w, self.o = x, y, at, min(q, len(x)), w, o
        self.left = window_starts(x, at, self.q) if left is None else left
        self.h = np.maximum(x[at] - x[self.left], x[self.left + self.q - 1] - x[at])
        step = max(1, BLOCK // self.q) if self.q < _WIDE else 1
        self.blocks = [slice(a, a + step) for a in range(0, len(at), step)]
        self.kept = [self._products(b) for b in self.blocks] if 3 * len(at) * self.q <= _KEPT else None

    def _products(self, block: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self.h[block][:, None]
        left = self.left[block] if self.q < _WIDE else slice(int(self.left[block][0]), int(self.left[block][0]) + 1)
        dx = sliding_window_view(self.x, self.q)[left] - self.x[self.at[block]][:, None]
        k = np.where(h > 0, window_weight(np.abs(dx), h, self.o.kernel), 1.0)
        kd = k * dx
        return k, kd, kd * dx

    def __call__(self, rw: np.ndarray | None) -> np.ndarray:
        """rw: robustness weights, None for ones."""
        v = rw if self.w is None else self.w if rw is None else rw * self.w
        z = self.y if v is None else v * self.y
        vw, zw = (None if a is None else sliding_window_view(a, self.q) for a in (v, z))
        # one wide window a block is a slice, many narrow ones are gathered
        many = self.q < _WIDE
        dot, out = (lambda a, b: np.einsum("ij,ij->i", a, b)) if many else lambda a, b: a @ b, np.empty(len(self.at))
        for n, block in enumerate(self.blocks):
            k, kd, kdd = self._products(block) if self.kept is None else self.kept[n]
            left, h = self.left[block], self.h[block]
            at = left if many else int(left[0])
            vs, zs = None if vw is None else vw[at], zw[at]
            sw, sx, sxx = (a.sum(axis=1) if vs is None else dot(a, vs) for a in (k, kd, kdd))
            sy, sxy = dot(k, zs), dot(kd, zs)
            with np.errstate(divide="ignore", invalid="ignore"):
                xm, ym = sx / sw, sy / sw
                var = sxx - sx * xm
                got = np.where((var <= np.maximum(1e-7, np.finfo(float).eps * h * h)) | (h <= 0), ym, ym - (sxy - sx * ym) / var * xm)
            none = sw <= 0
            if none.any():
                instead = sliding_window_view(self.y, self.q)[left[none]].mean(axis=1) if self.o.fallback == "use_local_mean" else self.y[self.at[block][none]]
                got[none] = np.nan if self.o.fallback == "return_none" and self.o.strict_none else instead
            out[block] = got
        return out


def anchors(x: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices that are fitted, and for every index the last one of its tie block of an anchor, or -1.

    From an anchor the next is the last index within delta, one further at least; the points that tie
    with an anchor copy its value and the gap is interpolated from the last of them."""
    n = len(x)
    found, copies, last = [0], [], 0
    while last < n - 1:
        ahead = int(np.searchsorted(x, x[last] + delta, "right"))
        ahead = max(ahead, last + 1)
        ties = min(int(np.searchsorted(x, x[last], "right")), ahead) - 1
        if ties > last:
            copies.append((last, ties))
            last = ties
        nxt = min(max(ahead - 1, last + 1), n - 1)
        if nxt <= last:
            break
        found.append(nxt)
        last = nxt
    return np.array(found), np.array(copies, np.int64).reshape(-1, 2)


class Between:
    """The values of all points from those of the anchors: copies for ties, lines between."""

    def __init__(self, x, at, copies):
        self.whole = len(at) == len(x)
        if self.whole:
            return
        # knots: anchors and the ends of their tie blocks; zero-width gaps hold no point
        self.knots, self.source = at, np.arange(len(at))
        if len(copies):
            knots = np.concatenate([at, copies[:, 1]])
            order = np.argsort(knots, kind="stable")
            self.knots, self.source = knots[order], np.concatenate([self.source, np.searchsorted(at, copies[:, 0])])[order]
        last = len(self.knots) - 1
        sizes = np.diff(np.concatenate([[0], self.knots[1:] if last else self.knots[:0], [len(x)]]))
        self.left = np.minimum(np.repeat(np.arange(len(sizes)), sizes), max(last - 1, 0))
        self.right = np.minimum(self.left + 1, last)
        x0, x1 = x[self.knots[self.left]], x[self.knots[self.right]]
        self.wide = x1 > x0
        with np.errstate(divide="ignore", invalid="ignore"):
            self.share = (x - x0) / (x1 - x0)

    def __call__(self, fit: np.ndarray) -> np.ndarray:
        if self.whole:
            return fit
        values = fit[self.source]
        y0, y1 = values[self.left], values[self.right]
        with np.errstate(invalid="ignore"):
            out = np.where(self.wide, y0 + self.share * (y1 - y0), np.where(y0 == y1, y0, 0.5 * (y0 + y1)))
        out[self.knots] = values
        return out


def pad(x, y, w, q: int, policy: str):
    """Synthetic points on both ends; their case weights are 1. Returns the arrays and the number a side.
    Series run along the last axis."""
    n = x.shape[-1]
    k = min(q // 2, n - 1)
    if policy == "noboundary" or k <= 0:
        return x, y, w, 0
    i = np.arange(1, k + 1)
    if policy == "reflect":
        lx, ly, rx, ry = 2 * x[..., :1] - x[..., i], y[..., i], 2 * x[..., -1:] - x[..., n - 1 - i], y[..., n - 1 - i]
    else:
        value = (lambda v: np.repeat(v, k, axis=-1)) if policy == "extend" else (lambda v: np.repeat(np.zeros_like(v), k, axis=-1))
        lx, rx = x[..., :1] - i * (x[..., 1:2] - x[..., :1]), x[..., -1:] + i * (x[..., -1:] - x[..., -2:-1])
        ly, ry = value(y[..., :1]), value(y[..., -1:])
    one = np.ones(k)
    join = lambda *a: np.concatenate(a, axis=-1)
    return join(lx[..., ::-1], x, rx), join(ly[..., ::-1], y, ry), None if w is None else join(one, w, one), k


def _median(v: np.ndarray) -> np.ndarray:
    return np.median(v, axis=-1, keepdims=True)


def scales_of(r: np.ndarray, scale: str) -> np.ndarray:
    """Residual scales with their floor, of series along the last axis, which stays."""
    size = np.abs(r)
    mean = size.mean(axis=-1, keepdims=True)
    s = mean if scale == "mean" else _median(size) if scale == "mar" else _median(np.abs(r - _median(r)))
    return np.where(s <= np.maximum(1e-7 * mean, 1e-12), np.maximum(mean, s), s)


def scale_of(r: np.ndarray, scale: str) -> float:
    """Residual scale with its floor."""
    return float(scales_of(r, scale)[0])


def robustness_weights(r: np.ndarray, robustness: str, scale: str) -> np.ndarray:
    return weights_of(r, scales_of(r, scale), robustness)


def weights_of(r: np.ndarray, s: float | np.ndarray, robustness: str) -> np.ndarray:
    """Weights of residuals under the scale s."""
    size = np.abs(r)
    if robustness == "bisquare":
        c = np.maximum(6 * s, 1e-12)
        w = np.where(size <= 0.001 * c, 1.0, np.where(size <= 0.999 * c, (1 - (size / c) ** 2) ** 2, 0.0))
    else:
        with np.errstate(divide="ignore", invalid="ignore"):
            u = size / s
        w = np.where(u <= 1.345, 1.0, 1.345 / np.maximum(u, 1.345)) if robustness == "huber" else np.where(u <= 2.5, 1.0, 0.0)
    return np.where(s <= 0, 1.0, w)


def standard_errors(x, y, fit, q, rw, kernel: str) -> np.ndarray:
    """Pointwise standard errors; case weights take no part."""
    n = len(x)
    q = min(q, n)
    at = np.arange(n)
    left = window_starts(x, at, q, centred=True)
    r2 = (y - fit) ** 2
    xs, rs, ws = (sliding_window_view(v, q) for v in (x, r2, rw))
    out = np.zeros(n)
    one = float(kernel_weight(np.zeros(1), kernel)[0])
    for a in range(0, n, max(1, BLOCK // q)):
        rows = slice(a, a + max(1, BLOCK // q))
        l, i = left[rows], at[rows]
        dx = xs[l] - x[i][:, None]
        h = np.maximum(-dx[:, 0], dx[:, -1])
        with np.errstate(divide="ignore", invalid="ignore"):
            w = kernel_weight(np.abs(dx) / h[:, None], kernel) * ws[l]
            sw = w.sum(axis=1)
            se = np.sqrt((w * rs[l]).sum(axis=1) / (sw - 2) * (one * rw[i] / sw))
        out[rows] = np.where((h > 0) & (sw > 2), se, 0.0)
    return out


def residual_sd(r: np.ndarray) -> float:
    """1.4826 times the median absolute deviation."""
    if len(r) == 1:
        return 1.4826 * abs(float(r[0]))
    mad = float(np.median(np.abs(r - np.median(r))))
    return 1.4826 * (mad if mad > 0 else 1e-12)


def z_score(level: float) -> float:
    """Two-sided normal quantile: round values for the usual levels, else a rational approximation."""
    for p, z in ((0.99, 2.576), (0.95, 1.960), (0.90, 1.645)):
        if abs(level - p) <= 1e-6:
            return z
    p = (1 + level) / 2
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0)
    poly = lambda cs, t: sum(k * t ** (len(cs) - 1 - i) for i, k in enumerate(cs))
    if p <= 0.97575:
        t = p - 0.5
        return t * poly(a, t * t) / poly(b, t * t)
    t = math.sqrt(-2 * math.log(1 - p))
    return -poly(c, t) / poly(d, t)


def intervals(fit, se, r, o: Options) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    if o.level is None:
        return out
    z, sd = z_score(o.level), residual_sd(r)
    for name, wanted, width in (("confidence", o.confidence_level, se), ("prediction", o.prediction_level, np.sqrt(se * se + sd * sd))):
        if wanted is not None:
            low, high = fit - z * width, fit + z * width
            out[f"{name}_lower"] = low
            out[f"{name}_upper"] = np.where(np.isfinite(high - low) & (high > low), high, low + 1e-12)
    return out


@dataclass(frozen=True)
class Diagnostics:
    rmse: float
    mae: float
    r_squared: float
    aic: float | None
    aicc: float | None
    effective_df: float | None
    residual_sd: float


def df_from_leverages(leverages) -> float:
    """Effective degrees of freedom: the trace of the smoother, which is the sum of the leverages."""
    return float(np.sum(np.asarray(leverages, float)))


def diagnose(y, fit, se=None) -> Diagnostics:
    r = y - fit
    n, rss, sd = len(y), float((r * r).sum()), residual_sd(r)
    total = float(((y - y.mean()) ** 2).sum())
    r2 = 1.0 if n == 1 else (1 - rss / total if total > 0 else float(rss == 0))
    df = aic = aicc = None
    if se is not None and sd > 0:
        leverage = df_from_leverages(np.clip((se / sd) ** 2, 0, 1))
        df = leverage if leverage > 0 else None
    if df is not None:
        aic = n * math.log(rss / n) + 2 * df if rss > 0 else math.inf
        left = n - df - 1
        aicc = math.inf if left <= 0 else aic + 2 * df * (df + 1) / left
    return Diagnostics(math.sqrt(rss / n), float(np.abs(r).mean()), r2, aic, aicc, df, sd)


@dataclass
class Fit:
    """Columns in the order of the input, and what holds for the series."""

    y_smooth: np.ndarray
    residual: np.ndarray
    robustness_weight: np.ndarray
    standard_error: np.ndarray | None
    bounds: dict[str, np.ndarray]
    fraction_used: float
    iterations_used: int | None
    cv_scores: list[tuple[float, float]] | None
    diagnostics: Diagnostics | None


def check(x, y, w=None) -> None:
    if len(x) == 0:
        raise InvalidData("empty series")
    if len(x) != len(y):
        raise InvalidData(f"x and y differ in length: {len(x)} and {len(y)}")
    if len(x) < 2:
        raise InvalidData(f"two points at least are needed: {len(x)}")
    for name, v in (("x", x), ("y", y)):
        if (bad := np.flatnonzero(~np.isfinite(v))).size:
            raise InvalidData(f"{name}[{bad[0]}] isn't finite: {v[bad[0]]}")
    if w is not None:
        if len(w) != len(x):
            raise InvalidData(f"weights and x differ in length: {len(w)} and {len(x)}")
        if (bad := np.flatnonzero(~(np.isfinite(w) & (w >= 0)))).size:
            raise InvalidData(f"weight[{bad[0]}] must be finite and not negative: {w[bad[0]]}")


def ols(x, y) -> np.ndarray:
    """The global line."""
    xm, ym = x.mean(), y.mean()
    var = float(((x - xm) ** 2).sum())
    return np.full(len(x), ym) if var <= 1e-12 else ym + ((x - xm) * (y - ym)).sum() / var * (x - xm)


def fit_sorted(x, y, w, o: Options, fraction: float, delta: float):
    """(fit, standard errors or None, robustness weights, iterations) of a series whose x is sorted."""
    n = len(x)
    if fraction >= 1:
        return ols(x, y), np.zeros(n) if o.wants_se else None, np.ones(n), 0
    q = span(n, fraction)
    px, py, pw, k = pad(x, y, w, q, o.boundary)
    at, copies = anchors(px, delta)
    local, between = LocalFits(px, py, at, q, pw, o), Between(px, at, copies)
    rw, fit, done = np.ones(len(px)), py, 0
    for t in range(o.iterations + 1):
        before, done = fit, t
        fit = between(local(rw if t else None))
        if o.auto_converge is not None and t and np.abs(fit - before).max() <= o.auto_converge:
            break
        if t < o.iterations:
            rw = robustness_weights(py - fit, o.robustness, o.scale)
    se = standard_errors(px, py, fit, q, rw, o.kernel)[k : k + n] if o.wants_se else None
    return fit[k : k + n], se, rw[k : k + n], done


def auto_delta(x: np.ndarray) -> float:
    return 0.01 * float(x[-1] - x[0])


def fit_series(x, y, w, o: Options) -> Fit:
    """Batch smoothing of one series in any order."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = None if w is None else np.asarray(w, float)
    check(x, y, w)
    order = np.argsort(x, kind="stable")
    sx, sy, sw = x[order], y[order], None if w is None else w[order]
    delta = auto_delta(sx) if o.delta is None else o.delta
    fraction, scores = o.fraction, None
    if o.cv is not None and o.cv_fractions:
        from tideline.operators.crossval import choose_fraction

        fraction, scores = choose_fraction(sx, sy, o, delta)
    fit, se, rw, done = fit_sorted(sx, sy, sw, o, fraction, delta)
    r = sy - fit
    bounds = intervals(fit, se, r, o) if se is not None else {}
    stats = diagnose(sy, fit, se) if o.diagnostics else None
    back = np.empty(len(x), np.int64)
    back[order] = np.arange(len(x))
    take = lambda v: None if v is None else v[back]
    return Fit(take(fit), take(r), take(rw), take(se), {k: v[back] for k, v in bounds.items()}, fraction, done if o.auto_converge is not None and fraction < 1 else None, scores, stats)


def _below(s: np.ndarray, v: np.ndarray, upto: bool = False) -> np.ndarray:
    """For each of v, how many of the sorted s of its row are smaller, or also as large."""
    n, flat = s.shape[1], s.ravel()
    base, found = np.arange(len(s))[:, None] * n - 1, np.zeros(v.shape, np.int64)
    for bit in reversed(range(n.bit_length())):
        more = found + (1 << bit)
        at = flat[base + np.minimum(more, n)]
        found = np.where((more <= n) & (at <= v if upto else at < v), more, found)
    return found


class BetweenRows:
    """:func:`anchors` and :class:`Between` of series of one length, a row each: ``at`` are the places, in
    the array of all, of the points that are fitted."""

    def __init__(self, x: np.ndarray, delta: float | np.ndarray):
        self.x, (many, n) = x, x.shape
        self.base = np.arange(many)[:, None] * n
        # without delta every point has the value of the first one that ties with it
        self.whole = bool(np.all(delta == 0))
        if self.whole:
            first = np.concatenate([np.ones((many, 1), bool), x[:, 1:] > x[:, :-1]], axis=1)
            self.at = (self.base + np.maximum.accumulate(np.where(first, np.arange(n), 0), axis=1)).ravel()
            return
        ties, ahead = _below(x, x, upto=True) - 1, _below(x, x + delta, upto=True)
        step = np.minimum(np.maximum(ahead - 1, ties + 1), n - 1)
        row, last = np.arange(many), np.zeros(many, np.int64)
        anchor, knot, source = np.zeros(x.shape, bool), np.zeros(x.shape, bool), np.tile(np.arange(n), (many, 1))
        while len(row):
            end = ties[row, last]
            anchor[row, last] = knot[row, last] = knot[row, end] = True
            source[row, end] = last
            row, last = row[end < n - 1], step[row, last][end < n - 1]
        self.at, self.source, self.knot = np.flatnonzero(anchor), self.base + source, knot
        self.left = self.base + np.maximum.accumulate(np.where(knot, np.arange(n), 0), axis=1)
        self.right = self.base + np.minimum.accumulate(np.where(knot, np.arange(n), n - 1)[:, ::-1], axis=1)[:, ::-1]

    def __call__(self, fit: np.ndarray) -> np.ndarray:
        if self.whole:
            return fit.reshape(self.x.shape)
        values, x = np.empty(self.x.size), self.x.ravel()
        values[self.at] = fit
        values = values[self.source]
        y0, y1, x0, x1 = values.ravel()[self.left], values.ravel()[self.right], x[self.left], x[self.right]
        with np.errstate(divide="ignore", invalid="ignore"):
            line = np.where(x1 > x0, y0 + (self.x - x0) / (x1 - x0) * (y1 - y0), np.where(y0 == y1, y0, 0.5 * (y0 + y1)))
        return np.where(self.knot, values, line)


def _fit_rows(x: np.ndarray, y: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`fit_series` gives the last point of each row: its value and robustness weight."""
    bad = np.flatnonzero(~(np.isfinite(x) & np.isfinite(y)).all(axis=1))
    if len(bad):
        check(x[bad[0]], y[bad[0]])
    many, n = x.shape
    last = (x <= x[:, -1:]).sum(axis=1) - 1  # in the order of x, behind those that tie
    if (x[:, 1:] < x[:, :-1]).any():
        order = np.argsort(x, axis=1, kind="stable")
        x, y = np.take_along_axis(x, order, axis=1), np.take_along_axis(y, order, axis=1)
    if o.fraction >= 1:
        xm, ym = x.mean(axis=1), y.mean(axis=1)
        dx = x - xm[:, None]
        var, with_y = (dx * dx).sum(axis=1), (dx * (y - ym[:, None])).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(var <= 1e-12, ym, ym + with_y / var * dx[np.arange(many), last]), np.ones(many)
    delta = 0.01 * (x[:, -1:] - x[:, :1]) if o.delta is None else o.delta
    q = span(n, o.fraction)
    x, y, _, k = pad(x, y, None, q, o.boundary)
    n = x.shape[1]
    q, between, ends = min(q, n), BetweenRows(x, delta), np.arange(many) * n + last + k
    left = np.broadcast_to(between.base, x.shape) if q >= n else between.base + _below(x[:, : n - q] + x[:, q:], 2 * x)
    fits = lambda at: LocalFits(x.ravel(), y.ravel(), at, q, None, o, left.ravel()[at])
    rw, fit, local, live = None, y, None, np.ones(many, bool)
    value, weight = np.empty(many), np.ones(many)
    for t in range(o.iterations + 1):
        if t == o.iterations and between.whole and o.auto_converge is None:
            return fits(between.at[ends])(rw), weight  # of the last pass nothing else is asked
        local = local or fits(between.at)
        before, fit = fit, between(local(rw))
        value[live] = fit.ravel()[ends[live]]
        if o.auto_converge is not None and t:
            live = live & ~(np.abs(fit - before).max(axis=1) <= o.auto_converge)
            if not live.any():
                break
        if t < o.iterations:
            rw = robustness_weights(y - fit, o.robustness, o.scale).ravel()
            weight[live] = rw[ends[live]]
    return value, weight


def fit_windows(x: np.ndarray, y: np.ndarray, rows: np.ndarray, sizes: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """The value and robustness weight that :func:`fit_series` gives the last point of each of the windows of
    ``sizes`` points that end at ``rows``. Windows of one size are worked out together."""
    fit, rw = np.empty(len(rows)), np.empty(len(rows))
    for size in np.unique(sizes).tolist():
        mine, q = np.flatnonzero(sizes == size), span(size, o.fraction)
        for part in np.array_split(mine, 1 + len(mine) * (size + q) * q // _PART):
            first = rows[part] - size + 1
            fit[part], rw[part] = _fit_rows(*(sliding_window_view(v, size)[first] for v in (x, y)), o)
    return fit, rw


def fit_last(x: np.ndarray, y: np.ndarray, o: Options) -> float:
    """The local fit at the last point of a window in order of arrival, as online updates make it."""
    n = len(x)
    q = max(2, min(n, math.ceil(o.fraction * n)))
    left, right, at = n - q, n - 1, x[-1]
    while left > 0 and x[right] - at > at - x[left - 1]:  # only where x falls
        left, right = left - 1, right - 1
    wx, wy = x[left : right + 1], y[left : right + 1]
    h = max(at - wx[0], wx[-1] - at)
    if h <= 0:
        return float(wy.mean())
    low, w = at - 0.999 * h, window_weight(np.abs(wx - at), h, o.kernel)
    # the scan takes x for sorted: what lies before the first x in reach and after the first beyond it is out
    near = np.flatnonzero(wx >= low)
    w[: near[0] if len(near) else len(w)] = 0
    far = np.flatnonzero((np.abs(wx - at) > 0.999 * h) & (wx > at))
    if len(far):
        w[far[0] :] = 0
    sw = w.sum()
    if sw <= 0:
        return float(wy.mean()) if o.fallback == "use_local_mean" else float(y[-1])
    dx = wx - at
    xm, ym = (w * dx).sum() / sw, (w * wy).sum() / sw
    var = (w * (dx - xm) ** 2).sum()
    if var <= max(1e-7, np.finfo(float).eps * h * h):
        return float(ym)
    return float(ym - (w * (dx - xm) * wy).sum() / var * xm)


def fit_last_of_windows(x: np.ndarray, y: np.ndarray, rows: np.ndarray, sizes: np.ndarray, o: Options) -> np.ndarray:
    """:func:`fit_last` of the windows of ``sizes`` points that end at ``rows``, whose last x is the largest."""
    q = np.maximum(2, np.minimum(sizes, np.ceil(o.fraction * sizes).astype(np.int64)))
    out = np.empty(len(rows))
    for width in np.unique(q).tolist():
        mine = np.flatnonzero(q == width)
        for part in np.array_split(mine, 1 + len(mine) * width // BLOCK):
            ends = rows[part]
            wx, wy = (sliding_window_view(v, width)[ends - width + 1] for v in (x, y))
            dx = wx - wx[:, -1:]
            h = -dx[:, 0]
            w = window_weight(np.abs(dx), h[:, None], o.kernel)
            sw = w.sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                xm, ym = (w * dx).sum(axis=1) / sw, (w * wy).sum(axis=1) / sw
                cx = w * (dx - xm[:, None])
                var = (cx * (dx - xm[:, None])).sum(axis=1)
                line = ym - (cx * wy).sum(axis=1) / var * xm
            got = np.where(var <= np.maximum(1e-7, np.finfo(float).eps * h * h), ym, line)
            got = np.where(sw <= 0, wy.mean(axis=1) if o.fallback == "use_local_mean" else wy[:, -1], got)
            out[part] = np.where(h <= 0, wy.mean(axis=1), got)
    return out
