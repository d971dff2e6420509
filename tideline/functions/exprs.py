"""Kernels, weights, intervals and fit measures as Column expressions; all stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.options import parse_option

#: integrator, variance and roughness of each kernel on its support.
KERNELS = {
    "tricube": (81 / 70, 1 / 6, 6561 / 6916),
    "epanechnikov": (4 / 3, 4 / 15, 16 / 15),
    "gaussian": (math.sqrt(2 * math.pi), math.sqrt(2) * math.sqrt(math.pi), math.sqrt(math.pi)),
    "biweight": (16 / 15, 16 / 105, 256 / 315),
    "triangle": (1.0, 1 / 6, 2 / 3),
    "cosine": (4 / math.pi, 4 / math.pi - 32 / math.pi**3, 1.0),
    "uniform": (2.0, 2 / 3, 2.0),
}


def efficiency(kernel: str) -> float:
    """Asymptotic efficiency against the Epanechnikov kernel."""
    c, mu, r = KERNELS[parse_option("kernel", kernel)]
    ce, mue, re = KERNELS["epanechnikov"]
    return (re / r) ** 0.8 * (mue / mu) ** 0.4 * (c / ce) ** 2


def kernel_weight(u: Column, kernel: str = "tricube") -> Column:
    """K(u) for u >= 0: 0 from 1 on, for the Gaussian beyond 6."""
    name = parse_option("kernel", kernel)
    if name == "gaussian":
        return F.when(u > 6, 0.0).otherwise(F.greatest(F.exp(-0.5 * u * u), F.lit(2.2250738585072014e-308)))
    a = 1 - u * u * u
    k = {"tricube": a * a * a, "epanechnikov": 1 - u * u, "biweight": (1 - u * u) * (1 - u * u), "triangle": 1 - u, "cosine": F.cos(F.lit(math.pi / 2) * u), "uniform": F.lit(1.0)}[name]
    return F.when(u >= 1, 0.0).otherwise(k)


def window_weight(d: Column, h: Column, kernel: str = "tricube") -> Column:
    """Weight of a point at distance d under bandwidth h."""
    return F.when(d <= 0.001 * h, 1.0).when(d > 0.999 * h, 0.0).otherwise(kernel_weight(d / h, kernel))


def robustness_weight(r: Column, s: Column, robustness: str = "bisquare") -> Column:
    """Weight of a residual r under the scale s."""
    name, size = parse_option("robustness", robustness), F.abs(r)
    if name == "bisquare":
        c = F.greatest(6 * s, F.lit(1e-12))
        k = 1 - (size / c) * (size / c)
        w = F.when(size <= 0.001 * c, 1.0).when(size <= 0.999 * c, k * k).otherwise(0.0)
    elif name == "huber":
        w = F.when(size <= 1.345 * s, 1.0).otherwise(1.345 * s / size)
    else:
        w = F.when(size <= 2.5 * s, 1.0).otherwise(0.0)
    return F.when(s <= 0, 1.0).otherwise(w)


def floored_scale(scale: Column, mean_abs: Column) -> Column:
    """A scale, or the mean size of the residuals where it is next to nothing against that."""
    return F.when(scale <= F.greatest(1e-7 * mean_abs, F.lit(1e-12)), F.greatest(mean_abs, scale)).otherwise(scale)


def wls_value(sw: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, h: Column) -> Column:
    """The weighted line at the centre, from sums of weights and products of x - centre and y."""
    var = sxx - sx * sx / sw
    flat = (h <= 0) | (var <= F.greatest(F.lit(1e-7), F.lit(2.220446049250313e-16) * h * h))
    return F.when(flat, sy / sw).otherwise(sy / sw - (sxy - sx * sy / sw) / var * (sx / sw))


def interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """On the line between two points; their mean where they have one x."""
    return F.when(x1 > x0, y0 + (x - x0) / (x1 - x0) * (y1 - y0)).otherwise(0.5 * (y0 + y1))


def interval(fit: Column, width: Column, z: float) -> tuple[Column, Column]:
    low, high = fit - z * width, fit + z * width
    return low, F.when(high > low, high).otherwise(low + 1e-12)


def measures(y: Column, fit: Column) -> list[Column]:
    """n, rmse, mae and residual SD (of the median absolute deviation) as aggregates."""
    r = y - fit
    return [F.count("*").alias("n"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae")]


def aic(n: Column, rss: Column, df: Column) -> Column:
    return F.when(rss <= 0, float("inf")).otherwise(n * F.log(rss / n) + 2 * df)


def aicc(n: Column, rss: Column, df: Column) -> Column:
    left = n - df - 1
    return F.when(left <= 0, float("inf")).otherwise(aic(n, rss, df) + 2 * df * (df + 1) / left)
