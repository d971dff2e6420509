"""Batch smoothing of many series: one grouped task a series, NumPy inside.

Only the columns that the kernel needs and those asked for cross into Python, as Arrow. A span of the
whole series is a line and never leaves the JVM. A single series beyond the memory of a task goes to
:func:`tideline.plans.relational.smooth_large`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import kernel
from tideline.operators.crossval import combine, fold_error, folds
from tideline.options import InvalidOption, Options
from tideline.sources.series import numeric

_DIAGNOSTICS = ("rmse", "mae", "r_squared", "aic", "aicc", "effective_df", "residual_sd")
SUMMARY = "n long, fraction_used double, iterations_used int, cv_scores array<struct<fraction:double,score:double>>, diagnostics struct<" + ",".join(f"{d}:double" for d in _DIAGNOSTICS) + ">"


def result_fields(o: Options) -> list[str]:
    out = ["y_smooth", "residual", "robustness_weight"]
    if o.wants_se:
        out.append("standard_error")
    for name in ("confidence", "prediction"):
        if getattr(o, f"{name}_level") is not None:
            out += [f"{name}_lower", f"{name}_upper"]
    return out


def prepared(df: DataFrame, x: str, y: str, by: Sequence[str], weight: str | None, dropna: bool, drop: Sequence[str] = ()) -> DataFrame:
    """The input with __x, __y and __w as doubles, without result columns of an earlier run."""
    if clash := {x, y, weight, *by} & set(drop):
        raise InvalidOption(f"columns have names of results: {', '.join(sorted(c for c in clash if c))}")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in drop]
    out = df.select(*keep, numeric(df, x).alias("__x"), numeric(df, y).alias("__y"), *([numeric(df, weight).alias("__w")] if weight else []))
    if dropna:
        good = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("__x", "__y")]
        out = out.where(good[0] & good[1])
    return out


def _arrays(group: pa.Table):
    read = lambda c: group.column(c).to_numpy().astype(float)
    return read("__x"), read("__y"), read("__w") if "__w" in group.column_names else None


def smooth(df: DataFrame, x: str, y: str, by: Sequence[str] = (), weight: str | None = None, *, dropna: bool = False, **options) -> DataFrame:
    """``df`` with ``y_smooth``, ``residual`` and ``robustness_weight`` (and standard errors and interval
    bounds as asked) added, every row smoothed within its series of equal ``by``.

    Null keys are a series. Null or non-finite values raise an error, or are dropped with ``dropna``. x may
    be a timestamp or date. Rows come in no order. An empty input gives no rows; other columns pass through.
    """
    o = Options.of(**options)
    by, fields = list(by), result_fields(o)
    base = prepared(df, x, y, by, weight, dropna, fields)
    own = [c for c in base.columns if not c.startswith("__")]
    if o.fraction >= 1 and not o.cv_fractions and not o.wants_se:
        return _line(base, own, by, weight is not None)
    schema = T.StructType([*(base.schema[c] for c in own), *(T.StructField(f, T.DoubleType()) for f in fields)])

    def run(group):
        f = kernel.fit_series(*_arrays(group), o)
        values = {"y_smooth": f.y_smooth, "residual": f.residual, "robustness_weight": f.robustness_weight, "standard_error": f.standard_error, **f.bounds}
        return pa.table({**{c: group.column(c) for c in own}, **{n: pa.array(values[n]) for n in fields}})

    return base.groupBy(*(by or [F.lit(0).alias("__all")])).applyInArrow(run, schema)


def _line(base: DataFrame, own: list[str], by: list[str], weighted: bool = False) -> DataFrame:
    """Least squares over the whole series, by aggregates alone, which check the data as well. Joined back
    on the keys, null-safe. Weights take no part but are checked."""
    infinite = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    wrong = [F.sum(infinite(c).cast("int")).alias(f"__bad{c}") for c in ("__x", "__y")]
    wrong.append(F.sum((infinite("__w") | (F.col("__w") < 0)).cast("int") if weighted else F.lit(0)).alias("__bad__w"))
    stats = base.groupBy(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(by))).agg(F.count("*").alias("__n"), *wrong, F.avg("__x").alias("__xm"), F.avg("__y").alias("__ym"), (F.var_pop("__x") * F.count("__x")).alias("__var"), (F.covar_pop("__x", "__y") * F.count("__x")).alias("__cov"))
    fault = (
        F.when(F.col("__n") < 2, F.concat(F.lit("two points at least are needed: "), F.col("__n")))
        .when(F.col("__bad__x") > 0, F.concat(F.lit("x isn't finite in rows: "), F.col("__bad__x")))
        .when(F.col("__bad__y") > 0, F.concat(F.lit("y isn't finite in rows: "), F.col("__bad__y")))
        .when(F.col("__bad__w") > 0, F.concat(F.lit("weight must be finite and not negative, in rows: "), F.col("__bad__w")))
    )
    stats = stats.withColumn("__ym", F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(F.col("__ym")))
    on = None
    for i, c in enumerate(by):
        same = F.col(f"`{c}`").eqNullSafe(F.col(f"__k{i}"))
        on = same if on is None else on & same
    both = base.join(stats, on) if by else base.join(F.broadcast(stats))  # one row
    fit = F.when(F.col("__var") <= 1e-12, F.col("__ym")).otherwise(F.col("__ym") + F.col("__cov") / F.col("__var") * (F.col("__x") - F.col("__xm")))
    return both.select(*(F.col(f"`{c}`") for c in own), fit.alias("y_smooth"), (F.col("__y") - fit).alias("residual"), F.lit(1.0).alias("robustness_weight"))


def concat_results(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of several results one after the other, by column name; columns that only some have are null in
    the others. What was used for the whole, fraction and iterations, is the first result's."""
    used = [c for c in ("fraction_used", "iterations_used") if c in first.columns]
    out = first
    for df in others:
        out = out.unionByName(df.drop(*used), allowMissingColumns=True)
    if used:  # one row
        kept = first.agg(*(F.max(c).alias(f"__{c}") for c in used))
        out = out.crossJoin(F.broadcast(kept)).select(*(F.col(f"__{c}").alias(c) if c in used else F.col(f"`{c}`") for c in out.columns))
    return out


def summarize(df: DataFrame, x: str, y: str, by: Sequence[str] = (), weight: str | None = None, *, dropna: bool = False, **options) -> DataFrame:
    """A row for each series: n, the fraction and iterations used, cross-validation scores, diagnostics."""
    from dataclasses import replace

    o, by = replace(Options.of(**options), diagnostics=True), list(by)
    base = prepared(df, x, y, by, weight, dropna).select(*(F.col(f"`{c}`") for c in by), "__x", "__y", *(["__w"] if weight else []))
    schema = T.StructType([*(base.schema[c] for c in by), *T._parse_datatype_string(SUMMARY).fields])

    def run(group):
        f = kernel.fit_series(*_arrays(group), o)
        row = {"n": group.num_rows, "fraction_used": f.fraction_used, "iterations_used": f.iterations_used, "cv_scores": None if f.cv_scores is None else [{"fraction": a, "score": b} for a, b in f.cv_scores], "diagnostics": {d: getattr(f.diagnostics, d) for d in _DIAGNOSTICS}}
        types = {"n": pa.int64(), "fraction_used": pa.float64(), "iterations_used": pa.int32(), "cv_scores": pa.list_(pa.struct([("fraction", pa.float64()), ("score", pa.float64())])), "diagnostics": pa.struct([(d, pa.float64()) for d in _DIAGNOSTICS])}
        return pa.table({**{c: group.column(c).slice(0, 1) for c in by}, **{k: pa.array([v], types[k]) for k, v in row.items()}})

    return base.groupBy(*(by or [F.lit(0).alias("__all")])).applyInArrow(run, schema)


def cross_validate(df: DataFrame, x: str, y: str, by: Sequence[str] = (), *, fractions: Sequence[float], dropna: bool = False, **options) -> DataFrame:
    """``by``, fraction, score, and whether it is the best: a task for each series and fraction."""
    o, by = Options.of(cv_fractions=fractions, **options), list(by)
    base = prepared(df, x, y, by, None, dropna).select(*(F.col(f"`{c}`") for c in by), "__x", "__y", F.explode(F.array(*(F.lit(float(f)) for f in fractions))).alias("fraction"))
    schema = T.StructType([*(base.schema[c] for c in by), T.StructField("fraction", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(group):
        gx, gy, _ = _arrays(group)
        kernel.check(gx, gy)
        order = np.argsort(gx, kind="stable")
        gx, gy, f = gx[order], gy[order], group.column("fraction")[0].as_py()
        delta = kernel.auto_delta(gx) if o.delta is None else o.delta
        if o.cv == "kfold" and len(gx) < o.cv_k:
            score = 0.0
        else:
            parts = folds(len(gx), o)
            score = combine([fold_error(gx, gy, t, f, o, delta) for t in parts], [len(t) for t in parts], o.cv)
        return pa.table({**{c: group.column(c).slice(0, 1) for c in by}, "fraction": pa.array([f]), "score": pa.array([score])})

    scores = base.groupBy(*by, "fraction").applyInArrow(run, schema)
    place = F.array_position(F.array(*(F.lit(float(f)) for f in fractions)), F.col("fraction"))
    best = scores.groupBy(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(by))).agg(F.min_by("fraction", F.struct("score", place)).alias("__best"))
    on = None
    for i, c in enumerate(by):
        same = F.col(f"`{c}`").eqNullSafe(F.col(f"__k{i}"))
        on = same if on is None else on & same
    both = scores.join(best, on) if by else scores.join(F.broadcast(best))
    return both.select(*(F.col(f"`{c}`") for c in by), "fraction", "score", (F.col("fraction") == F.col("__best")).alias("is_best"))
