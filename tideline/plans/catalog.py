"""Queries over the driver's tables, one or more for each operator, and the SQL that gives the same rows.

``hourly`` is the mean of ``events.value`` for each type and hour, series of some hundreds of points: the work
of definitions in SQL grows with the square of the series. Leave-one-out, whose work grows with the cube, has
``daily`` means. Others take tables as they are. Doubles are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import exprs
from tideline.operators import batch, chunked, kernel
from tideline.options import InvalidOption, Options
from tideline.plans import oracle
from tideline.plans.padding import padded
from tideline.plans.relational import smooth_large

Query = Callable[[SparkSession, str], DataFrame]

DAILY_SQL = "SELECT event_type AS g, date_diff('day', DATE '1970-01-01', ts::DATE)::DOUBLE AS x, avg(value) AS y FROM events GROUP BY ALL"
HOURLY_SQL = "SELECT event_type AS g, (epoch_us(ts) // 3600000000)::DOUBLE AS x, avg(value) AS y FROM events GROUP BY ALL"
EVENTS_SQL = "SELECT event_type AS g, epoch_us(ts) / 1e6 AS x, value AS y FROM events"
RESIDUALS_SQL = "SELECT o_orderpriority AS g, o_orderkey, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS r FROM orders"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("g"), F.unix_date(F.to_date("ts")).cast("double").alias("x")).agg(F.avg("value").alias("y"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("g"), hour.cast("double").alias("x")).agg(F.avg("value").alias("y"))


def _round(df: DataFrame, *columns: str, to: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in columns})


def _hourly_fit(**options) -> Query:
    return lambda spark, d: _round(batch.smooth(hourly(spark, d), "x", "y", ["g"], **options).select("g", "x", "y_smooth", "robustness_weight"), "y_smooth", "robustness_weight")


def _hourly_fit_sql(**options) -> str:
    return oracle.query([f"s AS ({HOURLY_SQL})", *oracle.fit(**options)], "SELECT g, x, round(fit, 4) AS y_smooth, round(rw, 4) AS robustness_weight FROM f")


def _kernels() -> tuple[dict[str, Query], dict[str, str]]:
    out, sql = {}, {}
    for name in exprs.KERNELS:
        out[f"kernel_{name}"] = lambda spark, d, k=name: _round(_table(spark, d, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"), F.sum(exprs.kernel_weight(F.col("l_quantity") / 45, k)).alias("weight")), "weight")
        sql[f"kernel_{name}"] = f"SELECT l_quantity, count(*) AS n, round(sum({oracle.kernel('(l_quantity / 45)', name)}), 4) AS weight FROM lineitem GROUP BY 1"
    out["window_weights"] = lambda spark, d: _table(spark, d, "lineitem").groupBy("l_returnflag").agg(*(F.round(F.sum(exprs.window_weight(F.abs("l_discount"), F.lit(0.0731), k)), 4).alias(k) for k in exprs.KERNELS))
    sql["window_weights"] = "SELECT l_returnflag, " + ", ".join(f"round(sum({oracle.window_weight('abs(l_discount)', '0.0731::DOUBLE', k)}), 4) AS {k}" for k in exprs.KERNELS) + " FROM lineitem GROUP BY 1"
    return out, sql


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, "orders")
    means = orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    return orders.join(means, "o_orderpriority").select(F.col("o_orderpriority").alias("g"), "o_orderkey", (F.col("o_totalprice") - F.col("mean")).alias("r"))


def scales(residuals: DataFrame, name: str) -> DataFrame:
    """(g, s): the floored scale of each group's residuals, with exact medians."""
    size = F.abs(F.col("r"))
    if name == "mad":
        middle = residuals.groupBy("g").agg(F.median("r").alias("m"))
        raw = residuals.join(middle, "g").groupBy("g").agg(F.median(F.abs(F.col("r") - F.col("m"))).alias("s"), F.avg(size).alias("a"))
    else:
        raw = residuals.groupBy("g").agg((F.median(size) if name == "mar" else F.avg(size)).alias("s"), F.avg(size).alias("a"))
    return raw.select("g", exprs.floored_scale(F.col("s"), F.col("a")).alias("s"))


def _robust() -> tuple[dict[str, Query], dict[str, str]]:
    out, sql = {}, {}
    for name in ("mad", "mar", "mean"):
        out[f"scale_{name}"] = lambda spark, d, s=name: _round(scales(_residuals(spark, d), s), "s", to=2)
        sql[f"scale_{name}"] = f"WITH r AS ({RESIDUALS_SQL}) SELECT g, round(s, 2) AS s FROM ({oracle.scale('r', name)})"
    for name in ("bisquare", "huber", "talwar"):

        def weights(spark, d, n=name):
            rows = _residuals(spark, d)
            return rows.join(F.broadcast(scales(rows, "mean")), "g").select("g", "o_orderkey", F.round(exprs.robustness_weight(F.col("r"), F.col("s"), n), 4).alias("weight"))  # a row a priority, of which there are five

        out[f"robustness_{name}"] = weights
        sql[f"robustness_{name}"] = f"WITH r AS ({RESIDUALS_SQL}), m AS ({oracle.scale('r', 'mean')}) SELECT g, o_orderkey, round({oracle.robustness('r', 's', name)}, 4) AS weight FROM r JOIN m USING (g)"
    return out, sql


def _pads() -> tuple[dict[str, Query], dict[str, str]]:
    out, sql = {}, {}
    for name in ("extend", "reflect", "zero", "noboundary"):
        out[f"pad_{name}"] = lambda spark, d, b=name: _round(padded(hourly(spark, d), "x", "y", ["g"], 6, b), "x", "y")
        sql[f"pad_{name}"] = oracle.query([f"s AS ({HOURLY_SQL})", *oracle.pads("", name, "least(6, n - 1)")], "SELECT g, rank, round(x, 4) AS x, round(y, 4) AS y FROM p")
    return out, sql


_FITS = {
    **{f"local_fit_{k}": {"kernel": k, "iterations": 0, "delta": 0.0, "fraction": 0.4, "boundary": "noboundary"} for k in exprs.KERNELS},
    **{f"boundary_{b}": {"boundary": b, "iterations": 1, "delta": 0.0, "fraction": 0.5} for b in ("extend", "reflect", "zero", "noboundary")},
    **{f"robust_fit_{r}_{s}": {"robust": r, "scaling": s, "iterations": 2, "delta": 0.0, "fraction": 0.5} for r in ("bisquare", "huber", "talwar") for s in ("mad", "mar", "mean")},
    "delta_interpolation": {"delta": 3.0, "iterations": 2, "fraction": 0.5},
    "span_minimum": {"delta": 0.0, "iterations": 0, "fraction": 1e-6},
}


def _options(given: dict) -> dict:
    return {{"robust": "robustness", "scaling": "scale"}.get(k, k): v for k, v in given.items()}


def smooth_events(spark: SparkSession, d: str) -> DataFrame:
    out = batch.smooth(_table(spark, d, "events").select("event_id", "event_type", "ts", "value"), "ts", "value", ["event_type"])
    return _round(out.select("event_id", "event_type", "y_smooth", "residual"), "y_smooth", "residual", to=3)


def smooth_large_events(spark: SparkSession, d: str) -> DataFrame:
    out = smooth_large(_table(spark, d, "events").select("event_id", "ts", "value"), "ts", "value", fraction=0.3, iterations=1)
    return _round(out.select("event_id", "y_smooth"), "y_smooth", to=3)


def _events_back(select: str) -> str:
    """Joins a fit back to the events by its type and place."""
    return f"SELECT event_id, {select} FROM (SELECT *, row_number() OVER (PARTITION BY {{key}} ORDER BY ts, value) - 1 AS i FROM events) e JOIN f ON {{on}} e.i = f.i"


def ols_orders(spark: SparkSession, d: str) -> DataFrame:
    out = batch.smooth(_table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice"), "o_orderdate", "o_totalprice", ["o_orderpriority"], fraction=1.0)
    return _round(out.select("o_orderkey", "y_smooth"), "y_smooth", to=1)


OLS_SQL = """WITH s AS (SELECT o_orderkey, o_orderpriority AS g, epoch_us(o_orderdate) / 1e6 AS x, o_totalprice AS y FROM orders),
m AS (SELECT g, avg(x) AS xm, avg(y) AS ym, covar_pop(x, y) / var_pop(x) AS b FROM s GROUP BY g)
SELECT o_orderkey, round(ym + b * (x - xm), 1) AS y_smooth FROM s JOIN m USING (g)"""

_BOUNDS = {"fraction": 0.5, "iterations": 1, "delta": 0.0, "confidence_level": 0.95, "prediction_level": 0.95}


_LEVELS = {"intervals": (0.95, 0.95), "intervals_99": (0.99, 0.99), "intervals_90": (0.9, 0.9), "intervals_80": (0.8, 0.8), "intervals_shared_level": (0.9, 0.95)}
#: Two-sided normal quantiles: round values for usual levels, exact ones for others.
_Z = {0.99: 2.576, 0.95: 1.96, 0.9: 1.645, 0.8: 1.2815515655446004}
#: The quantile of this level is approximated to nine digits, so fewer are compared.
_DIGITS = {0.8: 2}


def _intervals(confidence: float, prediction: float) -> Query:
    names = ("standard_error", "confidence_lower", "confidence_upper", "prediction_lower", "prediction_upper")
    options, to = _BOUNDS | {"confidence_level": confidence, "prediction_level": prediction}, _DIGITS.get(prediction, 4)
    return lambda spark, d: _round(batch.smooth(hourly(spark, d), "x", "y", ["g"], **options).select("g", "x", *names), *names, to=to)


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    names = ("rmse", "mae", "r_squared", "aic", "aicc", "effective_df", "residual_sd")
    out = batch.summarize(hourly(spark, d), "x", "y", ["g"], **_BOUNDS)
    return _round(out.select("g", "n", "fraction_used", *(F.col(f"diagnostics.{c}").alias(c) for c in names)), *names)


def _se_ctes() -> list[str]:
    k = oracle.kernel("(abs(b.x - w.x) / w.h)", "tricube")
    return [
        f"s AS ({HOURLY_SQL})",
        *oracle.fit(fraction=0.5, iterations=1, delta=0.0),
        f"u AS (SELECT w.g, w.rank, w.h, sum({k} * b.rw) AS sw, sum({k} * b.rw * (b.y - b.fit) * (b.y - b.fit)) AS rr FROM w JOIN o b ON w.g = b.g AND b.rank BETWEEN w.l AND w.l + w.q - 1 GROUP BY ALL)",
        "e2 AS (SELECT u.g, u.rank, CASE WHEN u.h > 0 AND sw > 2 THEN sqrt(rr / (sw - 2) * (o.rw / sw)) ELSE 0.0 END AS se FROM u JOIN o ON u.g = o.g AND u.rank = o.rank)",
        "fe AS (SELECT f.*, e2.se FROM f JOIN e ON f.g = e.g JOIN e2 ON f.g = e2.g AND e2.rank = f.i + e.k)",
        "sd AS (SELECT g, 1.4826 * median(abs(r - m)) AS sd FROM (SELECT g, y - fit AS r, median(y - fit) OVER (PARTITION BY g) AS m FROM f) GROUP BY g)",
    ]




def _intervals_sql(level: float) -> str:
    z, to = _Z[level], _DIGITS.get(level, 4)
    return oracle.query(_se_ctes(), f"SELECT g, x, round(se, {to}) AS standard_error, round(fit - {z} * se, {to}) AS confidence_lower, round(fit + {z} * se, {to}) AS confidence_upper, round(fit - {z} * sqrt(se * se + sd * sd), {to}) AS prediction_lower, round(fit + {z} * sqrt(se * se + sd * sd), {to}) AS prediction_upper FROM fe JOIN sd USING (g)")


DIAGNOSTICS_SQL = oracle.query(
    [
        *_se_ctes(),
        "t1 AS (SELECT g, count(*) AS n, sum((y - fit) * (y - fit)) AS rss, avg(abs(y - fit)) AS mae, var_pop(y) * count(*) AS tss, sum(greatest(0, least(1, pow(se / sd, 2)))) AS df, any_value(sd) AS sd FROM fe JOIN sd USING (g) GROUP BY g)",
        "t2 AS (SELECT *, n * ln(rss / n) + 2 * df AS aic FROM t1)",
    ],
    "SELECT g, n, 0.5::DOUBLE AS fraction_used, round(sqrt(rss / n), 4) AS rmse, round(mae, 4) AS mae, round(1 - rss / tss, 4) AS r_squared, round(aic, 4) AS aic, round(CASE WHEN n - df - 1 <= 0 THEN 'infinity'::DOUBLE ELSE aic + 2 * df * (df + 1) / (n - df - 1) END, 4) AS aicc, round(df, 4) AS effective_df, round(sd, 4) AS residual_sd FROM t2",
)


def delta_anchors(spark: SparkSession, d: str) -> DataFrame:
    def run(group):
        x = group.column("x").sort().to_numpy()
        at, _ = kernel.anchors(x, 3.0)
        return pa.table({"g": pa.array([group.column("g")[0].as_py()] * len(at), pa.string()), "rank": pa.array(at), "x": pa.array(x[at])})

    return hourly(spark, d).select("g", "x").groupBy("g").applyInArrow(run, "g string, rank long, x double")


ANCHORS_SQL = oracle.query([f"s AS ({HOURLY_SQL})", *oracle.pads("", "noboundary", "0"), "q AS (SELECT *, n AS total, 2 AS q FROM p)", *oracle.anchors("", 3.0)], "SELECT g, rank, x FROM a")

_FRACTIONS = (0.3, 0.6)


def _cv(**options) -> Query:
    rows = daily if options["cv"] == "loocv" else hourly
    return lambda spark, d: _round(batch.cross_validate(rows(spark, d), "x", "y", ["g"], fractions=_FRACTIONS, iterations=1, delta=0.0, **options), "score", to=3)


#: Fold numbers from 0, and the fold of each point of d1 (g, x, y, i, n).
_FOLDS = {
    "kfold": ("SELECT unnest(range(5)) AS fold", [], "least(4, i // (n // 5))", "d1"),
    "loocv": ("SELECT DISTINCT i AS fold FROM d1", [], "i", "d1"),
    "seeded": (
        "SELECT unnest(range(5)) AS fold",
        [
            # a shuffle from the end by a 64-bit congruential generator: each step swaps places i and j
            "sw AS (SELECT n, n - 1 AS i, 42::HUGEINT AS state, range(n) AS o FROM (SELECT DISTINCT n FROM d1) UNION ALL SELECT n, i - 1, s, list_transform(o, lambda v, k: CASE WHEN k - 1 = i THEN o[j + 1] WHEN k - 1 = j THEN o[i + 1] ELSE v END) FROM (SELECT *, ((s // 4294967296) % (i + 1))::BIGINT AS j FROM (SELECT *, (state * 6364136223846793005 + 1) % 18446744073709551616 AS s FROM sw WHERE i > 0)))",
            "pos AS (SELECT n, unnest(o) AS i, unnest(range(len(o))) AS place FROM sw WHERE i = 0)",
        ],
        "least(4, place // (n // 5))",
        "d1 JOIN pos USING (n, i)",
    ),
}


def _cv_sql(kind: str) -> str:
    """Each point is predicted on the line between the fits to the points of other folds around it."""
    numbers, more, fold, rows = _FOLDS[kind]
    ctes = [f"d1 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM ({DAILY_SQL if kind == 'loocv' else HOURLY_SQL}))", *more, f"d0 AS (SELECT g, x, y, {fold} AS fold FROM {rows})", f"fold AS ({numbers})"]
    score = "sqrt(avg(r * r))" if kind == "loocv" else "avg(e)"
    parts = []
    for k, f in enumerate(_FRACTIONS):
        p = f"c{k}_"
        ctes += [f"{p}s AS (SELECT d0.g || '/' || fold.fold AS g, x, y FROM d0 JOIN fold ON d0.fold <> fold.fold)", *oracle.fit(p, fraction=f, iterations=1, delta=0.0)]
        ctes += [
            f"{p}g AS (SELECT g, x, fit, lead(x) OVER (PARTITION BY g ORDER BY x) AS x2, lead(fit) OVER (PARTITION BY g ORDER BY x) AS f2 FROM {p}f)",
            f"{p}h AS (SELECT g, arg_min(fit, x) AS first FROM {p}f GROUP BY g)",
            f"{p}y AS (SELECT d0.g, d0.fold, d0.y - CASE WHEN v.x IS NULL THEN h.first WHEN v.x2 IS NULL THEN v.fit ELSE v.fit + (d0.x - v.x) / (v.x2 - v.x) * (v.f2 - v.fit) END AS r FROM d0 JOIN {p}h h ON h.g = d0.g || '/' || d0.fold ASOF LEFT JOIN {p}g v ON v.g = d0.g || '/' || d0.fold AND d0.x >= v.x)",
        ]
        parts.append(f"SELECT g, {f}::DOUBLE AS fraction, {score} AS score FROM " + (f"{p}y GROUP BY g" if kind == "loocv" else f"(SELECT g, fold, sqrt(avg(r * r)) AS e FROM {p}y GROUP BY ALL) GROUP BY g"))
    return oracle.query([*ctes, f"z AS ({' UNION ALL '.join(parts)})"], "SELECT g, fraction, round(score, 3) AS score, fraction = arg_min(fraction, score) OVER (PARTITION BY g) AS is_best FROM z")


_CHUNK = {"chunk_size": 100, "overlap": 20, "fraction": 0.5, "iterations": 1}


_CHUNKS_END = "SELECT g, x, round(y, 4) AS y, round(fit, 4) AS y_smooth, round(y - fit, 4) AS residual, round(rw, 4) AS robustness_weight, chunk FROM b4"


def _chunks(merge: str) -> Query:
    return lambda spark, d: _round(chunked.smooth_chunked(hourly(spark, d), "x", "y", ["g"], merge=merge, **_CHUNK), "y", "y_smooth", "residual", "robustness_weight")


def _chunks_sql(merge: str) -> str:
    one = {"average": "(p{v} + c{v}) / 2", "weighted_average": "p{v} * (1 - a) + c{v} * a", "take_first": "p{v}", "take_last": "c{v}"}[merge]
    value = lambda v: f"CASE WHEN c{v} IS NULL THEN p{v} ELSE {one.format(v=v)} END"
    return oracle.query(
        [
            f"b0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x) - 1 AS pos FROM ({HOURLY_SQL}))",
            "b1 AS (SELECT *, pos // 100 AS c, false AS late FROM b0 UNION ALL SELECT *, pos // 100 + 1, true FROM b0 WHERE pos % 100 >= 80)",
            "b2 AS (SELECT *, g || '/' || c AS chunk FROM b1 QUALIFY NOT bool_and(late) OVER (PARTITION BY g, c))",
            "s AS (SELECT chunk AS g, x, y FROM b2)",
            *oracle.fit(fraction=0.5, iterations=1, delta=0.0),
            "b3 AS (SELECT b2.g, b2.x, b2.y, any_value(b2.pos) AS pos, max(CASE WHEN NOT late THEN fit END) AS pf, max(CASE WHEN late THEN fit END) AS cf, max(CASE WHEN NOT late THEN rw END) AS pr, max(CASE WHEN late THEN rw END) AS cr FROM b2 JOIN f ON f.g = b2.chunk AND f.x = b2.x GROUP BY ALL)",
            f"b4 AS (SELECT g, x, y, {value('f')} AS fit, {value('r')} AS rw, pos // 100 + (pos % 100 >= 80)::BIGINT AS chunk FROM (SELECT *, (pos % 100 - 80) / 20.0 AS a FROM b3))",
        ],
        _CHUNKS_END,
    )


def _online(update: str, min_points: int = 3, columns: tuple[str, ...] = ("robustness_weight",)) -> Query:
    def run(spark, d):
        events = _table(spark, d, "events").select("event_id", "user_id", "ts", "value")
        out = chunked.smooth_online(events, "ts", "value", ["ts", "event_id"], ["user_id"], window_capacity=20, min_points=min_points, fraction=0.5, iterations=1, update=update)
        return _round(out.select("event_id", "y_smooth", *columns), "y_smooth", *(c for c in columns if c != "window_size"))

    return run


def _online_sql(min_points: int, select: str) -> str:
    # a window of two points has its last value, or their mean where they tie
    two = "UNION ALL SELECT a.event_id, CASE WHEN a.x <> b.x THEN a.y ELSE (a.y + b.y) / 2 END FROM n a JOIN s b ON a.u = b.u AND b.i = a.i - 1 WHERE a.m = 2" if min_points == 2 else ""
    return f"""WITH s AS (SELECT event_id, user_id AS u, epoch_us(ts) / 1e6 AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
n AS (SELECT *, least(i, 20) AS m, greatest(2, least(least(i, 20), ceil(0.5 * least(i, 20))))::BIGINT AS q FROM s),
w AS (SELECT a.event_id, a.x - b.x AS h, a.u, a.i, a.x, a.q FROM n a JOIN s b ON a.u = b.u AND b.i = a.i - a.q + 1 WHERE a.m >= 3),
k AS (SELECT w.event_id, w.h, b.x - w.x AS d, b.y, CASE WHEN w.h > 0 THEN {oracle.window_weight("abs(b.x - w.x)", "w.h", "tricube")} ELSE 1.0 END AS k FROM w JOIN s b ON w.u = b.u AND b.i BETWEEN w.i - w.q + 1 AND w.i),
v AS ({oracle.wls("k", "event_id")} {two})
SELECT event_id, round(f, 4) AS y_smooth, {select} FROM n LEFT JOIN v USING (event_id)"""


def _online_full_sql() -> str:
    """Each event's window is a series of its own, of which the last value counts."""
    rows = "n0 AS (SELECT event_id, user_id AS u, epoch_us(ts) / 1e6 AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
    series = "s AS (SELECT a.event_id AS g, b.x, b.y FROM n0 a JOIN n0 b ON a.u = b.u AND b.i BETWEEN a.i - 19 AND a.i WHERE a.i >= 3)"
    return oracle.query([rows, series, *oracle.fit(fraction=0.5, iterations=1, delta=0.0)], "SELECT event_id, round(fit, 4) AS y_smooth, round(rw, 4) AS robustness_weight FROM n0 LEFT JOIN f ON n0.event_id = f.g AND f.i = f.n - 1")


def _chunk_measures(running: bool) -> Query:
    def run(spark, d):
        smoothed = chunked.smooth_chunked(hourly(spark, d), "x", "y", ["g"], merge="average", **_CHUNK)
        return _round(chunked.chunk_diagnostics(smoothed, "y", ["g"], running=running), "rmse", "mae", "r_squared", "residual_sd")

    return run


def chunk_measures_sql(running: bool = False) -> str:
    rows = _chunks_sql("average").removesuffix(_CHUNKS_END)
    source, keys = ("(SELECT b.g, c.chunk, b.y, b.fit FROM b4 b JOIN (SELECT DISTINCT g, chunk FROM b4) c ON b.g = c.g AND b.chunk <= c.chunk)", "g, chunk") if running else ("b4", "g")
    return rows + f"SELECT {keys}, count(*) AS n, round(sqrt(avg(pow(y - fit, 2))), 4) AS rmse, round(avg(abs(y - fit)), 4) AS mae, round(1 - sum(pow(y - fit, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 4) AS r_squared, round(stddev_samp(y - fit), 4) AS residual_sd FROM {source} GROUP BY {keys}"


#: Weights that vary, and weights of which a whole window is 0.
_WEIGHTS = {"varied": "0.25 + (x::BIGINT % 7) / 4.0", "gap": "CASE WHEN x::BIGINT % 240 BETWEEN 20 AND 219 THEN 0.0 ELSE 1.0 + (x::BIGINT % 3) / 2.0 END"}
_WEIGHTED = {
    "case_weights": ("varied", {"fraction": 0.5, "iterations": 1, "delta": 0.0}),
    "case_weights_robust": ("varied", {"fraction": 0.4, "iterations": 3, "boundary": "reflect"}),
    **{f"fallback_{f}": ("gap", {"fraction": 0.2, "iterations": 1, "delta": 0.0, "boundary": "noboundary", "fallback": f}) for f in ("use_local_mean", "return_original", "return_none")},
}


def _weighted(weights: str, options: dict) -> Query:
    def run(spark, d):
        rows = hourly(spark, d).withColumn("w", F.expr(_WEIGHTS[weights].replace("x::BIGINT", "cast(x AS BIGINT)")).cast("double"))
        return _round(batch.smooth(rows, "x", "y", ["g"], "w", **options).select("g", "x", "y_smooth", "robustness_weight"), "y_smooth", "robustness_weight")

    return run


def _weighted_sql(weights: str, options: dict) -> str:
    return oracle.query([f"s AS (SELECT *, ({_WEIGHTS[weights]})::DOUBLE AS w FROM ({HOURLY_SQL}))", *oracle.fit(weighted=True, **options)], "SELECT g, x, round(fit, 4) AS y_smooth, round(rw, 4) AS robustness_weight FROM f")


_CONVERGE = {"fraction": 0.5, "iterations": 6, "delta": 0.0}


def converged(spark: SparkSession, d: str) -> DataFrame:
    """Where the passes of each series stop, and the values there."""
    series, options = hourly(spark, d), _CONVERGE | {"auto_converge": 0.5}
    fits = batch.smooth(series, "x", "y", ["g"], **options).select("g", "x", "y_smooth", "robustness_weight")
    used = batch.summarize(series, "x", "y", ["g"], **options).select("g", F.col("iterations_used").cast("long").alias("iterations_used"))
    return _round(fits.join(used, "g"), "y_smooth", "robustness_weight")


CONVERGED_SQL = oracle.query([f"s AS ({HOURLY_SQL})", *oracle.fit(converge=0.5, **_CONVERGE)], "SELECT g, x, round(fit, 4) AS y_smooth, round(rw, 4) AS robustness_weight, t::BIGINT AS iterations_used FROM f")


def kernel_constants(spark: SparkSession, d: str) -> DataFrame:
    """The constants of each kernel and its efficiency; the SQL integrates numerically."""
    rows = [(k, *map(float, exprs.KERNELS[k]), float(exprs.efficiency(k))) for k in exprs.KERNELS]
    return _round(spark.createDataFrame(rows, "kernel string, integral double, variance double, roughness double, efficiency double"), "integral", "variance", "roughness", "efficiency")


def _kernel_constants_sql() -> str:
    parts = []
    for k in exprs.KERNELS:
        width = 9 if k == "gaussian" else 1
        value = oracle.KERNEL[k].format(u="u")
        parts.append(f"SELECT '{k}' AS kernel, 2 * avg(k) * {width} AS c, 2 * avg(u * u * k) * {width} AS m, 2 * avg(k * k) * {width} AS r FROM (SELECT u, {value} AS k FROM (SELECT (range + 0.5) / 20000 * {width} AS u FROM range(20000)))")
    return f"WITH k AS ({' UNION ALL '.join(parts)}), e AS (SELECT * FROM k WHERE kernel = 'epanechnikov') SELECT k.kernel, round(k.c, 4) AS integral, round(k.m, 4) AS variance, round(k.r, 4) AS roughness, round(pow(e.r / k.r, 0.8) * pow(e.m / k.m, 0.4) * pow(k.c / e.c, 2), 4) AS efficiency FROM k, e"


#: Options and values of them, of which the rules of the SQL say what is accepted.
_RANGES = {
    "fraction": ([-0.1, 0.0, 1e-9, 0.5, 1.0, 1.5], "v > 0 AND v <= 1"),
    "iterations": ([-1, 0, 3, 1000, 1001], "v BETWEEN 0 AND 1000"),
    "delta": ([-1.0, 0.0, 2.5], "v >= 0"),
    "auto_converge": ([-1.0, 0.0, 1e-9, 2.0], "v > 0"),
    "confidence_level": ([0.0, 0.5, 1.0, 1.5], "v > 0 AND v < 1"),
    "prediction_level": ([-0.5, 0.0, 0.999, 1.0], "v > 0 AND v < 1"),
    "cv_k": ([0, 1, 2, 10], "v >= 2"),
    "chunk_size": ([9, 501, 5000], "v >= 10 AND v > 500"),
    "overlap": ([-1, 0, 4999, 5000], "v BETWEEN 0 AND 4999"),
    "window_capacity": ([2, 3, 50], "v >= 3"),
    "min_points": ([1, 2, 1000, 1001], "v BETWEEN 2 AND 1000"),
    "cv_fractions": ([-0.5, 0.0, 0.3, 1.0, 2.0], "v > 0 AND v <= 1"),
}


def option_ranges(spark: SparkSession, d: str) -> DataFrame:
    def accepted(name, value) -> bool:
        try:
            Options.of(**{name: (value,) if name == "cv_fractions" else value})
        except InvalidOption:
            return False
        return True

    return spark.createDataFrame([(k, float(v), accepted(k, v)) for k, (values, _) in _RANGES.items() for v in values], "option string, value double, accepted boolean")


OPTION_RANGES_SQL = " UNION ALL ".join(f"SELECT '{k}' AS option, v AS value, ({rule}) AS accepted FROM (SELECT unnest([{', '.join(map(repr, map(float, values)))}]::DOUBLE[]) AS v)" for k, (values, rule) in _RANGES.items())

def queries() -> dict[str, Query]:
    return {
        "smooth_events": smooth_events,
        "smooth_large": smooth_large_events,
        "ols_line": ols_orders,
        **{name: _intervals(*levels) for name, levels in _LEVELS.items()},
        "diagnostics": diagnostics,
        "delta_anchors": delta_anchors,
        **{name: _weighted(*how) for name, how in _WEIGHTED.items()},
        "auto_converge": converged,
        "kernel_constants": kernel_constants,
        "option_ranges": option_ranges,
        "cv_kfold": _cv(cv="kfold"),
        "cv_kfold_seeded": _cv(cv="kfold", cv_seed=42),
        "cv_loocv": _cv(cv="loocv"),
        "chunk_diagnostics": _chunk_measures(False),
        "chunk_diagnostics_running": _chunk_measures(True),
        "online_incremental": _online("incremental"),
        "online_two_points": _online("incremental", 2, ("residual", "window_size")),
        "online_full": _online("full"),
        **{f"chunk_{m}": _chunks(m) for m in ("average", "weighted_average", "take_first", "take_last")},
        **{name: _hourly_fit(**_options(o)) for name, o in _FITS.items()},
        **_kernels()[0],
        **_robust()[0],
        **_pads()[0],
    }


def oracle_sql() -> dict[str, str]:
    return {
        "smooth_events": oracle.query([f"s AS ({EVENTS_SQL})", *oracle.fit()], _events_back("event_type, round(fit, 3) AS y_smooth, round(e.value - fit, 3) AS residual").format(key="event_type", on="e.event_type = f.g AND")),
        "smooth_large": oracle.query([f"s AS (SELECT 0 AS g, x, y FROM ({EVENTS_SQL}))", *oracle.fit(fraction=0.3, iterations=1)], _events_back("round(fit, 3) AS y_smooth").format(key="1", on="")),
        "ols_line": OLS_SQL,
        **{name: _intervals_sql(levels[1]) for name, levels in _LEVELS.items()},
        "diagnostics": DIAGNOSTICS_SQL,
        "delta_anchors": ANCHORS_SQL,
        **{name: _weighted_sql(*how) for name, how in _WEIGHTED.items()},
        "auto_converge": CONVERGED_SQL,
        "kernel_constants": _kernel_constants_sql(),
        "option_ranges": OPTION_RANGES_SQL,
        "cv_kfold": _cv_sql("kfold"),
        "cv_kfold_seeded": _cv_sql("seeded"),
        "cv_loocv": _cv_sql("loocv"),
        "chunk_diagnostics": chunk_measures_sql(),
        "chunk_diagnostics_running": chunk_measures_sql(running=True),
        "online_incremental": _online_sql(3, "CASE WHEN f IS NOT NULL THEN 1.0::DOUBLE END AS robustness_weight"),
        "online_two_points": _online_sql(2, "round(y - f, 4) AS residual, m AS window_size"),
        "online_full": _online_full_sql(),
        **{f"chunk_{m}": _chunks_sql(m) for m in ("average", "weighted_average", "take_first", "take_last")},
        **{name: _hourly_fit_sql(**o) for name, o in _FITS.items()},
        **_kernels()[1],
        **_robust()[1],
        **_pads()[1],
    }

