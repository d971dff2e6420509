"""DuckDB SQL that computes a smoothing from its definition, by self-joins, to hold results against.

``fit`` unrolls the passes into common table expressions over a series ``(g, x, y)``. It says nothing of how
the engine computes them: every window is a range of ranks, every pass a join of points and windows.
"""

from __future__ import annotations

KERNEL = {
    "tricube": "pow(1 - pow({u}, 3), 3)",
    "epanechnikov": "1 - {u} * {u}",
    "gaussian": "greatest(exp(-0.5 * {u} * {u}), 2.2250738585072014e-308)",
    "biweight": "pow(1 - {u} * {u}, 2)",
    "triangle": "1 - {u}",
    "cosine": "cos(0.5 * pi() * {u})",
    "uniform": "1.0",
}


def kernel(u: str, name: str) -> str:
    return f"CASE WHEN {u} {'> 6' if name == 'gaussian' else '>= 1'} THEN 0.0 ELSE {KERNEL[name].format(u=f'({u})')} END"


def window_weight(d: str, h: str, name: str) -> str:
    return f"CASE WHEN {d} <= 0.001 * {h} THEN 1.0 WHEN {d} > 0.999 * {h} THEN 0.0 ELSE {kernel(f'({d} / {h})', name)} END"


def robustness(r: str, s: str, name: str) -> str:
    c = f"greatest(6 * {s}, 1e-12)"
    w = {
        "bisquare": f"CASE WHEN abs({r}) <= 0.001 * {c} THEN 1.0 WHEN abs({r}) <= 0.999 * {c} THEN pow(1 - pow(abs({r}) / {c}, 2), 2) ELSE 0.0 END",
        "huber": f"CASE WHEN abs({r}) <= 1.345 * {s} THEN 1.0 ELSE 1.345 * {s} / abs({r}) END",
        "talwar": f"CASE WHEN abs({r}) <= 2.5 * {s} THEN 1.0 ELSE 0.0 END",
    }[name]
    return f"(CASE WHEN {s} <= 0 THEN 1.0 ELSE {w} END)::DOUBLE"


def scale(rows: str, name: str) -> str:
    """(g, s) of residuals r in ``rows``, with the floor."""
    inner = {"mad": f"SELECT g, median(abs(r - m)) AS s, avg(abs(r)) AS a FROM (SELECT *, median(r) OVER (PARTITION BY g) AS m FROM {rows}) GROUP BY g", "mar": f"SELECT g, median(abs(r)) AS s, avg(abs(r)) AS a FROM {rows} GROUP BY g", "mean": f"SELECT g, avg(abs(r)) AS s, avg(abs(r)) AS a FROM {rows} GROUP BY g"}[name]
    return f"SELECT g, CASE WHEN s <= greatest(1e-7 * a, 1e-12) THEN greatest(a, s) ELSE s END AS s FROM ({inner})"


def pads(p: str, boundary: str, k: str, weighted: bool = False) -> list[str]:
    """{p}n: ranked points; {p}p: points with padding (g, rank, x, y, n, k, and w, 1 for padding)."""
    w, one = (", w", ", 1.0::DOUBLE") if weighted else ("", "")
    out = [
        f"{p}n AS (SELECT g, x, y{w}, row_number() OVER (PARTITION BY g ORDER BY x, y) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM {p}s)",
        f"{p}e AS (SELECT *, {'0' if boundary == 'noboundary' else k}::BIGINT AS k FROM (SELECT g, any_value(n) AS n, min(x) AS x0, max(x) AS xn, max(CASE WHEN i = 1 THEN x END) AS x1, max(CASE WHEN i = n - 2 THEN x END) AS xm, max(CASE WHEN i = 0 THEN y END) AS y0, max(CASE WHEN i = n - 1 THEN y END) AS yn FROM {p}n GROUP BY g))",
    ]
    body = f"SELECT g, i + k AS rank, x, y, n, k{w} FROM {p}n JOIN {p}e USING (g, n)"
    if boundary == "reflect":
        body += f" UNION ALL SELECT g, k - i, 2 * x0 - x, y, n, k{one} FROM {p}n JOIN {p}e USING (g, n) WHERE i BETWEEN 1 AND k"
        body += f" UNION ALL SELECT g, k + 2 * (n - 1) - i, 2 * xn - x, y, n, k{one} FROM {p}n JOIN {p}e USING (g, n) WHERE i BETWEEN n - 1 - k AND n - 2"
    elif boundary != "noboundary":
        ly, ry = ("y0", "yn") if boundary == "extend" else ("0.0", "0.0")
        body += f" UNION ALL SELECT g, k - j, x0 - j * (x1 - x0), {ly}, n, k{one} FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM {p}e)"
        body += f" UNION ALL SELECT g, k + n - 1 + j, xn + j * (xn - xm), {ry}, n, k{one} FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM {p}e)"
    return [*out, f"{p}p AS ({body})"]


def anchors(p: str, delta: float | None) -> list[str]:
    """{p}a: the points of {p}p that are fitted, as (g, rank, x, y, q, total)."""
    out = [f"{p}d AS (SELECT g, {'0.01 * (max(x) - min(x))' if delta is None else f'{delta}::DOUBLE'} AS delta FROM {p}s GROUP BY g)"]
    if delta == 0:
        return [*out, f"{p}a AS (SELECT g, rank, x, y, q, total FROM {p}q QUALIFY row_number() OVER (PARTITION BY g, x ORDER BY rank) = 1)"]
    return [
        *out,
        f"{p}j AS (SELECT g, rank, x, y, q, total, least(total - 1, greatest(max(rank) OVER (PARTITION BY g ORDER BY x RANGE BETWEEN CURRENT ROW AND delta FOLLOWING), 1 + max(rank) OVER (PARTITION BY g, x))) AS nxt FROM {p}q JOIN {p}d USING (g))",
        f"{p}a AS (SELECT g, rank, x, y, q, total, nxt FROM {p}j WHERE rank = 0 UNION ALL SELECT b.g, b.rank, b.x, b.y, b.q, b.total, b.nxt FROM {p}a JOIN {p}j b ON {p}a.g = b.g AND {p}a.nxt = b.rank WHERE {p}a.nxt > {p}a.rank)",
    ]


def windows(p: str) -> list[str]:
    """{p}w: each fitted point with its window's first rank l and bandwidth h."""
    return [
        f"{p}z AS (SELECT a.g, a.x + b.x AS s FROM {p}q a JOIN {p}q b ON a.g = b.g AND b.rank = a.rank + a.q)",
        f"{p}l AS (SELECT a.g, a.rank, a.x, a.y, a.q, least(a.total - a.q, count(z.s)) AS l FROM {p}a a LEFT JOIN {p}z z ON a.g = z.g AND z.s < 2 * a.x GROUP BY a.g, a.rank, a.x, a.y, a.q, a.total)",
        f"{p}w AS (SELECT l.*, greatest(l.x - a.x, b.x - l.x) AS h FROM {p}l l JOIN {p}q a ON l.g = a.g AND a.rank = l.l JOIN {p}q b ON l.g = b.g AND b.rank = l.l + l.q - 1)",
    ]


def wls(rows: str, keys: str, instead: str = "avg(y)") -> str:
    """The weighted line at d = 0 of (d, y, k, h), or ``instead`` where all weights are 0."""
    return f"SELECT {keys}, CASE WHEN sum(k) <= 0 THEN {instead} WHEN h <= 0 OR sum(k * d * d) - sum(k * d) * sum(k * d) / sum(k) <= greatest(1e-7, 2.220446049250313e-16 * h * h) THEN sum(k * y) / sum(k) ELSE sum(k * y) / sum(k) - (sum(k * d * y) - sum(k * d) * sum(k * y) / sum(k)) / (sum(k * d * d) - sum(k * d) * sum(k * d) / sum(k)) * sum(k * d) / sum(k) END AS f FROM {rows} GROUP BY {keys}, h"


def fit(p: str = "", *, fraction: float = 0.67, iterations: int = 3, delta: float | None = None, kernel: str = "tricube", robust: str = "bisquare", scaling: str = "mad", boundary: str = "extend", weighted: bool = False, fallback: str = "use_local_mean", converge: float | None = None) -> list[str]:
    """CTEs from {p}s (g, x, y) to {p}f: g, i, x, y, fit, rw of every point, i from 0 in the order of x; and
    {p}o, the same of the padded points with rank and k in place of i. With ``converge`` each series stops at
    the first pass that changes no value by more, and has that pass as t."""
    w = ", b.w" if weighted else ""
    span = f"greatest(2, least(n, floor({fraction} * n + 1e-5)))::BIGINT"
    out = pads(p, boundary, f"least({span} // 2, n - 1)", weighted)
    out.append(f"{p}q AS (SELECT *, least({span}, total)::BIGINT AS q FROM (SELECT *, n + 2 * k AS total FROM {p}p))")
    out += [*anchors(p, delta), *windows(p)]
    last = None
    for t in range(iterations + 1):
        weight = window_weight("abs(b.x - w.x)", "w.h", kernel)
        k = f"(CASE WHEN w.h > 0 THEN {weight} ELSE 1.0 END)" + (" * b.rw" if last else "") + (" * b.w" if weighted else "")
        out.append(f"{p}k{t} AS (SELECT w.g, w.rank, w.x, w.h, w.y AS y0, b.x - w.x AS d, b.y, {k} AS k FROM {p}w w JOIN {last or f'{p}q'} b ON w.g = b.g AND b.rank BETWEEN w.l AND w.l + w.q - 1)")
        out.append(f"{p}v{t} AS (SELECT *, lead(x) OVER (PARTITION BY g ORDER BY rank) AS x2, lead(f) OVER (PARTITION BY g ORDER BY rank) AS f2 FROM ({wls(f'{p}k{t}', 'g, rank, x', 'avg(y)' if fallback == 'use_local_mean' else 'max(y0)')}))")
        out.append(f"{p}r{t} AS (SELECT *, y - fit AS r FROM (SELECT b.g, b.rank, b.k AS pad, b.x, b.y, b.n{w}, CASE WHEN b.x = v.x OR v.x2 IS NULL THEN v.f ELSE v.f + (b.x - v.x) / (v.x2 - v.x) * (v.f2 - v.f) END AS fit, {'c.rw' if last else '1.0::DOUBLE AS rw'} FROM {p}q b {f'JOIN {last} c ON b.g = c.g AND b.rank = c.rank' if last else ''} ASOF JOIN {p}v{t} v ON b.g = v.g AND b.x >= v.x))")
        if t < iterations:
            out.append(f"{p}m{t} AS ({scale(f'{p}r{t}', scaling)})")
            last = f"{p}t{t}"
            out.append(f"{last} AS (SELECT q.g, q.rank, q.x, q.y{w.replace('b.', 'q.')}, {robustness('q.r', 'm.s', robust)} AS rw FROM {p}r{t} q JOIN {p}m{t} m ON q.g = m.g)")
    end = f"{p}r{iterations}"
    if converge is not None:
        changes = " UNION ALL ".join(f"SELECT a.g, {t} AS t, max(abs(a.fit - b.fit)) AS e FROM {p}r{t - 1} a JOIN {p}r{t} b ON a.g = b.g AND a.rank = b.rank GROUP BY a.g" for t in range(1, iterations + 1))
        out.append(f"{p}y AS (SELECT g, coalesce(min(CASE WHEN e <= {converge} THEN t END), {iterations}) AS t FROM ({changes}) GROUP BY g)")
        end = "(" + " UNION ALL ".join(f"SELECT r.*, {p}y.t FROM {p}r{t} r JOIN {p}y ON r.g = {p}y.g AND {p}y.t = {t}" for t in range(1, iterations + 1)) + ")"
    t = ", t" if converge is not None else ""
    out.append(f"{p}o AS (SELECT g, rank, pad AS k, n, x, y, fit, rw{t} FROM {end})")
    out.append(f"{p}f AS (SELECT g, rank - k AS i, n, x, y, fit, rw{t} FROM {p}o WHERE rank >= k AND rank < k + n)")
    return out


def query(ctes: list[str], select: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {select}"
