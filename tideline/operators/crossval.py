"""Choice of the span by cross-validation."""

from __future__ import annotations

import numpy as np

from tideline.options import Options


def shuffled(n: int, seed: int | None) -> np.ndarray:
    """A permutation by a 64-bit congruential generator, reproducible for a seed; in order without one."""
    out = list(range(n))
    if seed is not None:
        state = seed & (2**64 - 1)
        for i in range(n - 1, 0, -1):
            state = (state * 6364136223846793005 + 1) & (2**64 - 1)
            j = (state >> 32) % (i + 1)
            out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def folds(n: int, o: Options) -> list[np.ndarray]:
    """Test indices, into sorted x, of every fold; the last k-fold takes the remainder."""
    if o.cv == "loocv":
        return [np.array([i]) for i in range(n)]
    order, size = shuffled(n, o.cv_seed), n // o.cv_k
    return [order[f * size : n if f == o.cv_k - 1 else (f + 1) * size] for f in range(o.cv_k)]


def predict(x: np.ndarray, fit: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Between points on a line, beyond the ends constant."""
    return np.interp(at, x, fit)


def predict_forward(x: np.ndarray, fit: np.ndarray, at: np.ndarray) -> np.ndarray:
    """With a bracket that never moves back, so points below it are extrapolated from it."""
    out, left = np.empty(len(at)), 0
    for k, v in enumerate(at):
        if v <= x[0]:
            out[k] = fit[0]
        elif v >= x[-1]:
            out[k] = fit[-1]
        else:
            while left + 1 < len(x) - 1 and x[left + 1] <= v:
                left += 1
            gap = x[left + 1] - x[left]
            out[k] = 0.5 * (fit[left] + fit[left + 1]) if gap <= 0 else fit[left] + (v - x[left]) / gap * (fit[left + 1] - fit[left])
    return out


def fold_error(x, y, test: np.ndarray, fraction: float, o: Options, delta: float) -> float:
    """Sum of squared errors on the test points of a fit to the others, without case weights."""
    from tideline.operators.kernel import fit_sorted

    keep = np.ones(len(x), bool)
    keep[test] = False
    tx, ty = x[keep], y[keep]
    fit = fit_sorted(tx, ty, None, o, fraction, delta)[0] if len(tx) > 1 else ty
    how = predict_forward if o.cv_compat and o.cv_seed is not None else predict
    return float(((y[test] - how(tx, fit, x[test])) ** 2).sum())


def combine(errors: list[float], sizes: list[int], kind: str) -> float:
    """k-fold: the mean of the folds' root mean squared errors; leave-one-out: the root of the mean."""
    if kind == "loocv":
        return float(np.sqrt(np.mean(errors)))
    return float(np.mean([np.sqrt(e / s) for e, s in zip(errors, sizes, strict=True)]))


def choose_fraction(x, y, o: Options, delta: float) -> tuple[float, list[tuple[float, float]]]:
    """The first fraction of least score, and all scores."""
    if o.cv == "kfold" and len(x) < o.cv_k:
        return o.cv_fractions[0], [(f, 0.0) for f in o.cv_fractions]
    parts = folds(len(x), o)
    scores = [combine([fold_error(x, y, t, f, o, delta) for t in parts], [len(t) for t in parts], o.cv) for f in o.cv_fractions]
    return o.cv_fractions[int(np.argmin(scores))], list(zip(o.cv_fractions, scores, strict=True))
