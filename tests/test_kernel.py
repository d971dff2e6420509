import math
import os

import numpy as np
import pytest

from tideline.operators import crossval, kernel
from tideline.options import InvalidData, InvalidOption, Options, parse_option

HERE = os.path.join(os.path.dirname(__file__), "fixtures")
GOLDEN = np.load(f"{HERE}/golden.npz")
CASES = np.load(f"{HERE}/options.npz")


@pytest.mark.parametrize("name", sorted({k.split("/")[0] for k in GOLDEN.files}))
def test_golden(name):
    (x, y, want), (fraction, iterations, direct) = GOLDEN[f"{name}/xyf"], GOLDEN[f"{name}/options"]
    o = Options.of(fraction=fraction, iterations=int(iterations), boundary="noboundary", scale="mar", delta=0 if direct else None)
    assert np.abs(kernel.fit_series(x, y, None, o).y_smooth - want).max() < 1e-10


def case(file, column, **options):
    return pytest.param(file, column, options, id=f"{file}-{column}")


@pytest.mark.parametrize(
    "file,column,options",
    [
        *(case("boundary", f"y_{p}", boundary=p, fraction=0.4) for p in ("extend", "reflect", "zero", "noboundary")),
        *(case("kernel", f"y_{k}", kernel=k, fraction=0.3) for k in ("tricube", "gaussian", "uniform", "cosine", "epanechnikov", "biweight", "triangle")),
        *(case("robust_method", f"y_{m}", robustness=m, scale="mean", iterations=5, fraction=0.3) for m in ("bisquare", "huber", "talwar")),
        case("robust_iter", "y_non_robust", iterations=0, fraction=0.25),
        case("robust_iter", "y_robust", iterations=6, fraction=0.25),
        case("scaling", "y_none", iterations=0, fraction=0.3),
        *(case("scaling", f"y_{s}", scale=s, iterations=5, fraction=0.3) for s in ("mad", "mar", "mean")),
        case("surface_mode", "y_direct", delta=0.0, fraction=0.2),
        case("surface_mode", "y_interpolation", delta=1.5, fraction=0.2),
        *(case("fraction", f"y_frac_{f}", boundary="reflect", iterations=2, fraction=f) for f in (0.2, 0.5, 0.9)),
        case("gap_handling", "y_smooth", fraction=0.3),
    ],
)
def test_option_families(file, column, options):
    got = kernel.fit_series(CASES[f"{file}/x"], CASES[f"{file}/y_noisy"], None, Options.of(**options)).y_smooth
    assert np.abs(got - CASES[f"{file}/{column}"]).max() < 1e-6


@pytest.mark.parametrize("column,fallback", [("y_local_mean", "use_local_mean"), ("y_return_original", "original"), ("y_return_none", "nan")])
def test_zero_weight_fallbacks(column, fallback):
    x, y = CASES["zero_weight/x"], CASES["zero_weight/y_noisy"]
    o = Options.of(fallback=fallback, robustness="talwar", fraction=0.1, delta=0, boundary="none", iterations=3)
    assert np.isfinite(kernel.fit_series(x, y, None, o).y_smooth).all()


def test_intervals():
    o = Options.of(fraction=0.3, iterations=2, boundary="reflect", confidence_level=0.95, prediction_level=0.95)
    f = kernel.fit_series(CASES["intervals/x"], CASES["intervals/y_noisy"], None, o)
    for ours, theirs in (("confidence_lower", "conf_lower"), ("confidence_upper", "conf_upper"), ("prediction_lower", "pred_lower"), ("prediction_upper", "pred_upper")):
        assert np.abs(f.bounds[ours] - CASES[f"intervals/{theirs}"]).max() < 1e-6


def literal(x, y, w, o):
    """The definition, point by point, without padding or skipping."""
    n, q = len(x), kernel.span(len(x), o.fraction)
    rw = np.ones(n)
    for t in range(o.iterations + 1):
        fit = np.empty(n)
        for i in range(n):
            lo, hi = 0, q - 1
            while hi < n - 1 and x[i] - x[lo] > x[hi + 1] - x[i]:
                lo, hi = lo + 1, hi + 1
            h = max(x[i] - x[lo], x[hi] - x[i])
            ws = np.array([(1.0 if h <= 0 else float(kernel.window_weight(np.array([abs(x[j] - x[i])]), h, o.kernel)[0])) * (rw[j] if t else 1) * (1 if w is None else w[j]) for j in range(lo, hi + 1)])
            xs, ys = x[lo : hi + 1] - x[i], y[lo : hi + 1]
            if ws.sum() <= 0:
                fit[i] = ys.mean()
                continue
            xm, ym = (ws * xs).sum() / ws.sum(), (ws * ys).sum() / ws.sum()
            var = (ws * (xs - xm) ** 2).sum()
            fit[i] = ym if h <= 0 or var <= max(1e-7, 2.2e-16 * h * h) else ym - (ws * (xs - xm) * ys).sum() / var * xm
        if t < o.iterations:
            rw = kernel.robustness_weights(y - fit, o.robustness, o.scale)
    return fit


@pytest.mark.parametrize("seed", range(12))
def test_against_the_definition(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 60))
    x = np.sort([rng.normal(size=n), rng.integers(0, 9, n).astype(float), np.round(rng.normal(size=n), 1)][seed % 3])
    y, w = rng.normal(size=n), rng.integers(0, 3, n).astype(float) if rng.random() < 0.5 else None
    o = Options.of(fraction=float(rng.uniform(0.1, 0.99)), iterations=int(rng.integers(0, 4)), delta=0, boundary="none", kernel=str(rng.choice(["tricube", "uniform", "gaussian"])))
    want = literal(x, y, w, o)
    want = want[np.searchsorted(x, x, "left")]  # points that tie have one value
    assert np.allclose(kernel.fit_series(x, y, w, o).y_smooth, want, atol=1e-9)


def test_order_weights_and_ties():
    rng = np.random.default_rng(3)
    x, y, w = rng.normal(size=80), rng.normal(size=80), rng.uniform(size=80)
    o = Options.of(fraction=0.4, standard_error=True)
    order = np.argsort(x)
    a, b = kernel.fit_series(x, y, w, o), kernel.fit_series(x[order], y[order], w[order], o)
    assert np.allclose(a.y_smooth[order], b.y_smooth) and np.allclose(a.standard_error[order], b.standard_error)
    f = kernel.fit_series([1, 1, 2, 2, 3], [2, 2.1, 4, 3.9, 6], None, Options.of(fraction=0.7))
    assert f.y_smooth[0] == f.y_smooth[1] and f.y_smooth[2] == f.y_smooth[3]


def test_edges():
    assert np.allclose(kernel.fit_series([0, 1], [1, 3], None, Options.of()).y_smooth, [1, 3])
    o = Options.of(fraction=1, confidence_level=0.9)
    f = kernel.fit_series(np.arange(9.0), 2 * np.arange(9.0) + 1, None, o)
    assert np.allclose(f.y_smooth, 2 * np.arange(9) + 1) and np.allclose(f.standard_error, 0) and (f.bounds["confidence_upper"] > f.bounds["confidence_lower"]).all()
    same = kernel.fit_series(np.ones(12), np.arange(12.0), None, Options.of(fraction=0.5))
    assert np.isfinite(same.y_smooth).all()
    assert np.isfinite(kernel.fit_series(np.arange(20.0), np.ones(20), np.zeros(20), Options.of()).y_smooth).all()
    wide = kernel.fit_series(np.arange(20.0), np.arange(20.0), None, Options.of(delta=100, boundary="none"))
    assert np.allclose(wide.y_smooth, np.arange(20.0))
    for bad in (([], []), ([1.0], [1.0]), ([1, 2], [1, math.nan]), ([1, math.inf], [1, 2])):
        with pytest.raises(InvalidData):
            kernel.fit_series(*bad, None, Options.of())
    with pytest.raises(InvalidData):
        kernel.fit_series([1, 2], [1, 2], [1, -1], Options.of())


def test_convergence_stops_early():
    x = np.arange(50.0)
    f = kernel.fit_series(x, 2 * x, None, Options.of(iterations=10, auto_converge=1e-6, fraction=0.5, boundary="none"))
    assert f.iterations_used == 1
    assert kernel.fit_series(x, 2 * x, None, Options.of(fraction=0.5)).iterations_used is None


def test_cross_validation():
    x, y = CASES["cv_fits/x"], CASES["cv_fits/y_noisy"]
    fractions = tuple(CASES["cv_scores/fraction"])
    f = kernel.fit_series(x, y, None, Options.of(cv="loocv", cv_fractions=fractions))
    assert np.allclose([s for _, s in f.cv_scores], CASES["cv_scores/loocv_rmse"], atol=1e-6)
    f = kernel.fit_series(x, y, None, Options.of(cv="kfold", cv_fractions=fractions, cv_seed=42, cv_compat=True))
    assert np.allclose([s for _, s in f.cv_scores], CASES["cv_scores/kfold_rmse"], atol=1e-6)
    a, b = (kernel.fit_series(x, y, None, Options.of(cv_fractions=fractions, cv_seed=s)).cv_scores for s in (1, 2))
    assert a != b and a == kernel.fit_series(x, y, None, Options.of(cv_fractions=fractions, cv_seed=1)).cv_scores
    assert sorted(crossval.shuffled(30, 5).tolist()) == list(range(30))
    assert kernel.fit_series(x[:3], y[:3], None, Options.of(cv_fractions=(0.5, 0.7))).fraction_used == 0.5


def test_options():
    assert parse_option("kernel", " BoxCar") == "uniform" and parse_option("merge", "LEFT") == "take_first"
    with pytest.raises(InvalidOption) as e:
        Options.of(fraction=0, iterations=2000, kernel="x", delta=-1, nothing=1)
    assert all(w in str(e.value) for w in ("fraction", "iterations", "kernel", "delta", "nothing"))
    for level, z in ((0.95, 1.96), (0.5, 0.6744897), (0.8, 1.2815516), (0.999, 3.2905267)):
        assert kernel.z_score(level) == pytest.approx(z, abs=1e-6)
