"""Options of the smoothers, their aliases and checks, and the errors they raise."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace


class SmoothingError(ValueError):
    """Any error of this package's own."""


class InvalidOption(SmoothingError):
    """Options that can't be used; names all of them at once."""


class InvalidData(SmoothingError):
    """Data that can't be smoothed."""


class UnsupportedFeature(SmoothingError):
    """An option that this mode doesn't have."""


_ALIASES = {
    "kernel": {"tricube": "", "epanechnikov": "", "gaussian": "", "biweight": "bisquare", "triangle": "triangular", "cosine": "", "uniform": "boxcar"},
    "robustness": {"bisquare": "biweight", "huber": "", "talwar": ""},
    "scale": {"mad": "median_absolute_deviation", "mar": "median_absolute_residual", "mean": "mean_absolute_residual"},
    "boundary": {"extend": "pad", "reflect": "mirror", "zero": "", "noboundary": "none"},
    "fallback": {"use_local_mean": "local_mean mean", "return_original": "original", "return_none": "none nan"},
    "merge": {"weighted_average": "weighted weightedaverage", "average": "mean", "take_first": "first takefirst left", "take_last": "last takelast right"},
    "update": {"incremental": "single", "full": "resmooth"},
    "cv": {"kfold": "k_fold k-fold", "loocv": "loo_cv loo-cv simple loo leave_one_out"},
}
_NAMES = {option: {alias: name for name, more in values.items() for alias in (name, *more.split())} for option, values in _ALIASES.items()}


def parse_option(option: str, value: str) -> str:
    """The canonical name of a value, whatever its case."""
    found = _NAMES[option].get(str(value).strip().lower())
    if found is None:
        raise InvalidOption(f"unknown {option}: {value!r} (one of {', '.join(_ALIASES[option])})")
    return found


@dataclass(frozen=True)
class Options:
    """How a series is smoothed. ``delta`` None means 1 % of the range of x.

    ``confidence_level`` and ``prediction_level`` share one level; if both are given the latter holds.
    ``cv_compat`` interpolates shuffled test points with a bracket that only moves forward.
    """

    fraction: float = 0.67
    iterations: int = 3
    delta: float | None = None
    kernel: str = "tricube"
    robustness: str = "bisquare"
    scale: str = "mad"
    boundary: str = "extend"
    fallback: str = "use_local_mean"
    auto_converge: float | None = None
    standard_error: bool = False
    confidence_level: float | None = None
    prediction_level: float | None = None
    diagnostics: bool = False
    cv: str | None = None
    cv_fractions: tuple[float, ...] = ()
    cv_k: int = 5
    cv_seed: int | None = None
    cv_compat: bool = False
    strict_none: bool = False
    chunk_size: int = 5000
    overlap: int = 500
    merge: str = "weighted_average"
    window_capacity: int = 1000
    min_points: int = 2
    update: str = "incremental"

    @classmethod
    def of(cls, **given) -> Options:
        """Checked options with canonical names. All faults are named together."""
        known, faults = {f.name for f in fields(cls)}, []
        for name in given.keys() - known:
            faults.append(f"unknown option: {name}")
        given = {k: v for k, v in given.items() if k in known}
        for name in _NAMES:
            if given.get(name) is not None:
                try:
                    given[name] = parse_option(name, given[name])
                except InvalidOption as e:
                    faults.append(str(e))
                    given.pop(name)
        if given.get("cv_fractions") is not None and not len(given["cv_fractions"]):
            faults.append("cv_fractions must name one fraction at least")
        given["cv_fractions"] = tuple(given.get("cv_fractions") or ())
        out = cls(**given)
        if out.cv_fractions and out.cv is None:
            out = replace(out, cv="kfold")
        faults += out._faults()
        if faults:
            raise InvalidOption("; ".join(faults))
        return out

    def _faults(self) -> list[str]:
        good = lambda v: isinstance(v, (int, float)) and math.isfinite(v)
        share = lambda v: good(v) and 0 < v <= 1
        out = []
        if not share(self.fraction):
            out.append(f"fraction must be in (0, 1]: {self.fraction}")
        if not 0 <= self.iterations <= 1000:
            out.append(f"iterations must be in 0 to 1000: {self.iterations}")
        if self.delta is not None and not (good(self.delta) and self.delta >= 0):
            out.append(f"delta must be finite and not negative: {self.delta}")
        if self.auto_converge is not None and not (good(self.auto_converge) and self.auto_converge > 0):
            out.append(f"auto_converge must be finite and positive: {self.auto_converge}")
        for name in ("confidence_level", "prediction_level"):
            if (level := getattr(self, name)) is not None and not (good(level) and 0 < level < 1):
                out.append(f"{name} must be in (0, 1): {level}")
        if any(not share(f) for f in self.cv_fractions):
            out.append(f"cv_fractions must be in (0, 1]: {self.cv_fractions}")
        if self.cv_k < 2:
            out.append(f"cv_k must be 2 at least: {self.cv_k}")
        if self.chunk_size < 10:
            out.append(f"chunk_size must be 10 at least: {self.chunk_size}")
        if not 0 <= self.overlap < self.chunk_size:
            out.append(f"overlap must be less than chunk_size: {self.overlap}")
        if self.window_capacity < 3:
            out.append(f"window_capacity must be 3 at least: {self.window_capacity}")
        if not 2 <= self.min_points <= self.window_capacity:
            out.append(f"min_points must be in 2 to window_capacity: {self.min_points}")
        return out

    @property
    def level(self) -> float | None:
        return self.prediction_level if self.prediction_level is not None else self.confidence_level

    @property
    def wants_se(self) -> bool:
        return self.standard_error or self.level is not None
