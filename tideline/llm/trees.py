"""Small tree ensembles: fitted on bounded samples in the driver, applied as SQL expressions.

Trees split at quantiles of each feature. A fitted tree becomes nested CASE expressions over feature
columns, so that scoring stays in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    at: float  # rows up to this value go left
    left: Leaf | Split
    right: Leaf | Split


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]


def grow(x: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: float, pick=None, ridge: float = 1.0) -> Leaf | Split:
    """A regression tree whose leaves hold sum(grad) / (sum(hess) + ridge), by best gain. pick: the
    features to try at a node. Ties go to the first feature and the lowest threshold."""
    leaf = Leaf(float(grad.sum() / (hess.sum() + ridge)))
    if depth == 0 or hess.sum() < 2 * least:
        return leaf
    best, whole = (1e-9, -1, 0.0), grad.sum() ** 2 / (hess.sum() + ridge)
    for k in range(x.shape[1]) if pick is None else pick():
        if not len(edges[k]):
            continue
        b = np.searchsorted(edges[k], x[:, k])
        g = np.cumsum(np.bincount(b, grad, len(edges[k]) + 1))[:-1]
        h = np.cumsum(np.bincount(b, hess, len(edges[k]) + 1))[:-1]
        gain = g**2 / (h + ridge) + (grad.sum() - g) ** 2 / (hess.sum() - h + ridge) - whole
        gain[(h < least) | (hess.sum() - h < least)] = -1
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (float(gain[at]), int(k), float(edges[k][at]))
    if best[1] < 0:
        return leaf
    left = x[:, best[1]] <= best[2]
    return Split(best[1], best[2], *(grow(x[m], edges, grad[m], hess[m], depth - 1, least, pick, ridge) for m in (left, ~left)))


def predict(tree: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    left = x[:, tree.feature] <= tree.at
    out = np.empty(len(x))
    out[left], out[~left] = predict(tree.left, x[left]), predict(tree.right, x[~left])
    return out


def sql(tree: Leaf | Split, names: list[str]) -> str:
    if isinstance(tree, Leaf):
        return f"{tree.value!r}D"
    return f"CASE WHEN {names[tree.feature]} <= {tree.at!r}D THEN {sql(tree.left, names)} ELSE {sql(tree.right, names)} END"


@dataclass(frozen=True)
class Boosted:
    """Gradient-boosted trees under logistic loss."""

    prior: float
    rate: float
    trees: tuple

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.prior + self.rate * sum((predict(t, x) for t in self.trees), np.zeros(len(x))))))

    def sql(self, names: list[str]) -> str:
        total = " + ".join([f"{self.prior!r}D", *(f"{self.rate!r}D * ({sql(t, names)})" for t in self.trees)])
        return f"1D / (1D + exp(-({total})))"


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, least: float = 2.0) -> Boosted:
    """y: 0 or 1. One class alone, or no rows, gives a constant."""
    share = min(max((y.sum() + 0.5) / (len(y) + 1), 1e-6), 1 - 1e-6)
    prior, trees = math.log(share / (1 - share)), []
    if 0 < y.sum() < len(y):
        edges, score = _edges(x), np.full(len(y), prior)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            trees.append(grow(x, edges, y - p, p * (1 - p), depth, least / 4))
            score += rate * predict(trees[-1], x)
    return Boosted(prior, rate, tuple(trees))


@dataclass(frozen=True)
class Forest:
    """Trees on bootstrap samples with random features at every node; the mean of their leaves."""

    trees: tuple

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sum((predict(t, x) for t in self.trees), np.zeros(len(x))) / len(self.trees)

    def sql(self, names: list[str]) -> str:
        """The mean of the leaves, found by walking the trees as arrays: nested CASE expressions of this
        many nodes would be more code than a method may hold. The features are worked out once, as they
        are bound to a variable."""
        depth = max(_depth(t) for t in self.trees)
        feature, at, value = [], [], []
        for t in self.trees:
            for out, part in zip((feature, at, value), _flat(t, depth), strict=True):
                out += part
        inner = (1 << depth) - 1
        doubles = lambda xs: "array(" + ", ".join("double('infinity')" if x == math.inf else f"{x!r}D" for x in xs) + ")"
        if not depth:
            return f"{sum(value) / len(value)!r}D"
        step = f"2 * n + 1 + if(element_at(f, element_at(c.s, t * {inner} + n + 1)) <= element_at(c.a, t * {inner} + n + 1), 0, 1)"
        walk = f"aggregate(sequence(1, {depth}), 0, (n, k) -> {step})"
        total = f"aggregate(sequence(0, {len(self.trees) - 1}), 0D, (total, t) -> total + element_at(c.v, t * {inner + 1} + {walk} - {inner} + 1))"
        held = f"named_struct('s', array({', '.join(map(str, feature))}), 'a', {doubles(at)}, 'v', {doubles(value)})"
        return f"element_at(transform(array(array({', '.join(names)})), f -> element_at(transform(array({held}), c -> {total}), 1)), 1) / {len(self.trees)}D"


def _depth(tree: Leaf | Split) -> int:
    return 0 if isinstance(tree, Leaf) else 1 + max(_depth(tree.left), _depth(tree.right))


def _flat(tree: Leaf | Split, depth: int) -> tuple[list[int], list[float], list[float]]:
    """Features (from 1) and thresholds of a complete tree in rows from the root, and its leaves."""
    row: list[Leaf | Split] = [tree]
    feature: list[int] = []
    at: list[float] = []
    for _ in range(depth):
        feature += [1 if isinstance(t, Leaf) else t.feature + 1 for t in row]
        at += [math.inf if isinstance(t, Leaf) else t.at for t in row]
        row = [x for t in row for x in ((t, t) if isinstance(t, Leaf) else (t.left, t.right))]
    return feature, at, [t.value for t in row]


def forest(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 6, least: float = 3.0, seed: int = 7) -> Forest:
    rng, edges = np.random.default_rng(seed), _edges(x)
    some = max(1, round(math.sqrt(x.shape[1])))
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow(x[rows], edges, y[rows].astype(float), np.ones(len(y)), depth, least, lambda: rng.choice(x.shape[1], some, replace=False), ridge=1e-9))
    return Forest(tuple(out))
