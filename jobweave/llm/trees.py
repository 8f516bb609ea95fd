"""Small boosted trees on binned features and lasso logistic regression, for bounded samples on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Node:
    value: float
    feature: int = -1
    border: float = 0.0
    low: Node | None = None
    high: Node | None = None


def borders_of(x: np.ndarray) -> list[np.ndarray]:
    """At most BINS - 1 cut points per feature, between distinct quantiles."""
    out = []
    for k in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, k], np.linspace(0, 1, 4 * BINS), method="nearest")) if len(x) else np.zeros(0)
        mid = (q[1:] + q[:-1]) / 2
        out.append(mid if len(mid) < BINS else mid[np.linspace(0, len(mid) - 1, BINS - 1).astype(int)])
    return out


def binned(x: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(b, x[:, k], "left") for k, b in enumerate(borders)], 1) if len(borders) else x.astype(int)


def grow(
    bins: np.ndarray, borders: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, depth: int, least: int, damp: float = 1.0, weight: np.ndarray | None = None
) -> Node:
    """A regression tree by second-order gains; rows with a value at most the border go low. ``weight`` is how many rows each one stands for."""
    node = Node(-slope.sum() / (curve.sum() + damp))
    whole = len(bins) if weight is None else weight.sum()
    if depth == 0 or whole < 2 * least:
        return node
    base = slope.sum() ** 2 / (curve.sum() + damp)
    best = (1e-6, -1, 0)
    for k in range(bins.shape[1]):
        n = len(borders[k]) + 1
        if n < 2:
            continue
        g = np.cumsum(np.bincount(bins[:, k], slope, n))[:-1]
        h = np.cumsum(np.bincount(bins[:, k], curve, n))[:-1]
        c = np.cumsum(np.bincount(bins[:, k], weight, n))[:-1]
        gain = g**2 / (h + damp) + (slope.sum() - g) ** 2 / (curve.sum() - h + damp) - base
        gain[(c < least) | (whole - c < least)] = -1
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), k, at)
    if best[1] < 0:
        return node
    _, node.feature, at = best
    node.border = float(borders[node.feature][at])
    low = bins[:, node.feature] <= at
    node.low, node.high = (
        grow(bins[own], borders, slope[own], curve[own], depth - 1, least, damp, None if weight is None else weight[own]) for own in (low, ~low)
    )
    return node


def leaf_values(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    low = x[:, node.feature] <= node.border
    out = np.empty(len(x))
    out[low], out[~low] = leaf_values(node.low, x[low]), leaf_values(node.high, x[~low])
    return out


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Boosted:
    start: float
    rate: float
    trees: list[Node] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += self.rate * leaf_values(t, x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return squash(self.margin(x))


def boost(
    x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 5, part: float = 0.7, seed: int = 1, weight: np.ndarray | None = None
) -> Boosted:
    """Gradient boosting of the logistic loss; every tree sees its own share ``part`` of the rows, each as often as ``weight`` says."""
    rng = np.random.default_rng(seed)
    mean = min(max(float(np.average(y, weights=weight)), 1e-4), 1 - 1e-4)
    model = Boosted(float(np.log(mean / (1 - mean))), rate)
    borders = borders_of(x)
    bins, z = binned(x, borders), np.full(len(x), model.start)
    for _ in range(trees):
        p = squash(z)
        own = rng.random(len(x)) < part
        slope, curve = p - y, np.maximum(p * (1 - p), 1e-6)
        if weight is not None:
            slope, curve = slope * weight, curve * weight
        tree = grow(bins[own], borders, slope[own], curve[own], depth, least, weight=None if weight is None else weight[own])
        model.trees.append(tree)
        z += rate * leaf_values(tree, x)
    return model


def paths(node: Node, so_far: tuple = ()) -> list[tuple]:
    """Conjunctions ((feature, '<=' or '>', border), ...) of every inner and leaf node but the root."""
    out = [so_far] if so_far else []
    if node.feature >= 0:
        out += paths(node.low, (*so_far, (node.feature, "<=", node.border)))
        out += paths(node.high, (*so_far, (node.feature, ">", node.border)))
    return out


def rule_matrix(rules: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for feature, side, border in rule:
            out[:, k] *= x[:, feature] <= border if side == "<=" else x[:, feature] > border
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400, positive: bool = False) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic regression, by accelerated proximal steps; with ``positive`` no weight is below 0."""
    n = max(len(x), 1)
    full = np.concatenate([np.ones((len(x), 1)), x], 1)
    v = np.ones(full.shape[1])
    for _ in range(20):
        v = full.T @ (full @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 4 * n / max(float(v @ (full.T @ (full @ v))), 1e-9)
    w = z = np.zeros(full.shape[1])
    t = 1.0
    for _ in range(steps):
        g = full.T @ (squash(full @ z) - y) / n
        new = z - step * g
        size = new[1:] if positive else np.abs(new[1:])
        new[1:] = np.sign(new[1:]) * np.maximum(size - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / after * (new - w)
        w, t = new, after
    return float(w[0]), w[1:]
