"""Small gradient-boosted trees: fit on the driver, applied as Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    feature: int = -1
    cut: float = 0.0
    left: "Node | None" = None  # value <= cut
    right: "Node | None" = None
    value: float = 0.0


def _grow(x: np.ndarray, gradient: np.ndarray, curve: np.ndarray, depth: int, least: int, ridge: float) -> Node:
    leaf = Node(value=float(gradient.sum() / (curve.sum() + ridge)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best = (1e-6, -1, 0.0)
    base = gradient.sum() ** 2 / (curve.sum() + ridge)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        values = x[order, j]
        g, h = np.cumsum(gradient[order])[:-1], np.cumsum(curve[order])[:-1]
        gain = g**2 / (h + ridge) + (gradient.sum() - g) ** 2 / (curve.sum() - h + ridge) - base
        gain[values[1:] == values[:-1]] = -1
        gain[: least - 1] = -1
        gain[len(gain) - least + 1 :] = -1
        if len(gain) and gain.max() > best[0]:
            at = int(gain.argmax())
            best = (float(gain[at]), j, float((values[at] + values[at + 1]) / 2))
    if best[1] < 0:
        return leaf
    inside = x[:, best[1]] <= best[2]
    return Node(
        best[1], best[2],
        _grow(x[inside], gradient[inside], curve[inside], depth - 1, least, ridge),
        _grow(x[~inside], gradient[~inside], curve[~inside], depth - 1, least, ridge),
    )


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _apply(node.left, x), _apply(node.right, x))


@dataclass(frozen=True)
class Boosted:
    """Log-odds = start + rate * sum of trees, then a logistic curve (slope, shift) fit on rows the trees have not seen."""

    start: float
    rate: float
    trees: tuple[Node, ...]
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))

    def column(self, values: list[Column]) -> Column:
        """The probability as an expression of the feature columns."""

        def tree(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(node.value)
            return F.when(values[node.feature] <= node.cut, tree(node.left)).otherwise(tree(node.right))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + tree(t)
        margin = F.lit(self.start) + F.lit(self.rate) * total
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.slope) * margin + F.lit(self.shift))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 8, ridge: float = 1.0) -> Boosted:
    """Logistic boosting by Newton steps on even rows; the odd rows set the curve."""
    even = np.arange(len(y)) % 2 == 0
    a, b = x[even], y[even].astype(float)
    share = float(np.clip(b.mean(), 0.01, 0.99))
    start = float(np.log(share / (1 - share)))
    margin, grown = np.full(len(b), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grown.append(_grow(a, b - p, p * (1 - p), depth, least, ridge))
        margin = margin + rate * _apply(grown[-1], a)
    model = Boosted(start, rate, tuple(grown))
    held, truth = model.margin(x[~even]), y[~even].astype(float)
    beta = np.array([1.0, 0.0])
    design = np.stack([held, np.ones_like(held)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (truth - p) - 0.05 * (beta - [1.0, 0.0])
        curve = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta + step / max(1.0, float(np.abs(step).max()))
    return Boosted(start, rate, tuple(grown), float(beta[0]), float(beta[1]))
