"""Decision trees over arrays: growing one exactly, and finding leaves for many rows at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A binary tree as lists; a leaf's feature is -1.  value: class weights, or a mean in one place."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[list[float]] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)
    impurity: list[float] = field(default_factory=list)

    def add(self, value, rows: float, impurity: float) -> int:
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.left.append(-1)
        self.right.append(-1)
        self.value.append([float(v) for v in value])
        self.rows.append(float(rows))
        self.impurity.append(float(impurity))
        return len(self.feature) - 1

    def split(self, node: int, feature: int, threshold: float, left: int, right: int) -> None:
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = int(feature), float(threshold), left, right

    def graft(self, node: int, sub: "Tree") -> None:
        """Put another tree in the place of a leaf."""
        at = len(self.feature)
        moved = [node, *range(at, at + len(sub.feature) - 1)]
        for i in range(1, len(sub.feature)):
            self.add(sub.value[i], sub.rows[i], sub.impurity[i])
        for i, j in enumerate(moved):
            if sub.feature[i] >= 0:
                self.split(j, sub.feature[i], sub.threshold[i], moved[sub.left[i]], moved[sub.right[i]])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, threshold, left, right = (np.array(v) for v in (self.feature, self.threshold, self.left, self.right))
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(feature[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = np.where(x[inner, feature[at]] <= threshold[at], left[at], right[at])

    def importances(self, p: int) -> np.ndarray:
        """Share of each feature in rows times impurity decrease; zeros for a tree without splits."""
        out = np.zeros(p)
        for i, f in enumerate(self.feature):
            if f >= 0:
                l, r = self.left[i], self.right[i]
                out[f] += self.rows[i] * self.impurity[i] - self.rows[l] * self.impurity[l] - self.rows[r] * self.impurity[r]
        return out / out.sum() if out.sum() > 0 else out


@dataclass(frozen=True)
class Limits:
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1


def gini(sums: np.ndarray) -> np.ndarray:
    """Impurity and weight of class weights, by row."""
    whole = sums.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(whole > 0, 1 - ((sums / whole[..., None]) ** 2).sum(-1), 0.0), whole


def variance(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Impurity and weight of sums of 1, y and y squared, by row."""
    w = sums[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = sums[..., 1] / w
        return np.where(w > 0, np.maximum(sums[..., 2] / w - mean * mean, 0.0), 0.0), w


def leaf_value(kind: str, sums: np.ndarray) -> list[float]:
    if kind == "gini":
        return (sums / sums.sum()).tolist() if sums.sum() > 0 else sums.tolist()
    return [float(sums[1] / sums[0])] if sums[0] > 0 else [0.0]


def grow(x: np.ndarray, stats: np.ndarray, counts: np.ndarray, kind: str, limits: Limits, features: Callable[[], np.ndarray] | None = None, depth: int = 0) -> Tree:
    """The tree of rows x with statistics to sum (class weights, or 1, y, y squared) and row counts.

    All midpoints between distinct neighbouring values are tried; of equally good splits the first
    feature's lowest threshold wins, and a split that gains nothing is taken.  y is centred first, so
    that squares keep their digits.
    """
    impurity_of = gini if kind == "gini" else variance
    shift = 0.0
    if kind != "gini":
        shift = float(stats[:, 1].sum() / max(stats[:, 0].sum(), 1e-300))
        stats = np.column_stack([stats[:, 0], stats[:, 1] - shift * stats[:, 0], stats[:, 2] - 2 * shift * stats[:, 1] + shift * shift * stats[:, 0]])
    tree = Tree()
    todo = []

    def node(rows: np.ndarray, level: int) -> int:
        sums = stats[rows].sum(0)
        imp = float(impurity_of(sums)[0])
        value = leaf_value(kind, sums)
        if kind != "gini":
            value = [value[0] + shift]
            if len(rows) and np.ptp(stats[rows, 1] / np.maximum(stats[rows, 0], 1e-300)) == 0:
                imp = 0.0
        made = tree.add(value, counts[rows].sum(), imp)
        todo.append((made, rows, level, imp))
        return made

    node(np.arange(len(x)), depth)
    while todo:
        at, rows, level, imp = todo.pop()
        n = counts[rows].sum()
        if n < limits.min_samples_split or imp == 0 or (limits.max_depth is not None and level >= limits.max_depth):
            continue
        best = None
        for j in features() if features else range(x.shape[1]):
            order = np.argsort(x[rows, j], kind="stable")
            v = x[rows[order], j]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            c = np.cumsum(counts[rows[order]])[cut]
            ok = (c >= limits.min_samples_leaf) & (n - c >= limits.min_samples_leaf)
            cut = cut[ok]
            if not len(cut):
                continue
            prefix = np.cumsum(stats[rows[order]], 0)
            low, whole = prefix[cut], prefix[-1]
            (il, wl), (ir, wr) = impurity_of(low), impurity_of(whole - low)
            score = (wl * il + wr * ir) / (wl + wr)
            k = int(np.argmin(score))
            # scores within rounding of the best so far do not replace it
            if best is None or score[k] < best[0] - 1e-12 * max(1.0, abs(best[0])):
                near = np.flatnonzero(score <= score[k] + 1e-12 * max(1.0, abs(score[k])))[0]
                best = (score[near], j, v[cut[near]] + (v[cut[near] + 1] - v[cut[near]]) / 2)
        if best is None:
            continue
        _, j, t = best
        go = x[rows, j] <= t
        left, right = node(rows[go], level + 1), node(rows[~go], level + 1)
        tree.split(at, j, t, left, right)
    return tree
