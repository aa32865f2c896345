"""Gradient-boosted trees in numpy: histogram splits, optional monotone features, flat node arrays."""

from __future__ import annotations

import numpy as np


class Trees:
    """Flat node arrays of all trees; a leaf points to itself.

    ``score`` moves all rows through all trees at once, one level per step.
    """

    def __init__(self, base: float = 0.0, rate: float = 0.1):
        self.base, self.rate, self.depth = base, rate, 0
        self.feature: list[int] = []
        self.threshold: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []
        self.roots: list[int] = []

    def node(self, value: float) -> int:
        at = len(self.value)
        for array, x in ((self.feature, 0), (self.threshold, np.inf), (self.left, at), (self.right, at),
                         (self.value, float(value))):
            array.append(x)
        return at

    def score(self, X: np.ndarray) -> np.ndarray:
        """Log-odds of every row."""
        if not self.roots or not len(X):
            return np.full(len(X), self.base)
        feature, left, right = (np.asarray(a) for a in (self.feature, self.left, self.right))
        threshold, value = np.asarray(self.threshold), np.asarray(self.value)
        at = np.broadcast_to(np.asarray(self.roots), (len(X), len(self.roots)))
        rows = np.arange(len(X))[:, None]
        for _ in range(self.depth):
            at = np.where(X[rows, feature[at]] <= threshold[at], left[at], right[at])
        return self.base + self.rate * value[at].sum(axis=1)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def boost(X: np.ndarray, y: np.ndarray, w: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2,
          min_rows: int = 20, l2: float = 1.0, bins: int = 48, monotone: dict[int, int] | None = None,
          share: float = 1.0, seed: int = 7) -> Trees:
    """Fit logistic boosting.  ``monotone`` maps a feature to +1 (never falls) or -1 (never rises).

    ``share`` of the rows are drawn (seeded) for each tree.  One class, or no
    rows at all, gives a constant model.
    """
    monotone = monotone or {}
    mean = (float((w * y).sum()) + 1.0) / (float(w.sum()) + 2.0)
    out = Trees(float(np.log(mean / (1 - mean))), rate)
    out.depth = depth
    if len(set(y.tolist())) < 2:
        return out
    cuts = [np.unique(np.quantile(X[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(X.shape[1])]
    # a cut lies between two values, not on one: small differences between data sets then matter less
    cuts = [_between(X[:, f], c) for f, c in enumerate(cuts)]
    coded = np.stack([np.searchsorted(c, X[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    z = np.full(len(y), out.base)
    draw = np.random.default_rng(seed)
    for _ in range(trees):
        p = sigmoid(z)
        g, h = w * (y - p), w * p * (1 - p)
        used = np.flatnonzero(draw.random(len(y)) < share) if share < 1 else np.arange(len(y))
        first = len(out.value)
        out.roots.append(_grow(out, coded, cuts, g, h, used, depth, -np.inf, np.inf, min_rows, l2, monotone))
        if len(out.value) == first + 1:  # nothing left to split
            out.roots.pop()
            break
        one = Trees(0.0, rate)
        one.__dict__.update(out.__dict__ | {"roots": out.roots[-1:], "base": 0.0})
        z = z + one.score(X)
    return out


def _between(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    values = np.unique(x)
    at = np.searchsorted(values, cuts, side="right")
    at = at[at < len(values)]
    return np.unique((values[at - 1] + values[at]) / 2) if len(at) else np.empty(0)


def _grow(out, coded, cuts, g, h, rows, depth, low, high, min_rows, l2, monotone) -> int:
    G, H = g[rows].sum(), h[rows].sum()
    weight = lambda a, b: np.clip(a / (b + l2), low, high)
    gain_of = lambda a, b, v: a * v - 0.5 * (b + l2) * v * v
    at = out.node(weight(G, H))
    if depth == 0 or len(rows) < 2 * min_rows:
        return at
    best = (1e-6, None)
    whole = gain_of(G, H, out.value[at])
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        code = coded[rows, f]
        n = np.cumsum(np.bincount(code, minlength=len(c) + 1))[:-1]
        gl = np.cumsum(np.bincount(code, weights=g[rows], minlength=len(c) + 1))[:-1]
        hl = np.cumsum(np.bincount(code, weights=h[rows], minlength=len(c) + 1))[:-1]
        vl, vr = weight(gl, hl), weight(G - gl, H - hl)
        gain = gain_of(gl, hl, vl) + gain_of(G - gl, H - hl, vr) - whole
        bad = (n < min_rows) | (len(rows) - n < min_rows)
        if f in monotone:
            bad |= monotone[f] * (vr - vl) < 0
        gain = np.where(bad, -np.inf, gain)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), (f, k, float(vl[k]), float(vr[k])))
    if best[1] is None:
        return at
    f, k, vl, vr = best[1]
    mid, sign = (vl + vr) / 2, monotone.get(f, 0)
    bounds = {0: (low, high, low, high), 1: (low, mid, mid, high), -1: (mid, high, low, mid)}[sign]
    goes = coded[rows, f] <= k
    left = _grow(out, coded, cuts, g, h, rows[goes], depth - 1, *bounds[:2], min_rows, l2, monotone)
    right = _grow(out, coded, cuts, g, h, rows[~goes], depth - 1, *bounds[2:], min_rows, l2, monotone)
    out.feature[at], out.threshold[at], out.left[at], out.right[at] = f, float(cuts[f][k]), left, right
    return at
