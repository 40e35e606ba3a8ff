"""Gradient-boosted trees over binned features in NumPy, from how often each combination of bins has each label.

Trees are complete to a depth; a node that no split improves passes all rows to
its left.  A missing value goes left.  Row and column samples are seeded.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

import numpy as np


def codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of every value, by feature; a missing one lies lowest."""
    return np.stack([np.searchsorted(e, np.where(np.isfinite(c), c, -np.inf)) for e, c in zip(edges, x.T)], 1)


def values(code: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """A value in each bin, which goes through any tree as all of the bin do."""
    return np.stack([np.r_[e, np.inf][c] for e, c in zip(edges, code.T)], 1)


@dataclass(frozen=True)
class Boosting:
    trees: int = 400
    depth: int = 5
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    bins: int = 64
    ridge: float = 1.0
    least: float = 1.0  # of the second derivatives' sum in a child
    balanced: bool = False  # positives weigh negatives over positives, within [1, 50]
    patience: int = 0  # trees without gain on a validation set before stopping; 0: never

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 42, valid: tuple[np.ndarray, np.ndarray] | None = None) -> dict:
        """grow() from rows that are at hand; edges are quantiles of the features."""
        edges = [np.unique(np.quantile(c[np.isfinite(c)], np.linspace(0, 1, self.bins + 1)[1:-1])) if np.isfinite(c).any() else np.empty(0) for c in x.T]
        cells = lambda x, y: (codes(x, edges), (y == 1).astype(float), (y != 1).astype(float))
        return self.grow(edges, *cells(x, y), seed, None if valid is None else cells(*valid))

    def grow(self, edges: list[np.ndarray], code: np.ndarray, pos: np.ndarray, neg: np.ndarray, seed: int = 42, valid: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> dict:
        """Trees as arrays: start, features and thresholds by tree and node, leaf values, gain by feature.

        Rows of one code in every feature are a cell, so what a fit needs is how many
        positives and negatives each cell has; a tree's row sample is a binomial draw of each count.
        """
        rng, n, m = np.random.default_rng(seed), len(pos), code.shape[1]
        up = float(np.clip(neg.sum() / max(pos.sum(), 1), 1, 50)) if self.balanced else 1.0
        code, places = np.ascontiguousarray(code.T, np.int32), np.arange(n)
        share = float(np.clip(up * pos.sum() / max(up * pos.sum() + neg.sum(), 1e-12), 1e-6, 1 - 1e-6))
        start = np.log(share / (1 - share))
        f, inner = np.full(n, start), 2**self.depth - 1
        out = {"start": start, "feature": [], "threshold": [], "leaf": [], "gain": np.zeros(m)}
        vcode, vpos, vneg = (None, None, None) if valid is None else (np.ascontiguousarray(valid[0].T, np.int32), valid[1], valid[2])
        fv = None if valid is None else np.full(len(vpos), start)
        whole = [z.astype(np.int64) for z in (pos, neg)]
        best, best_at = np.inf, 0
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            on, off = (rng.binomial(z, self.rows) for z in whole) if self.rows < 1 else whole
            g, h = up * on * (p - 1) + off * p, (up * on + off) * p * (1 - p)
            cols = np.sort(rng.permutation(m)[: max(1, round(self.columns * m))])
            feature, threshold, at = np.full(inner, -1), np.full(inner, np.inf), np.zeros(n, np.int32)
            split_at = np.zeros(inner, np.int64)
            for level in range(self.depth):
                size, first = 2**level, 2**level - 1
                top, split = np.zeros(size), np.zeros((size, 2), np.int64)
                for c in cols.tolist():
                    width = len(edges[c]) + 1
                    if width < 2:
                        continue
                    cell = at * np.int32(width) + code[c]
                    G, H = (np.bincount(cell, v, size * width).reshape(size, width).cumsum(1) for v in (g, h))
                    GL, HL, GA, HA = G[:, :-1], H[:, :-1], G[:, -1:], H[:, -1:]
                    GR, HR = GA - GL, HA - HL
                    score = lambda a, b: a * a / (b + self.ridge)
                    gain = np.where((HL >= self.least) & (HR >= self.least), score(GL, HL) + score(GR, HR) - score(GA, HA), 0)
                    k = gain.argmax(1)
                    v = gain[np.arange(size), k]
                    better = v > top + 1e-12
                    top[better], split[better] = v[better], np.stack([np.full(size, c), k], 1)[better]
                for node in np.flatnonzero(top > 1e-12).tolist():
                    c, k = split[node].tolist()
                    feature[first + node], threshold[first + node], split_at[first + node] = c, edges[c][k], k
                    out["gain"][c] += top[node]
                at = self._down(at, feature[first : first + size], split_at[first : first + size], code, places)
            G, H = (np.bincount(at, v, 2**self.depth) for v in (g, h))
            leaf = -self.rate * G / (H + self.ridge)
            f = f + leaf[at]
            for name, v in (("feature", feature), ("threshold", threshold), ("leaf", leaf)):
                out[name].append(v)
            if valid is not None and self.patience:
                at, places_v = np.zeros(len(vpos), np.int32), np.arange(len(vpos))
                for level in range(self.depth):
                    own = slice(2**level - 1, 2 ** (level + 1) - 1)
                    at = self._down(at, feature[own], split_at[own], vcode, places_v)
                fv = fv + leaf[at]
                pv = np.clip(1 / (1 + np.exp(-fv)), 1e-12, 1 - 1e-12)
                loss = -(vpos @ np.log(pv) + vneg @ np.log(1 - pv)) / max(vpos.sum() + vneg.sum(), 1)
                if loss < best - 1e-7:
                    best, best_at = loss, t + 1
                elif t + 1 - best_at >= self.patience:
                    break
        for name in ("feature", "threshold", "leaf"):
            out[name] = np.array(out[name]).reshape(len(out[name]), -1)
        out["best"] = best_at or len(out["leaf"])
        return out

    @staticmethod
    def _down(at: np.ndarray, feature: np.ndarray, split_at: np.ndarray, code: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Places one level on; a node without a split passes all to its left."""
        c = feature[at]
        return (2 * at + ((c >= 0) & (code[np.maximum(c, 0), places] > split_at[at]))).astype(np.int32)

    def _leaf_of(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for level in range(self.depth):
            node = at + 2**level - 1
            c = feature[node]
            at = 2 * at + ((c >= 0) & (x[rows, np.maximum(c, 0)] > threshold[node]))
        return leaf[at]

    def predict(self, model: dict, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), model["start"])
        for tree in zip(model["feature"], model["threshold"], model["leaf"]):
            f += self._leaf_of(*tree, x)
        return 1 / (1 + np.exp(-f))


#: The grid of the tuned variant: depth and rate; each with and without balanced weights.
GRID = tuple(Boosting(trees=800, depth=d, rate=r, balanced=b, patience=40) for d, r in ((3, 0.05), (5, 0.05), (5, 0.1)) for b in (False, True))


def isotonic_fit(p: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the least-squares rising fit, by pooling adjacent violators; n: rows that each p stands for, y: positives among them."""
    order = np.argsort(p, kind="stable")
    x, first = np.unique(p[order], return_index=True)
    total = np.add.reduceat(y[order].astype(float), first)
    n = np.add.reduceat(np.ones(len(p)) if n is None else n[order].astype(float), first)
    level, weight, size = [], [], []
    for v, w in zip(total / n, n):
        level.append(v)
        weight.append(w)
        size.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            w2, s2, v2 = weight.pop(), size.pop(), level.pop()
            level[-1] = (level[-1] * weight[-1] + v2 * w2) / (weight[-1] + w2)
            weight[-1] += w2
            size[-1] += s2
    return x, np.repeat(level, size)


@dataclass(frozen=True)
class Tuned:
    """Boosting chosen by inner folds, as many trees as they want, with an isotonic calibration.

    Inner scores are of rows that the scoring trees have not seen; they choose the
    grid place (average precision) and fit the calibration, to which 1e-6 of the raw score is
    added so that order within a step stays. A place and an inner fold are one fit, so that tasks
    share them: try_out() is one of them, settle() chooses and fits once more.
    """

    grid: tuple[Boosting, ...] = GRID
    folds: int = 3
    tie: float = 1e-6

    @property
    def bins(self) -> int:
        return self.grid[0].bins

    def try_out(self, place: int, edges: list[np.ndarray], code: np.ndarray, pos: np.ndarray, neg: np.ndarray, held: np.ndarray, seed: int = 42) -> tuple[int, np.ndarray] | None:
        """(trees wanted, scores of the cells held back) of a grid place; None where the others have one class; held: cells of the inner fold."""
        rest = ~held
        if not held.any() or not pos[rest].sum() or not neg[rest].sum():
            return None
        fit = self.grid[place]
        m = fit.grow(edges, code[rest], pos[rest], neg[rest], seed, (code[held], pos[held], neg[held]))
        cut = {**m, **{c: m[c][: m["best"]] for c in ("feature", "threshold", "leaf")}}
        return m["best"], fit.predict(cut, values(code[held], edges))

    def settle(self, tried: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]], edges: list[np.ndarray], code: np.ndarray, pos: np.ndarray, neg: np.ndarray, seed: int = 42) -> dict:
        """tried: by grid place, for each inner fold the trees wanted and the scores, positives and negatives of its cells."""
        best = None
        for place in sorted(tried):
            stops, (p, a, b) = [x[0] for x in tried[place]], (np.concatenate([x[i] for x in tried[place]]) for i in (1, 2, 3))
            ap = average_precision(a, p, b)
            if best is None or ap > best[0] + 1e-12:
                best = ap, place, int(np.clip(1.1 * np.median(stops), 50, 800)), p, a, b
        if best is None:
            return {"share": float(pos.sum() / max(pos.sum() + neg.sum(), 1)) if len(pos) else 0.5}
        _, place, trees, p, a, b = best
        final = replace(self.grid[place], trees=trees, patience=0)
        return {"place": asdict(final), "model": final.grow(edges, code, pos, neg, seed), "steps": isotonic_fit(p, a, a + b)}

    def predict(self, model: dict, x: np.ndarray) -> np.ndarray:
        if "share" in model:
            return np.full(len(x), model["share"])
        raw = Boosting(**model["place"]).predict(model["model"], x)
        at, level = model["steps"]
        return np.clip(np.interp(raw, at, level) + self.tie * raw, 0, 1)


def average_precision(pos: np.ndarray, p: np.ndarray, neg: np.ndarray | None = None) -> float:
    """Step-wise, ties taken together, from positives and negatives (or labels) at each score; 0 without positives."""
    neg = 1 - pos if neg is None else neg
    if not pos.sum():
        return 0.0
    order = np.argsort(-p, kind="stable")
    last = np.r_[np.flatnonzero(np.diff(p[order]) != 0), len(p) - 1]
    tp, fp = np.cumsum(pos[order])[last], np.cumsum(neg[order])[last]
    return float((np.diff(np.r_[0, tp]) * tp / np.maximum(tp + fp, 1e-300)).sum() / tp[-1])
