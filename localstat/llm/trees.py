"""Small gradient-boosted trees for a logistic loss, fitted with histograms in numpy.

For bounded training samples on the driver; scoring works on arrays inside tasks.
"""

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Nodes in level order: ``x[feature] <= threshold`` goes left; leaves have feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def apply(self, x):
        node = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.value[node]
            at = node[inner]
            go_left = x[inner, f[inner]] <= self.threshold[at]
            node[inner] = np.where(go_left, self.left[at], self.right[at])

    def paths(self):
        """Conditions ``(feature, "<=" or ">", threshold)`` on the way to each node but the root."""
        found, todo = [], [(0, ())]
        while todo:
            node, path = todo.pop()
            if path:
                found.append(path)
            f, t = int(self.feature[node]), float(self.threshold[node])
            if f >= 0:
                todo.append((self.left[node], (*path, (f, "<=", t))))
                todo.append((self.right[node], (*path, (f, ">", t))))
        return found


def fit(x, y, n_trees=40, depth=3, rate=0.2, bins=32, least=10.0, ridge=1.0, weight=None):
    """Trees and start value for the log odds of ``y`` given the rows of ``x``."""
    n, width = x.shape
    weight = np.ones(n) if weight is None else weight
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    flat = binned + np.arange(width) * bins
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin, trees = np.full(n, start), []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, threshold, left, right, value = [-1], [0.0], [-1], [-1], [0.0]
        node, level = np.zeros(n, np.int64), [0]
        for d in range(depth + 1):
            rank = np.full(len(feature), -1)
            rank[level] = np.arange(len(level))
            own = rank[node]
            in_level = own >= 0
            size = len(level) * width * bins
            key = (own[in_level, None] * width * bins + flat[in_level]).ravel()
            sums = [
                np.bincount(key, np.repeat(v[in_level], width), size).reshape(len(level), width, bins) for v in (g, h)
            ]
            total = [s[:, 0].sum(1) for s in sums]
            gl, hl = (s.cumsum(2) for s in sums)
            gr, hr = total[0][:, None, None] - gl, total[1][:, None, None] - hl
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (total[0] ** 2 / (total[1] + ridge))[:, None, None]
            gain[(hl * 4 < least) | (hr * 4 < least)] = -1
            following = []
            for k, at in enumerate(level):
                value[at] = rate * total[0][k] / (total[1][k] + ridge)
                f, b = divmod(int(gain[k].argmax()), bins)
                if d == depth or gain[k, f, b] <= 1e-6 or b >= len(cuts[f]):
                    continue
                feature[at], threshold[at] = f, float(cuts[f][b])
                left[at], right[at] = len(feature), len(feature) + 1
                here = node == at
                node[here] = np.where(binned[here, f] <= b, left[at], right[at])
                following += [left[at], right[at]]
                for column, empty in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0)):
                    column += [empty, empty]
            level = following
            if not level:
                break
        tree = Tree(*(np.array(c) for c in (feature, threshold, left, right, value)))
        trees.append(tree)
        margin += tree.value[node]
        if len(feature) == 1:
            break
    return trees, start


def margins(model, x):
    trees, start = model
    return start + sum((t.apply(x) for t in trees), np.zeros(len(x)))
