"""Linear models over sparse presence features, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse 0/1 rows over columns 0..n_cols-1; column 0 is the intercept."""

    def __init__(self, rows: list[list[int]], n_cols: int):
        self.n_cols = n_cols
        self.sizes = np.array([len(r) + 1 for r in rows], np.int64)
        self.cols = np.fromiter((c for r in rows for c in (0, *r)), np.int64, int(self.sizes.sum()))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)

    def __len__(self):
        return len(self.sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        """rows @ w for w of shape (n_cols, classes)."""
        return np.add.reduceat(w[self.cols], self.starts, axis=0)

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        """rows.T @ r for r of shape (rows, classes)."""
        return np.stack([np.bincount(self.cols, np.repeat(r[:, k], self.sizes), self.n_cols)
                         for k in range(r.shape[1])], axis=1)

    def take(self, chosen: np.ndarray) -> Rows:
        out = Rows.__new__(Rows)
        out.n_cols, out.sizes = self.n_cols, self.sizes[chosen]
        out.cols = np.concatenate([self.cols[self.starts[i]:self.starts[i] + self.sizes[i]] for i in chosen])
        out.starts = np.concatenate(([0], np.cumsum(out.sizes)[:-1])).astype(np.int64)
        return out

    def narrow(self, columns: np.ndarray) -> Rows:
        """The rows over the intercept and these columns, numbered from 1."""
        place = np.full(self.n_cols, -1)
        place[0] = 0
        place[columns] = np.arange(1, len(columns) + 1)
        cols = place[self.cols]
        out = Rows.__new__(Rows)
        out.n_cols, out.cols = len(columns) + 1, cols[cols >= 0]
        out.sizes = np.add.reduceat((cols >= 0).astype(np.int64), self.starts)
        out.starts = np.concatenate(([0], np.cumsum(out.sizes)[:-1])).astype(np.int64)
        return out


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: Rows, y: np.ndarray, dense: np.ndarray | None = None, l2: float = 1.0,
        steps: int = 60) -> np.ndarray:
    """Weights (columns + dense columns, classes) of the regularised logistic
    (y of one column, 0/1) or multinomial (one column per class) regression;
    the intercept is free of the penalty."""
    classes = y.shape[1]
    dense = np.zeros((len(rows), 0)) if dense is None else dense
    n = rows.n_cols

    def loss(flat):
        w = flat.reshape(n + dense.shape[1], classes)
        z = rows.dot(w[:n]) + dense @ w[n:]
        if classes == 1:
            value = np.logaddexp(0, z).sum() - (y * z).sum()
            r = sigmoid(z) - y
        else:
            m = z.max(axis=1, keepdims=True)
            value = (np.log(np.exp(z - m).sum(axis=1, keepdims=True)) + m).sum() - (y * z).sum()
            r = softmax(z) - y
        pen = w.copy()
        pen[0] = 0
        grad = np.concatenate((rows.t_dot(r), dense.T @ r)) + l2 * pen
        return value + 0.5 * l2 * (pen * pen).sum(), grad.ravel()

    return _descend(loss, np.zeros((n + dense.shape[1]) * classes), steps).reshape(-1, classes)


def _descend(loss, x, steps: int, keep: int = 8):
    """Quasi-Newton minimum of a smooth convex function (limited memory)."""
    value, grad = loss(x)
    past: list[tuple] = []
    for _ in range(steps):
        d = -grad
        scales = []
        for s, u, rho in reversed(past):
            a = rho * s.dot(d)
            scales.append(a)
            d = d - a * u
        if past:
            s, u, _ = past[-1]
            d = d * (s.dot(u) / u.dot(u))
        for (s, u, rho), a in zip(past, reversed(scales)):
            d = d + s * (a - rho * u.dot(d))
        slope, t = grad.dot(d), 1.0 if past else 1.0 / max(1.0, np.abs(grad).max())
        while True:
            new, new_grad = loss(x + t * d)
            if new <= value + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, u = t * d, new_grad - grad
        x, done = x + s, value - new < 1e-7 * max(1.0, abs(value))
        value, grad = new, new_grad
        if s.dot(u) > 1e-12:
            past = [*past[1 - keep:], (s, u, 1.0 / s.dot(u))]
        if done:
            break
    return x
