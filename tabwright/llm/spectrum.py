"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

``count_above(A, s)`` factorises A - s I = P L D L' P' with pivots of one or two
rows (Bunch and Kaufman); by Sylvester's law D has as many positive eigenvalues
as A has above s.  Bisection on these counts isolates each eigenvalue from the
top; inverse iteration with the factors at hand gives a first vector, Rayleigh
quotient iteration converges cubically, and counts on both sides of the result
certify its number.  Eigenvalues that no shift tells apart at working precision
form a cluster: its vectors are iterated as one block and told apart within it.
"""

from __future__ import annotations

import numpy as np

_ALPHA = (1 + 17 ** 0.5) / 8
EPS = float(np.finfo(float).eps)


class Factors:
    """P L D L' P' of a symmetric matrix: ``perm``, unit lower ``low``, blocks (row, size, block) of D."""

    def __init__(self, matrix: np.ndarray, tiny: float):
        a = np.array(matrix, float)
        n = len(a)
        self.low, self.perm, self.blocks = np.eye(n), np.arange(n), []
        k = 0
        while k < n:
            below = np.abs(a[k + 1:, k])
            size, swap = 1, k
            if len(below) and below.max() > 0 and abs(a[k, k]) < _ALPHA * below.max():
                r = k + 1 + int(below.argmax())
                row = np.abs(a[r, k:])
                row[r - k] = 0.0
                most = row.max()
                if abs(a[k, k]) * most >= _ALPHA * below.max() ** 2:
                    pass
                elif abs(a[r, r]) >= _ALPHA * most:
                    swap = r
                else:
                    size, swap = 2, r
            at = k + size - 1
            if swap != at:
                a[[at, swap]] = a[[swap, at]]
                a[:, [at, swap]] = a[:, [swap, at]]
                self.low[[at, swap], :k] = self.low[[swap, at], :k]
                self.perm[[at, swap]] = self.perm[[swap, at]]
            block = a[k:k + size, k:k + size].copy()
            if size == 1 and abs(block[0, 0]) < tiny:
                block[0, 0] = tiny if block[0, 0] >= 0 else -tiny
            self.blocks.append((k, size, block))
            if k + size < n:
                c = a[k + size:, k:k + size]
                lower = np.linalg.solve(block, c.T).T if size == 2 else c / block[0, 0]
                self.low[k + size:, k:k + size] = lower
                a[k + size:, k + size:] -= lower @ c.T
            k += size

    def positive(self) -> int:
        """Positive eigenvalues of D; a block of two rows that the pivoting chooses has one of each sign."""
        return sum(int(b[0, 0] > 0) if size == 1 else int((np.linalg.det(b) > 0) * (1 + np.sign(np.trace(b))) or np.linalg.det(b) <= 0)
                   for _, size, b in self.blocks)

    def solve(self, y: np.ndarray) -> np.ndarray:
        """x with P L D L' P' x = y; y may hold several columns."""
        x = np.array(y[self.perm], float)
        n = len(x)
        for k in range(n):
            x[k + 1:] -= np.multiply.outer(self.low[k + 1:, k], x[k])
        for k, size, b in self.blocks:
            x[k:k + size] = np.linalg.solve(b, x[k:k + size]) if size == 2 else x[k:k + size] / b[0, 0]
        for k in range(n - 1, -1, -1):
            x[k] -= self.low[k + 1:, k] @ x[k + 1:]
        out = np.empty_like(x)
        out[self.perm] = x
        return out


def _factors(a: np.ndarray, shift: float, size: float) -> Factors:
    return Factors(a - shift * np.eye(len(a)), EPS * EPS * size + np.finfo(float).tiny)


def count_above(a: np.ndarray, shift: float) -> int:
    return _factors(a, shift, float(np.abs(a).sum(axis=1).max())).positive()


def _apart(v: np.ndarray, found: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - found @ (found.T @ v)
    return v


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors as columns; each vector's largest
    entry (the first, if several) is positive.  ``a`` is symmetric; fewer rows than k give as many pairs."""
    a = np.asarray(a, float)
    d = len(a)
    k = min(k, d)
    if not k:
        return np.zeros(0), np.zeros((d, 0))
    size = float(np.abs(a).sum(axis=1).max())
    if size == 0:
        return np.zeros(k), np.eye(d)[:, :k]
    close = 8 * d * EPS * size          # what rounding may move an eigenvalue by, generously
    counts: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in counts:
            counts[s] = count_above(a, s)
        return counts[s]

    bottom = -size * (1 + 1e-3) - close
    counts[bottom], counts[-bottom] = d, 0
    values, vectors = [], np.zeros((d, 0))
    rnd = np.random.default_rng(7)
    while len(values) < k:
        done = len(values)
        # the interval (low, high] that holds eigenvalue done + 1, from the counts so far
        high = min(s for s, c in counts.items() if c <= done)
        low = max(s for s, c in counts.items() if c > done)
        while above(low) - above(high) > 1 and high - low > 4 * close:
            mid = (low + high) / 2
            low, high = (mid, high) if above(mid) > done else (low, mid)
        many = min(above(low) - above(high), k - done)      # of a cluster's equal eigenvalues any vectors will do
        while True:
            mid = (low + high) / 2
            fac = _factors(a, mid, size)
            v = _apart(rnd.standard_normal((d, many)), vectors)
            for _ in range(2):
                v = _apart(np.linalg.qr(fac.solve(v))[0], vectors)
                v = np.linalg.qr(v)[0]
            if many == 1:
                got, v = _rayleigh(a, v[:, 0], vectors, low - close, high + close, size)
                if got is not None:
                    break
                if high - low <= close:      # nothing left to narrow
                    v = v / np.linalg.norm(v)
                    got = np.array([v @ a @ v])
                    break
                low, high = (mid, high) if above(mid) > done else (low, mid)
            else:
                for _ in range(3):
                    v = np.linalg.qr(_apart(fac.solve(v), vectors))[0]
                got, turn = _rotate(v.T @ a @ v)
                v = v @ turn
                break
        got, v = np.atleast_1d(got), v.reshape(d, -1)
        for e, u in zip(got, v.T):
            values.append(float(e))
            vectors = np.column_stack([vectors, u])
        counts.setdefault(low - close, above(low - close))
        if not above(max(got) + 4 * close) <= done or above(min(got) - 4 * close) < done + len(got):
            raise ArithmeticError(f"eigenvalues {done + 1} to {done + len(got)} are not where the counts say")
    values, vectors = np.array(values[:k]), vectors[:, :k]
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(k)] < 0, -1.0, 1.0)


def _rayleigh(a, v, found, low, high, size):
    """(eigenvalue, vector) if the iteration settles within [low, high], else (None, last vector)."""
    v = v / np.linalg.norm(v)
    last = np.inf
    for _ in range(12):
        e = float(v @ a @ v)
        if not low <= e <= high:
            return None, v
        residual = float(np.linalg.norm(a @ v - e * v))
        if residual <= 4 * EPS * size or (residual >= last and residual <= 1e3 * EPS * size):
            return np.array([e]), v
        last = residual
        w = _apart(_factors(a, e, size).solve(v), found)
        v = w / np.linalg.norm(w)
    return None, v


def _rotate(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and vectors of a cluster's small projection, by Jacobi rotations."""
    b, n = (b + b.T) / 2, len(b)
    turn = np.eye(n)
    for _ in range(30):
        if np.abs(b - np.diag(np.diag(b))).max(initial=0.0) <= n * EPS * np.abs(b).max(initial=0.0):
            break
        for i in range(n):
            for j in range(i + 1, n):
                t = 0.5 * np.arctan2(2 * b[i, j], b[i, i] - b[j, j])
                r = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
                b[:, [i, j]] = b[:, [i, j]] @ r
                b[[i, j]] = r.T @ b[[i, j]]
                turn[:, [i, j]] = turn[:, [i, j]] @ r
    order = np.argsort(-np.diag(b), kind="stable")
    return np.diag(b)[order].copy(), turn[:, order]
