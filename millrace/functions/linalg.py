"""Small dense algebra on the driver: what aggregates over the rows are solved with."""

from __future__ import annotations

import numpy as np

from .. import errors


def pivoted_qr(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """R, Q'b and the pivots of a column-pivoted Householder QR of a."""
    r, rhs = a.astype(float).copy(), b.astype(float).copy()
    m, n = r.shape
    pivots = np.arange(n)
    for k in range(min(m, n)):
        p = k + int(np.argmax((r[k:, k:] ** 2).sum(0)))
        r[:, [k, p]] = r[:, [p, k]]
        pivots[[k, p]] = pivots[[p, k]]
        v = r[k:, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0:
            break
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        r[k:, k:] -= 2 * np.outer(v, v @ r[k:, k:])
        rhs[k:] -= 2 * v * (v @ rhs[k:])
    return r, rhs, pivots


def solve_least_squares(r_factor: np.ndarray, rhs: np.ndarray, rows: int) -> np.ndarray:
    """Coefficients of a least-squares problem given as its triangular factor and Q'y.

    The numerical rank is counted against eps * max(rows, columns) * the largest diagonal element.
    """
    n = r_factor.shape[1]
    r, y, pivots = pivoted_qr(r_factor, rhs)
    diagonal = np.abs(np.diag(r)) if len(r) else np.zeros(0)
    tolerance = np.finfo(float).eps * max(rows, n) * (diagonal.max() if len(diagonal) else 0.0)
    rank = int((diagonal > tolerance).sum())
    if rank < n:
        raise errors.RankDeficientDesign(rank=rank, columns=n)
    out = np.zeros(n)
    out[pivots] = np.linalg.solve(r[:n, :n], y[:n])
    bad = np.flatnonzero(~np.isfinite(out))
    if len(bad):
        raise errors.NonFiniteSolverOutput(index=int(bad[0]))
    return out


def solve_ridge(r_factor: np.ndarray, rhs: np.ndarray, alpha: float, rows: int) -> np.ndarray:
    """The same with alpha times the squared length of the coefficients added: rows of sqrt(alpha) below the factor."""
    if not np.isfinite(alpha) or alpha < 0:
        raise errors.InvalidRegularization(value=alpha)
    n = r_factor.shape[1]
    return solve_least_squares(np.vstack([r_factor, np.sqrt(alpha) * np.eye(n)]), np.concatenate([rhs, np.zeros(n)]), rows + n)


def solve_symmetric(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a^-1 b for a symmetric matrix of full rank."""
    values = np.abs(np.linalg.eigvalsh(a))
    rank = int((values > np.finfo(float).eps * len(a) * values.max(initial=0.0)).sum())
    if rank < len(a):
        raise errors.RankDeficientDesign(rank=rank, columns=len(a))
    return np.linalg.solve(a, b)


def coordinate_descent(gram: np.ndarray, xy: np.ndarray, l1: float, l2: float, max_iterations: int, tolerance: float, floor: float = 1e-12) -> tuple[np.ndarray, int, float]:
    """Minimise w'Gw/2 - c'w + l1 |w| + l2 w'w/2 by cyclic coordinate descent; G and c are per row."""
    w = np.zeros(len(xy))
    for it in range(1, max_iterations + 1):
        moved = 0.0
        for j in range(len(w)):
            if gram[j, j] <= floor:
                continue
            rho = xy[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (gram[j, j] + l2)
            moved = max(moved, abs(new - w[j]))
            w[j] = new
        if moved <= tolerance:
            return w, it, moved
    raise errors.OptimizationDidNotConverge(iterations=max_iterations)


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest down, and eigenvectors as rows, the largest loading of each positive."""
    values, vectors = np.linalg.eigh(a)
    order = np.argsort(-values, kind="stable")
    rows = vectors[:, order].T
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])
    return values[order], rows * np.where(signs == 0, 1, signs)[:, None]
