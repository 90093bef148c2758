"""Descent on the scale of variances, over the cone of semidefinite covariance matrices.

Covariances between traits that are free matrices (us), diagonals and single variances are moved themselves, and not the
logarithms and factors that stand for them. A matrix at the cone's boundary lies on a face: those of its own range. Within the
face it moves freely, and its range may turn, which to first order are all directions but those of its null space alone; the null
space is opened again along a direction in which the likelihood rises. So a variance or a matrix whose estimate is singular
is reached in a few steps, where on the scale of logarithms the descent goes on for ever.

Steps solve the average information (or another curvature), mapped to these directions, with a damping that
falls after good steps and rises after bad ones. Matrices stay the floor away from singular ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: The floor of a matrix's eigenvalues, in shares of what its variances were at first. Below, the equations lose the digits that a lower floor would gain.
FLOOR = 1e-6


@dataclass
class Cell:
    """A matrix that is moved as a whole: its places in theta, row by row of its lower triangle."""

    places: np.ndarray
    t: int
    floor: float = 0.0

    def matrix(self, theta: np.ndarray) -> np.ndarray:
        low = np.zeros((self.t, self.t))
        low[np.tril_indices(self.t)] = theta[self.places]
        np.fill_diagonal(low, np.exp(np.diag(low)))
        return low @ low.T

    def put(self, theta: np.ndarray, matrix: np.ndarray) -> None:
        low = np.linalg.cholesky(matrix)
        np.fill_diagonal(low, np.log(np.diag(low)))
        theta[self.places] = low[np.tril_indices(self.t)]

    def move(self, theta: np.ndarray, change: np.ndarray, size: int) -> np.ndarray:
        """The change of theta that goes with a small change of the matrix."""
        low = np.linalg.cholesky(self.matrix(theta))
        inner = np.linalg.solve(low, np.linalg.solve(low, change).T)
        half = np.tril(inner, -1) + np.diag(np.diag(inner)) / 2
        d = low @ half
        d[np.diag_indices(self.t)] /= np.diag(low)
        out = np.zeros(size)
        out[self.places] = d[np.tril_indices(self.t)]
        return out


def cells(parts: list[tuple[str, slice, int]], free: np.ndarray) -> list[Cell]:
    """The matrices among covariances (structure, place, number of traits) that are free as a whole; others keep their own parameters."""
    out = []
    for struct, at, t in parts:
        places = np.arange(at.start, at.stop)
        groups = [places] if struct in ("us", "iid") else [places[k : k + 1] for k in range(t)] if struct == "diag" else []
        out += [Cell(p, t if struct == "us" else 1) for p in groups if len(p) and free[p].all()]
    return out


def _directions(cell: Cell, theta: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Eigenvectors of the matrix, which of them span its range, the directions in which it may move, and the same in theta."""
    values, q = np.linalg.eigh(cell.matrix(theta))
    live = values > 10 * cell.floor
    moves = []
    for i in range(cell.t):
        for j in range(i, cell.t):
            if live[i] or live[j]:
                d = np.outer(q[:, i], q[:, j])
                moves.append((d + d.T) / (2.0 if i == j else np.sqrt(2.0)))
    null = q[:, ~live]
    if null.shape[1]:
        inner = np.zeros((null.shape[1],) * 2)
        for i in range(len(inner)):
            for j in range(i, len(inner)):
                d = np.outer(null[:, i], null[:, j])
                inner[i, j] = inner[j, i] = grad @ cell.move(theta, (d + d.T) / 2, len(theta))
        slope, w = np.linalg.eigh(inner)
        if slope[0] * cell.floor < 0 and -slope[0] * max(values[-1], cell.floor * 100) > 1e-4:
            d = null @ w[:, 0]
            moves.append(np.outer(d, d))
    return q, live, moves, [cell.move(theta, d, len(theta)) for d in moves]


def _moved(cell: Cell, theta: np.ndarray, q: np.ndarray, live: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The matrix after a change: on the face with the turned range, and in the cone."""
    m = q.T @ (cell.matrix(theta) + change) @ q
    v, n = np.nonzero(live)[0], np.nonzero(~live)[0]
    if len(n) and len(v):
        own, turn = np.linalg.eigh(m[np.ix_(v, v)])
        side = turn.T @ m[np.ix_(v, n)]
        keep = own > 10 * cell.floor
        m[np.ix_(n, n)] += side[keep].T @ (side[keep] / own[keep, None])
    values, w = np.linalg.eigh(q @ m @ q.T)
    return (w * np.maximum(values, cell.floor)) @ w.T


def minimise(f: Callable, curvature: Callable, theta: np.ndarray, parts: list[tuple[str, slice, int]], free: np.ndarray, low=-12.0, high=12.0, rounds: int = 60, tol: float = 1e-6) -> tuple[np.ndarray, float, bool, list[tuple[Cell, int]]]:
    """The point, its value, whether what the next step would gain is below tol, and the cells with their ranks.

    f gives value and gradient, curvature(theta) a matrix, both in theta, whose other free parameters move as they are.
    """
    theta = np.clip(np.asarray(theta, dtype=float), low, high)
    n = len(theta)
    own = cells(parts, free)
    for c in own:
        m = c.matrix(theta)
        c.floor = FLOOR * max(float(np.trace(m)) / c.t, 1e-12)
        values, w = np.linalg.eigh(m)
        c.put(theta, (w * np.maximum(values, c.floor)) @ w.T)
    taken = np.concatenate([c.places for c in own]) if own else np.zeros(0, dtype=int)
    rest = np.setdiff1d(np.nonzero(free)[0], taken)
    value, grad = f(theta)
    damping, done = 1e-4, False
    for _ in range(rounds):
        plans = [_directions(c, theta, grad) for c in own]
        edge = [(j, (theta[j] <= np.broadcast_to(low, n)[j] + 1e-9 and grad[j] > 0) or (theta[j] >= np.broadcast_to(high, n)[j] - 1e-9 and grad[j] < 0)) for j in rest]
        inside = [j for j, held in edge if not held]
        columns = [d for *_, ds in plans for d in ds] + [np.eye(n)[j] for j in inside]
        if not columns:
            done = True
            break
        p = np.stack(columns, axis=1)
        g, h = p.T @ grad, p.T @ curvature(theta) @ p
        scale = np.maximum(np.diag(h), 1e-12 * max(1e-300, float(np.abs(np.diag(h)).max())))
        moved = False
        while damping < 1e10:
            root = np.sqrt(scale)
            try:
                step = -np.linalg.solve(h / np.outer(root, root) + damping * np.eye(len(g)), g / root) / root
            except np.linalg.LinAlgError:
                damping = max(1e-6, 10 * damping)
                continue
            gain = -float(g @ step)
            if 0 <= gain < tol:
                done = True
                break
            new, at = theta.copy(), 0
            for c, (q, live, moves, _) in zip(own, plans):
                change = sum((x * d for x, d in zip(step[at : at + len(moves)], moves)), np.zeros((c.t, c.t)))
                at += len(moves)
                c.put(new, _moved(c, theta, q, live, change))
            for k, j in enumerate(inside):
                new[j] = theta[j] + np.clip(step[at + k], -2.0, 2.0)
            new = np.where(np.isin(np.arange(n), rest), np.clip(new, low, high), new)
            try:
                got, d = f(new)
            except np.linalg.LinAlgError:
                got, d = np.inf, grad
            if np.isfinite(got) and got < value - 1e-4 * min(gain, value - got if value > got else gain):
                small = value - got < tol and damping < 1.0
                theta, value, grad, moved = new, got, d, True
                damping = max(1e-10, damping / 10)
                done = small
                break
            damping = max(1e-6, 10 * damping)
        if done or not moved:
            break
    ranks = [(c, int((np.linalg.eigvalsh(c.matrix(theta)) > 10 * c.floor).sum())) for c in own]
    return theta, value, done, ranks
