"""Penalised spline surfaces: B-spline bases, their penalty's null space, and the blocks of a two-way decomposition."""

from __future__ import annotations

import numpy as np


def basis(x: np.ndarray, nseg: int, deg: int = 3, low: float | None = None, high: float | None = None) -> np.ndarray:
    """B-splines of a degree over equal segments, by the recursion of Cox and de Boor."""
    x = np.asarray(x, dtype=float)
    low, high = x.min() if low is None else low, x.max() if high is None else high
    width = (high - low) / nseg
    knots = low + width * np.arange(-deg, nseg + deg + 1)
    seg = np.clip(np.floor((x - low) / width).astype(int), 0, nseg - 1) + deg
    out = np.zeros((len(x), len(knots) - 1))
    out[np.arange(len(x)), seg] = 1.0
    for d in range(1, deg + 1):
        left = (x[:, None] - knots[None, : -d - 1]) / (d * width)
        right = (knots[None, d + 1 :] - x[:, None]) / (d * width)
        out = left * out[:, :-1] + right * out[:, 1:]
    return out


def decompose(n: int, pord: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Directions of a difference penalty: orthonormal ones with their eigenvalues, largest first."""
    d = np.diff(np.eye(n), n=pord, axis=0)
    values, vectors = np.linalg.eigh(d.T @ d)
    keep = np.argsort(-values)[: n - pord]
    return vectors[:, keep], values[keep]


class Axis:
    """One direction of a surface: its domain and its bases, one of them coarser for interactions."""

    def __init__(self, x: np.ndarray, nseg: int, nest: int = 1, deg: int = 3, pord: int = 2):
        if nseg % nest:
            raise ValueError("the number of segments is a multiple of nest")
        if len(np.unique(x)) < 2:
            raise ValueError("a surface needs two positions in each direction")
        self.low, self.high, self.nseg, self.nest, self.deg, self.pord = float(np.min(x)), float(np.max(x)), nseg, nest, deg, pord

    def at(self, x: np.ndarray, nested: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Penalised directions and their eigenvalues, the linear direction of unit length in the coefficients, and the
        constant's entry."""
        b = basis(x, self.nseg // self.nest if nested else self.nseg, self.deg, self.low, self.high)
        vectors, values = decompose(b.shape[1], self.pord)
        line = np.arange(b.shape[1]) - (b.shape[1] - 1) / 2
        return b @ vectors, values, b @ (line / np.linalg.norm(line)), 1 / np.sqrt(b.shape[1])


class Surface:
    """Tensor product of two penalised axes as fixed columns and five random blocks (Lee, Durban and Eilers 2013): smooth
    trends of each axis, linear by smooth interactions, and smooth by smooth on the nested bases, whose penalties add."""

    def __init__(self, row: np.ndarray, col: np.ndarray, nseg: tuple[int, int], deg: int = 3, pord: int = 2, nest: tuple[int, int] = (1, 1)):
        self.axes = [Axis(x, n, k, deg, pord) for x, n, k in zip((row, col), nseg, nest)]
        self.centre = 0.0
        self.centre = self.at(row, col)[0].mean(axis=0)

    def at(self, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        (zr, dr, lr, one_r), (zc, dc, lc, one_c) = (a.at(np.asarray(x, dtype=float)) for a, x in zip(self.axes, (row, col)))
        (nr, er, *_), (nc, ec, *_) = (a.at(np.asarray(x, dtype=float), nested=True) for a, x in zip(self.axes, (row, col)))
        both = (nr[:, :, None] * nc[:, None, :]).reshape(len(nr), -1) / np.sqrt((er[:, None] + ec[None, :]).ravel())
        zr, zc = zr / np.sqrt(dr), zc / np.sqrt(dc)
        fixed = np.stack([lr, lc, lr * lc], axis=1)
        return fixed - self.centre, {"row": zr * one_c, "col": zc * one_r, "row_linear_col": zr * lc[:, None], "col_linear_row": zc * lr[:, None], "row_col": both}


def surface(row: np.ndarray, col: np.ndarray, nseg: tuple[int, int], deg: int = 3, pord: int = 2, nest: tuple[int, int] = (1, 1)) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Fixed columns (row, col, row x col, centred) and the five random blocks at the positions that a surface is made for."""
    return Surface(row, col, nseg, deg, pord, nest).at(row, col)
