"""Inverses of symmetric matrices that fall into blocks once a border of rows and columns is taken away.

Mixed-model equations are of this kind: with the fixed effects and the small factors as the border, what is left of a large
factor of independent levels is diagonal, and nested factors are a block for each of the outer one's levels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each of n nodes' connected components under the links i-j."""
    root = np.arange(n)
    while True:
        x, y = root[i], root[j]
        apart = x != y
        if not apart.any():
            return root
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        i, j = i[apart], j[apart]


@dataclass
class Split:
    """A border, and the blocks of the rest grouped by their sizes: for each size the members, a row for each block."""

    border: np.ndarray
    rest: np.ndarray
    groups: list[np.ndarray]  # places within rest
    cost: float

    @property
    def blocks(self) -> int:
        return sum(len(g) for g in self.groups)


def arrange(n: int, border: np.ndarray, i: np.ndarray, j: np.ndarray) -> Split:
    """Blocks of what a border (a mask) leaves, and the multiplications that an inverse takes, about."""
    rest = np.nonzero(~border)[0]
    place = np.full(n, -1)
    place[rest] = np.arange(len(rest))
    inner = ~border[i] & ~border[j]
    own = labels(len(rest), place[i[inner]], place[j[inner]])
    order = np.argsort(own, kind="stable")
    cut = np.concatenate([[0], np.nonzero(np.diff(own[order]))[0] + 1, [len(rest)]]) if len(rest) else np.array([0])
    by_size: dict[int, list[np.ndarray]] = {}
    for a, b in zip(cut, cut[1:]):
        by_size.setdefault(int(b - a), []).append(order[a:b])
    k = int(border.sum())
    cost = sum(len(g) * float(s) ** 3 for s, g in by_size.items()) + float(k) ** 3 + float(len(rest)) ** 2 * (k + 1)
    return Split(np.nonzero(border)[0], rest, [np.stack(by_size[s]) for s in sorted(by_size)], cost)


def search(n: int, groups: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> Split | None:
    """The cheapest border made of groups of rows: those that are given first, then more of them, one at a time, each time
    the one that makes the rest cheapest; then back, as long as leaving one out is cheaper. None if a plain inverse is."""
    border = np.zeros(n, dtype=bool)
    chosen: set[int] = set()

    def with_groups(which: set[int]) -> Split:
        mask = border.copy()
        for g in which:
            mask[groups[g]] = True
        return arrange(n, mask, i, j)

    best, at = None, with_groups(chosen)
    best = at
    while len(chosen) < len(groups):
        tried = [(with_groups(chosen | {g}), g) for g in range(len(groups)) if g not in chosen]
        at, g = min(tried, key=lambda t: t[0].cost)
        chosen.add(g)
        if at.cost < best.cost:
            best, kept = at, set(chosen)
    if best.cost < float(n) ** 3 and len(best.border):
        chosen = kept
        while chosen:
            tried = [(with_groups(chosen - {g}), g) for g in chosen]
            at, g = min(tried, key=lambda t: t[0].cost)
            if at.cost >= best.cost:
                break
            best = at
            chosen.remove(g)
    return best if best.cost < 0.5 * float(n) ** 3 else None


def inverse(c: np.ndarray, split: Split | None) -> tuple[np.ndarray, float]:
    """Inverse and log determinant of a positive definite matrix; LinAlgError if it is not. Rows are brought to a diagonal
    of one first, as variances that lie far apart would take the smaller one's digits."""
    diagonal = np.diag(c)
    if not (diagonal > 0).all():
        raise np.linalg.LinAlgError("not positive definite")
    scale = 1 / np.sqrt(diagonal)
    out, logdet = _inverse(c * scale[:, None] * scale, split)
    out *= scale[:, None] * scale
    return out, logdet - 2 * float(np.log(scale).sum())


def _inverse(c: np.ndarray, split: Split | None) -> tuple[np.ndarray, float]:
    if split is None:
        low = np.linalg.cholesky(c)
        return np.linalg.inv(c), 2 * float(np.log(np.diag(low)).sum())
    f, r = split.border, split.rest
    beside, logdet = c[np.ix_(r, f)], 0.0
    through, inner = np.empty_like(beside), []
    for members in split.groups:
        at = r[members]
        blocks = c[at[:, :, None], at[:, None, :]]
        if members.shape[1] == 1:
            if (blocks <= 0).any():
                raise np.linalg.LinAlgError("not positive definite")
            logdet += float(np.log(blocks).sum())
            own = 1 / blocks
        else:
            logdet += 2 * float(np.log(np.diagonal(np.linalg.cholesky(blocks), axis1=1, axis2=2)).sum())
            own = np.linalg.inv(blocks)
        inner.append(own)
        through[members.ravel()] = (own @ beside[members]).reshape(-1, len(f))
    corner = c[np.ix_(f, f)] - beside.T @ through
    corner = (corner + corner.T) / 2
    logdet += 2 * float(np.log(np.diag(np.linalg.cholesky(corner))).sum())
    small = np.linalg.inv(corner)
    out = np.empty_like(c)
    side = through @ small
    whole = side @ through.T
    for members, own in zip(split.groups, inner):
        whole[members[:, :, None], members[:, None, :]] += own
    out[np.ix_(r, r)] = whole
    out[np.ix_(r, f)] = -side
    out[np.ix_(f, r)] = -side.T
    out[np.ix_(f, f)] = small
    return out, logdet
