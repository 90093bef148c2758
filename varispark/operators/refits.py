"""Exact refits of many loci side by side: each locus has its own variances, and all take their steps together.

A locus's columns are combinations of the design's, so at any variances its restricted likelihood is the null model's plus a term
of its own score and information. The equations of all loci of a batch are stacked arrays: one call inverts them all, one sum
gives all gradients, and loci that have converged leave the batch. Steps are Newton steps with each locus's own Hessian, taken
once from differences of gradients and renewed if it doesn't serve.
"""

from __future__ import annotations

import numpy as np

from varispark.functions import structures
from varispark.operators import reml

#: Numbers that a batch's equations take at most.
BATCH = 1 << 23
STEP = 1e-4


def takes(model: reml.Model) -> bool:
    """Whether the stacked equations take a model: units in one section, terms of independent levels or given relationships."""
    return not (model.absorbed or model.residual.axes or len(model.sections) > 1) and all(e.term.level in ("id", "fixed") for e in model.random)


def independent(model: reml.Model, weights: np.ndarray) -> np.ndarray:
    """Whether each locus's columns depend neither on each other nor on the fixed effects."""
    total = np.zeros((model.m + 1, model.m + 1))
    for _, sums in model.cells.values():
        for (a, b), g in sums.items():
            if a == b:
                g.add_to(total, 1.0)
    f, p = total[: model.m, : model.m] @ weights, model.p
    x = np.concatenate([np.broadcast_to(total[:p, :p], (len(weights), p, p)), f[:, :p]], axis=2)
    x = np.concatenate([x, np.concatenate([f[:, :p].transpose(0, 2, 1), weights.transpose(0, 2, 1) @ f], axis=2)], axis=1)
    scale = np.sqrt(np.maximum(np.einsum("nii->ni", x), 1e-300))
    return (np.linalg.eigvalsh(x / (scale[:, :, None] * scale[:, None, :])) > 1e-10).all(axis=1)


class Batch:
    """The equations of some loci; weights: locus, the design's columns, the locus's columns."""

    def __init__(self, like: reml.Likelihood, weights: np.ndarray):
        self.like, self.a = like, weights
        m = self.m = like.model
        size = m.m + 1
        self.cells = [(p, a, b, g) for (_, p), (_, sums) in m.cells.items() for (a, b), g in sums.items()]
        self.units = {p: u for (_, p), (u, _) in m.cells.items()}
        self.sums = np.zeros((len(self.cells), size, size))
        for k, (_, a, b, g) in enumerate(self.cells):
            g.add_to(self.sums[k], 1.0, both=a != b)
        self.kinv = [np.linalg.inv(e.k) if e.term.level == "fixed" else None for e in m.random]
        self.logk = [np.linalg.slogdet(e.k)[1] if e.term.level == "fixed" else 0.0 for e in m.random]

    def _residual(self, own: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights of the cells and log |R| at the residual's parameters."""
        r = self.m.structure(self.m.sections[0])
        full = structures.sigma(own, r.struct, len(self.m.traits), r.rank)
        inverse = {p: np.linalg.inv(full[np.ix_(t, t)]) for p in self.units for t in [[int(v) for v in p.split(",")]]}
        places = {p: [int(v) for v in p.split(",")] for p in self.units}
        w = np.array([inverse[p][places[p].index(a), places[p].index(b)] for p, a, b, _ in self.cells])
        return w, sum(u * np.linalg.slogdet(full[np.ix_(places[p], places[p])])[1] for p, u in self.units.items()) - self.m.log_weights

    def evaluate(self, theta: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the loci of which, each at its row of theta: value, gradient, effects and information; not finite where it can't be told."""
        m, like, a, n = self.m, self.like, self.a[which], len(which)
        rs = like.residual[0]
        made = [self._residual(t[rs]) for t in theta]
        w, value = np.array([x[0] for x in made]).reshape(n, -1), np.array([x[1] for x in made])
        big = np.tensordot(w, self.sums, axes=1)
        inner, right, yy = big[:, : m.m, : m.m], big[:, : m.m, m.m], big[:, m.m, m.m]
        c = inner.copy()
        for e, (ss, _), kinv, logk in zip(m.random, like.slices, self.kinv, self.logk):
            at = slice(e.offset, e.offset + e.t * e.q)
            s = np.array([structures.sigma(t[ss], e.term.struct, e.t, e.term.rank) for t in theta])
            inv = np.linalg.inv(s)
            value = value + e.q * np.linalg.slogdet(s)[1] + e.t * logk
            c[:, at, at] += np.einsum("nab,ij->naibj", inv, np.eye(e.q) if kinv is None else kinv).reshape(n, e.t * e.q, e.t * e.q)
        sign, log_c = np.linalg.slogdet(c)
        cinv = np.linalg.inv(c)
        x0 = np.einsum("nij,nj->ni", cinv, right)
        f = inner @ a
        through = cinv @ f
        score = np.einsum("nik,ni->nk", a, right) - np.einsum("nik,ni->nk", f, x0)
        information = a.transpose(0, 2, 1) @ f - f.transpose(0, 2, 1) @ through
        info_inv = np.linalg.inv(information)
        effects = np.einsum("nkl,nl->nk", info_inv, score)
        sign2, log_i = np.linalg.slogdet(information)
        value = value + log_c + log_i + yy - (right * x0).sum(1) - (score * effects).sum(1)
        value = np.where((sign > 0) & (sign2 > 0), value, np.inf)
        own = x0 - np.einsum("nik,nk->ni", through, effects)
        z = np.concatenate([-(own + np.einsum("nik,nk->ni", a, effects)), np.ones((n, 1))], axis=1)
        rest = a - through
        meet = z[:, :, None] * z[:, None, :]
        meet[:, : m.m, : m.m] += cinv + rest @ info_inv @ rest.transpose(0, 2, 1)
        random = cinv + through @ info_inv @ through.transpose(0, 2, 1) + own[:, :, None] * own[:, None, :]
        dots = np.stack([meet[:, g.i, g.j] @ g.x for *_, g in self.cells], axis=1) * np.array([1.0 if p == q else 2.0 for _, p, q, _ in self.cells])
        grad = np.zeros((n, like.size))
        for k, t in enumerate(theta):
            for j in range(rs.start, rs.stop):
                ahead, behind = t[rs].copy(), t[rs].copy()
                ahead[j - rs.start] += 1e-6
                behind[j - rs.start] -= 1e-6
                (w1, l1), (w0, l0) = self._residual(ahead), self._residual(behind)
                grad[k, j] = (l1 - l0 + float((w1 - w0) @ dots[k])) / 2e-6
        for e, (ss, _), kinv in zip(m.random, like.slices, self.kinv):
            at = slice(e.offset, e.offset + e.t * e.q)
            block = random[:, at, at].reshape(n, e.t, e.q, e.t, e.q)
            traces = np.einsum("naibi->nab", block) if kinv is None else np.einsum("naibj,ij->nab", block, kinv)
            for k, t in enumerate(theta):
                grad[k, ss] = reml.between_gradient(t[ss], e.term, e.t, e.q, traces[k])
        return value, grad, effects, info_inv

    def hessian(self, theta: np.ndarray, which: np.ndarray, free: np.ndarray) -> np.ndarray:
        k = np.nonzero(free)[0]
        out = np.zeros((len(which), len(k), len(k)))
        for i, j in enumerate(k):
            e = np.eye(theta.shape[1])[j] * STEP
            out[:, i] = (self.evaluate(theta + e, which)[1][:, k] - self.evaluate(theta - e, which)[1][:, k]) / (2 * STEP)
        return (out + out.transpose(0, 2, 1)) / 2


def fit(like: reml.Likelihood, start: np.ndarray, free: np.ndarray, weights: np.ndarray, low: float = -12.0, high: float = 12.0, rounds: int = 40, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """theta, value, whether it has converged, effects and their covariance for each locus of weights."""
    batch, n, k = Batch(like, weights), len(weights), np.nonzero(free)[0]
    theta = np.tile(start, (n, 1))
    every = np.arange(n)
    value, grad, effects, cov = batch.evaluate(theta, every)
    done = np.zeros(n, dtype=bool) if len(k) else np.isfinite(value)
    lost = ~np.isfinite(value)
    hess, age = np.zeros((n, len(k), len(k))), np.full(n, 99)
    size = np.ones(n)
    for _ in range(rounds):
        live = np.nonzero(~done & ~lost)[0]
        if not len(live):
            break
        old = live[age[live] > 4]
        if len(old):
            hess[old] = batch.hessian(theta[old], old, free)
            age[old] = 0
        new = theta[live].copy()
        gain = np.zeros(len(live))
        for i, b in enumerate(live):
            g = grad[b, k]
            inside = ~(((theta[b, k] <= low + 1e-9) & (g > 0)) | ((theta[b, k] >= high - 1e-9) & (g < 0)))
            step = np.zeros(len(k))
            if inside.any():
                values, vectors = np.linalg.eigh(hess[b][np.ix_(inside, inside)])
                values = np.maximum(np.abs(values), 1e-5 * max(1.0, float(np.abs(values).max())))
                step[inside] = -vectors @ ((vectors.T @ g[inside]) / values)
            gain[i] = -float(g @ step)
            step *= size[b] * min(1.0, 2.0 / max(1e-300, float(np.abs(step).max())))
            new[i, k] = np.clip(theta[b, k] + step, low, high)
        ended = gain < tol
        done[live[ended]] = True
        live, new, gain = live[~ended], new[~ended], gain[~ended]
        if not len(live):
            continue
        got = batch.evaluate(new, live)
        better = np.isfinite(got[0]) & (got[0] < value[live] + 1e-10 * np.abs(value[live]) + 1e-12)
        up = live[better]
        theta[up], value[up], grad[up], effects[up], cov[up] = new[better], *[x[better] for x in got]
        size[up] = 1.0
        age[up] += 1
        down = live[~better]
        size[down] /= 4
        stuck = ~better & (size[live] < 1e-3)
        done[live[stuck & (gain < 1e-4)]] = True  # what a step would gain is below what the value can tell
        lost[live[stuck & (gain >= 1e-4)]] = True
    return theta, value, done, effects, cov
