"""Small driver-side optimisation: average information and Newton steps, quasi-Newton, Hessians and diagnostics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def gradient(f: Callable, x: np.ndarray, h: float = 1e-5) -> np.ndarray:
    out = np.zeros(len(x))
    for i in range(len(x)):
        e = np.zeros(len(x))
        e[i] = h
        out[i] = (f(x + e) - f(x - e)) / (2 * h)
    return out


def hessian(grad: Callable, x: np.ndarray, h: float = 1e-4, low: float | np.ndarray = -12.0, high: float | np.ndarray = 12.0, free: np.ndarray | None = None) -> np.ndarray:
    """Symmetric Hessian by central differences of a gradient; one-sided ones, into the box, at its faces. Rows and columns of
    parameters that aren't free, if that is said, are zero."""
    n = len(x)
    out = np.zeros((n, n))
    low, high = np.broadcast_to(low, n), np.broadcast_to(high, n)
    for i in range(n) if free is None else np.nonzero(free)[0]:
        e = np.zeros(n)
        e[i] = h
        up, down = (x + e if x[i] + h <= high[i] else x), (x - e if x[i] - h >= low[i] else x)
        out[i] = (grad(up) - grad(down)) / max(1e-300, up[i] - down[i])
    if free is not None:
        out[:, ~np.asarray(free)] = 0.0
    return (out + out.T) / 2


def live(x: np.ndarray, grad: np.ndarray, free: np.ndarray, low, high) -> np.ndarray:
    """Free parameters that are not held at a face of the box by the gradient."""
    return free & ~(((x <= np.asarray(low) + 1e-9) & (grad > 0)) | ((x >= np.asarray(high) - 1e-9) & (grad < 0)))


def newton(f: Callable, curvature: Callable, x0: np.ndarray, free: np.ndarray, low=-12.0, high=12.0, rounds: int = 40, tol: float = 1e-10) -> tuple[np.ndarray, float, bool]:
    """Damped steps with a curvature matrix (average information, or a Hessian) within a box.

    f gives value and gradient, curvature(x) a matrix. The damping falls after steps that go as foreseen and rises else;
    parameters at a face that the gradient points out of are left there. Returns the point, its value, and whether the
    decrement is below tol.
    """
    x = np.clip(np.asarray(x0, dtype=float), low, high)
    value, grad = f(x)
    damping = 1e-3
    for _ in range(rounds):
        k = np.nonzero(live(x, grad, free, low, high))[0]
        if not len(k):
            return x, value, True
        a = curvature(x)[np.ix_(k, k)]
        scale = np.maximum(np.diag(a), 1e-8)
        moved = False
        while damping < 1e8:
            try:
                step = -np.linalg.solve(a + damping * np.diag(scale), grad[k])
            except np.linalg.LinAlgError:
                damping = max(1e-6, 10 * damping)
                continue
            slope = float(grad[k] @ step)
            if slope < 0 and -slope < tol:
                return x, value, True
            step *= min(1.0, 2.0 / max(1e-300, float(np.abs(step).max())))
            new = x.copy()
            new[k] = np.clip(x[k] + step, np.broadcast_to(low, len(x))[k], np.broadcast_to(high, len(x))[k])
            try:
                got, d = f(new)
            except np.linalg.LinAlgError:
                got, d = np.inf, grad
            if slope < 0 and np.isfinite(got) and got < value + 1e-4 * slope:
                x, value, grad, moved = new, got, d, True
                damping = max(1e-9, damping / 10)
                break
            damping = max(1e-6, 10 * damping)
        if not moved:
            return x, value, False
    return x, value, False


def polish(grad: Callable, x: np.ndarray, hess: np.ndarray, free: np.ndarray, low=-12.0, high=12.0, rounds: int = 6, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, bool]:
    """Newton steps near a minimum by the gradient alone, for values that lose the digits a line search needs (sums of squares
    far above the residuals'). A step is taken if the curvature is positive before and after it, the decrement is below one, and
    falls by half. Returns the point, its Hessian, and whether the decrement is below tol."""

    def step_of(z: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        g, step = grad(z), np.zeros(len(z))
        k = np.nonzero(live(z, g, free, low, high))[0]
        if not len(k):
            return step, 0.0
        values, vectors = np.linalg.eigh(h[np.ix_(k, k)])
        if values[0] <= 1e-8 * max(1.0, float(np.abs(values).max())):
            return step, np.inf
        step[k] = -vectors @ (vectors.T @ g[k] / values)
        return step, float(-step @ g)

    step, decrement = step_of(x, hess)
    for _ in range(rounds):
        if not tol <= decrement < 1:
            break
        new = np.clip(x + step, low, high)
        try:
            h = hessian(grad, new, low=low, high=high, free=free)
            ahead, left = step_of(new, h)
        except np.linalg.LinAlgError:
            break
        if not left < decrement / 2:
            break
        x, hess, step, decrement = new, h, ahead, left
    return x, hess, decrement < tol


def diagnostics(x: np.ndarray, value: float, grad: np.ndarray, hess: np.ndarray, free: np.ndarray, low=-12.0, high=12.0) -> dict:
    """Newton decrement and relative projected gradient over the parameters off the box's faces, smallest curvature of the
    free ones, how many lie at a face, and whether it all adds up to a minimum."""
    k = np.nonzero(live(x, grad, free, low, high))[0]
    at_bound = int((free & ((x <= np.asarray(low) + 1e-7) | (x >= np.asarray(high) - 1e-7))).sum())
    if not len(k):
        return {"decrement": 0.0, "projected_gradient": 0.0, "curvature": float("inf"), "n_at_bound": at_bound, "pd_hessian": True, "converged": True}
    values, vectors = np.linalg.eigh(hess[np.ix_(k, k)])
    keep = values > 1e-8 * max(1.0, float(np.abs(values).max()))
    turned = vectors.T @ grad[k]
    decrement = float((turned[keep] ** 2 / values[keep]).sum())
    relative = float(np.abs(grad[k]).max()) / max(1.0, abs(value))
    return {"decrement": decrement, "projected_gradient": relative, "curvature": float(values.min()), "n_at_bound": at_bound, "pd_hessian": bool(keep.all()), "converged": decrement < 1e-4 or relative < 1e-6}


def minimise(f: Callable, x0: np.ndarray, free: np.ndarray | None = None, low: float | np.ndarray = -12.0, high: float | np.ndarray = 12.0, rounds: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, float, bool]:
    """BFGS within a box over the free parameters of f, which gives its value and gradient.

    Returns the point, its value, and whether the decrement is below tol.
    """
    free = np.ones(len(x0), dtype=bool) if free is None else free
    x = np.clip(np.asarray(x0, dtype=float), low, high)
    low, high = np.broadcast_to(low, len(x))[free], np.broadcast_to(high, len(x))[free]

    def g(z: np.ndarray) -> tuple[float, np.ndarray]:
        full = x.copy()
        full[free] = z
        try:
            v, d = f(full)
        except np.linalg.LinAlgError:
            return np.inf, np.zeros(len(z))
        return (v, d[free]) if np.isfinite(v) else (np.inf, np.zeros(len(z)))

    z, n = x[free], int(free.sum())
    if not n:
        return x, f(x)[0], True
    value, grad = g(z)
    fresh_start = lambda d: np.eye(n) * min(0.1, 0.5 / max(1e-12, float(np.abs(d).max())))
    inv, clean, done = fresh_start(grad), True, False
    for _ in range(rounds):
        live = ~(((z <= low + 1e-9) & (grad > 0)) | ((z >= high - 1e-9) & (grad < 0)))
        step = np.zeros(n)
        step[live] = -inv[np.ix_(live, live)] @ grad[live]
        slope = float(step @ grad)
        if -slope < tol and (not clean or np.abs(grad[live]).max(initial=0) < 1e-6):
            done = True
            break
        step *= min(1.0, 2.0 / max(1e-300, np.abs(step).max()))
        size, moved = 1.0, False
        for _ in range(40):
            new = np.clip(z + size * step, low, high)
            got, d = g(new)
            if got < value + 1e-4 * size * slope:
                moved = True
                break
            size /= 2
        if not moved:
            if clean:
                done = np.abs(grad[live]).max(initial=0) < 1e-4
                break
            inv, clean = fresh_start(grad), True
            continue
        s, y = new - z, d - grad
        if s @ y > 1e-12:
            if clean:
                inv = np.eye(n) * (s @ y) / (y @ y)
            r = 1 / (s @ y)
            left = np.eye(n) - r * np.outer(s, y)
            inv, clean = left @ inv @ left.T + r * np.outer(s, s), False
        z, value, grad = new, got, d
    x[free] = z
    return x, value, done
