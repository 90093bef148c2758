"""Inference on fits: small-sample F tests, tables of ratios, differences of predictions, comparisons of fits.

What these need of the data is in the fit's cross-products, so none reads the data again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from varispark.functions import optimise, structures
from varispark.functions.special import chi2_sf, f_sf, normal_ppf
from varispark.operators.reml import Fit


def _parts(fit: Fit) -> tuple[np.ndarray, float, list]:
    """Cross-products W'W of the design W = [X Z], the residual variance, and each term's place and relationship."""
    m = fit.model
    if len(m.traits) > 1 or len(m.sections) > 1 or m.residual.axes or m.absorbed or any(e.t > 1 or sl.stop > sl.start for e, (_, sl) in zip(m.random, fit.likelihood.slices)):
        raise ValueError("takes variance components of one trait, one section and fixed relationships")
    ((_, sums),) = m.cells.values()
    terms = [(slice(e.offset, e.offset + e.q), np.eye(e.q) if e.k is None else e.k) for e in m.random]
    return sums[(0, 0)].dense()[: m.m, : m.m], float(np.exp(2 * fit.theta[-1])), terms


def _adjusted(fit: Fit) -> tuple:
    """Adjusted covariance of the fixed effects, the unadjusted one, its derivatives by component, and the components' covariance."""
    m = fit.model
    d, s, terms = _parts(fit)
    size, p = m.m, m.p
    inner = d[p:, p:] / s
    for (k, kin), (ss, _) in zip(terms, fit.likelihood.slices):
        j = slice(k.start - p, k.stop - p)
        inner[j, j] += np.linalg.inv(kin) * np.exp(-2 * fit.theta[ss][0])
    spread = np.zeros((size, size))
    spread[p:] = np.linalg.solve(inner, d[p:] / s)
    low = (np.eye(size) - spread) / s
    f = fit.cinv / s
    n_mat = (np.eye(size) - f @ d) / s
    dl, dn, ll, nn = d @ low, d @ n_mat, low.T @ d @ low, n_mat.T @ d @ n_mat
    lll, parts, x = low.T @ d @ low @ low, len(terms) + 1, slice(0, p)
    phi = fit.cinv[x, x]
    first = [-dl[k, x].T @ kin @ dl[k, x] for k, kin in terms] + [-ll[x, x]]
    info, second = np.zeros((parts, parts)), {}
    for i in range(parts):
        for j in range(parts):
            if i < len(terms) and j < len(terms):
                (a, ka), (b, kb) = terms[i], terms[j]
                second[i, j] = dl[a, x].T @ ka @ dl[a, b] @ kb @ dl[b, x]
                info[i, j] = 0.5 * np.trace(ka @ dn[a, b] @ kb @ dn[b, a])
            elif i < len(terms) or j < len(terms):
                a, ka = terms[min(i, j)]
                q = dl[a, x].T @ ka @ ll[a, x]
                second[i, j] = q if i < j else q.T
                info[i, j] = 0.5 * np.trace(ka @ nn[a, a])
            else:
                fd = f @ d
                second[i, j] = lll[x, x]
                info[i, j] = 0.5 * (m.n - 2 * np.trace(fd) + np.trace(fd @ fd)) / s**2
    w = np.linalg.inv(info)
    lam = sum(w[i, j] * (second[i, j] - first[i] @ phi @ first[j]) for i in range(parts) for j in range(parts))
    return phi + 2 * phi @ lam @ phi, phi, first, w, parts


def kenward_roger_covariance(fit: Fit) -> np.ndarray:
    """Covariance of the fixed effects, adjusted for the estimation of the variances."""
    return _adjusted(fit)[0]


def kenward_roger(fit: Fit) -> DataFrame:
    """F test of each fixed term with an adjusted covariance and denominator degrees of freedom, after Kenward and Roger
    (1997): term, df1, df2, f, p. Columns of the design must be independent.

    V^-1 W = W L and P W = W N hold for small matrices L and N, so that all traces are of the size of the equations.
    """
    m = fit.model
    adjusted, phi, first, w, parts = _adjusted(fit)
    p = m.p
    rows = []
    for e in m.fixed:
        pick = np.eye(p)[:, e.offset : e.offset + e.q]
        k = e.q
        theta = pick @ np.linalg.solve(pick.T @ phi @ pick, pick.T)
        turned = [theta @ phi @ g @ phi for g in first]
        a1 = sum(w[i, j] * np.trace(turned[i]) * np.trace(turned[j]) for i in range(parts) for j in range(parts))
        a2 = sum(w[i, j] * np.trace(turned[i] @ turned[j]) for i in range(parts) for j in range(parts))
        b = fit.estimates[e.offset : e.offset + e.q]
        f_raw = float(b @ np.linalg.solve(pick.T @ adjusted @ pick, b)) / k
        if abs(a2) < 1e-14:
            rows.append((e.name, k, float("inf"), float(f_raw), chi2_sf(f_raw * k, k)))
            continue
        big = (a1 + 6 * a2) / (2 * k)
        g = ((k + 1) * a1 - (k + 4) * a2) / ((k + 2) * a2)
        c1, c2, c3 = (v / (3 * k + 2 * (1 - g)) for v in (g, k - g, k + 2 - g))
        mean, var = 1 / (1 - a2 / k), 2 / k * (1 + c1 * big) / ((1 - c2 * big) ** 2 * (1 - c3 * big))
        rho = var / (2 * mean**2)
        df2 = 4 + (k + 2) / (k * rho - 1)
        value = df2 / (mean * (df2 - 2)) * f_raw
        rows.append((e.name, k, float(df2), float(value), float(f_sf(value, k, df2))))
    return fit.spark.createDataFrame(rows, "term string, df1 int, df2 double, f double, p double")


def ratios(fit: Fit, total: list[str] | None = None, level: float = 0.95, width_max: float = 1.5) -> DataFrame:
    """Variances, their shares of the total, and correlations within unstructured terms, with delta-method errors:
    quantity, component, estimate, se, ci_low, ci_high, informative, at_bound.

    total: the components that make up the total; all variances of one-component terms and residuals if not given.
    Correlations have intervals on Fisher's scale and are informative if these are at most width_max wide.
    """
    m, like = fit.model, fit.likelihood
    blocks = [(e.name, ss, e.term.struct, e.t, e.term.rank) for e, (ss, _) in zip(m.random, like.slices)]
    if not m.residual.axes:
        blocks += [("residual" + (f"({s})" if s is not None else ""), sl, m.residual.struct, len(m.traits), m.residual.rank) for s, sl in zip(m.sections, like.residual)]
    names = [n for n in fit.components() if n in (total if total is not None else [b[0] for b in blocks if b[3] == 1] + (["residual"] if m.residual.axes else []))]
    quantities = [("variance", n, lambda th, n=n: fit.components(th)[n]) for n in names]
    quantities += [("share", n, lambda th, n=n: fit.components(th)[n] / sum(fit.components(th)[k] for k in names)) for n in names]
    for name, sl, struct, t, rank in blocks:
        for i in range(t):
            for j in range(i):

                def cor(th, sl=sl, struct=struct, t=t, rank=rank, i=i, j=j):
                    s = structures.sigma(th[sl], struct, t, rank)
                    return s[i, j] / math.sqrt(s[i, i] * s[j, j])

                quantities.append(("correlation", f"{name}[{i + 1},{j + 1}]", cor))
    cov, z, rows = fit.theta_cov, normal_ppf(0.5 + level / 2), []
    bound = np.abs(fit.theta) > 11.9
    for kind, name, f in quantities:
        v, g = f(fit.theta), optimise.gradient(f, fit.theta)
        se = math.sqrt(max(0.0, float(g @ cov @ g)))
        lo, hi, useful = v - z * se, v + z * se, None
        if kind == "correlation":
            r = min(max(v, -0.999999), 0.999999)
            half = z * se / max(1 - v * v, 1e-8)
            lo, hi = math.tanh(math.atanh(r) - half), math.tanh(math.atanh(r) + half)
            useful = hi - lo <= width_max
        rows.append((kind, name, float(v), se, lo, hi, useful, bool(np.abs(g[bound]).sum() > 0.05 * np.abs(g).sum())))
    return fit.spark.createDataFrame(rows, "quantity string, component string, estimate double, se double, ci_low double, ci_high double, informative boolean, at_bound boolean")


def likelihood_ratio(full: Fit, reduced: Fit, boundary: bool = True) -> tuple[float, float]:
    """Statistic and p of one variance more; on the boundary half a chi-square with one degree of freedom."""
    lrt = max(0.0, 2 * (full.loglik - reduced.loglik))
    return lrt, (0.5 if boundary else 1.0) * chi2_sf(lrt, 1)


def differences(fit: Fit, rows: dict[str, np.ndarray]) -> DataFrame:
    """Differences of linear functions of all effects (fixed then random, in the order of the equations), and their
    errors: a, b, difference, sed. A list of predictions, not of data rows."""
    names, out = list(rows), []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            d = rows[a] - rows[b]
            out.append((a, b, float(d @ fit.estimates), math.sqrt(max(0.0, float(d @ fit.cinv @ d)))))
    return fit.spark.createDataFrame(out, "a string, b string, difference double, sed double")


def estimable(fit: Fit, row: np.ndarray, tol: float = 1e-8) -> bool:
    """Whether a function of the fixed effects lies in the row space of their design."""
    m = fit.model
    x = sum(g.dense()[: m.p, : m.p] for _, sums in m.cells.values() for k, g in sums.items() if k == "II" or k[0] == k[1] and not isinstance(k, str))
    return bool(np.abs(row[: m.p] - np.linalg.pinv(x, rcond=1e-10) @ (x @ row[: m.p])).max(initial=0) < tol)


def summary(fit: Fit) -> DataFrame:
    """One row: observations, fixed rank, free parameters, loglik, aic, bic, converged, smallest curvature of the free part."""
    k = np.nonzero(fit.free)[0]
    low = float(np.linalg.eigvalsh(fit.hessian[np.ix_(k, k)]).min()) if len(k) else math.inf
    row = (int(fit.model.n), fit.rank, len(k), float(fit.loglik), float(fit.aic), float(fit.bic), bool(fit.converged), low, low > 0)
    return fit.spark.createDataFrame([row], "n long, rank int, n_par int, loglik double, aic double, bic double, converged boolean, curvature double, pd_hessian boolean")
