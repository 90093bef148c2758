"""Tables on a fit: components with their standing, entries that can't be told apart, ratios of targets, a report."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame

from varispark.functions import optimise, structures
from varispark.functions.special import normal_ppf
from varispark.operators.reml import Fit


def aliased(fit: Fit, tol: float = 1e-8) -> list[tuple[str, list[tuple[int, int]]]]:
    """Entries of unstructured terms whose coefficients in V are the same matrix, as (term, entries): only their sum is
    identified. The matrices are compared by their inner products, which the cross-products of the design give."""
    m, out = fit.model, []
    if m.residual.axes:
        return out
    full = np.zeros((m.m + 1, m.m + 1))
    for _, sums in m.cells.values():
        for (a, b), g in sums.items():
            if a == b:
                g.add_to(full, 1.0)
    for e in m.random:
        if e.term.struct != "us" or e.t < 2 or e.absorbed is not None:
            continue
        kin = e.k if isinstance(e.k, np.ndarray) else np.eye(e.q)
        block = lambda i, j: full[e.offset + i * e.q : e.offset + (i + 1) * e.q, e.offset + j * e.q : e.offset + (j + 1) * e.q]  # noqa: E731, B023
        entries = [(i, j) for i in range(e.t) for j in range(i + 1)]

        def inner(x: tuple[int, int], y: tuple[int, int]) -> float:
            """Of Z_i K Z_j' + Z_j K Z_i' (halved on the diagonal) for two entries."""
            total = 0.0
            for i, j in (x, x[::-1]):
                for k, l in (y, y[::-1]):
                    total += np.trace(kin @ block(j, l) @ kin @ block(k, i)) / ((1 + (x[0] == x[1])) * (1 + (y[0] == y[1])))  # noqa: B023
            return float(total)

        norms = {x: inner(x, x) for x in entries}
        left = list(entries)
        while left:
            first, *rest = left
            same = [y for y in rest if abs(norms[first] + norms[y] - 2 * inner(first, y)) <= tol * max(norms[first], norms[y], 1e-300)]
            if same and norms[first] > 0:
                out.append((e.name, [first, *same]))
            left = [y for y in rest if y not in same]
    return out


def components(fit: Fit) -> DataFrame:
    """i, name, value, se and constraint of each component, in the order V1, V2, ...: F hangs on fixed parameters only, B on
    one at its bound, on a flat direction or of a singular matrix, N can't be told from others (their sum follows at the end of the table), P is
    a variance and U any other. F, B and N have no standard error."""
    names = list(fit.components())
    value = lambda th: np.array([fit.components(th)[n] for n in names])
    jac = np.zeros((len(names), len(fit.theta)))
    for j in range(len(fit.theta)):
        e = np.eye(len(fit.theta))[j] * 1e-5
        jac[:, j] = (value(fit.theta + e) - value(fit.theta - e)) / 2e-5
    cov, flat = fit.curvature()
    free = fit.free & ~fit.at_bound

    def standing(row: np.ndarray, name: str) -> str:
        hangs = np.abs(row) > 1e-12 * max(1.0, float(np.abs(row).max()))
        if hangs.any() and not fit.free[hangs].any():
            return "F"
        if any(name.startswith(f"{term}[") for term in fit.faces):
            return "B"
        length = float((row[free] ** 2).sum())
        if (fit.at_bound & fit.free)[hangs].any() or flat.shape[1] and length > 0 and float(((row @ flat) ** 2).sum()) / length > 0.05:
            return "B"
        cell = re.search(r"\[([^,\]]+),([^\]]+)\]$", name)
        plain = "." not in name.split(")")[-1] and (cell is None or cell[1] == cell[2])
        return "P" if plain else "U"

    now = value(fit.theta)
    rows = [[k + 1, n, float(now[k]), None, standing(jac[k], n)] for k, n in enumerate(names)]
    for k, r in enumerate(rows):
        if r[4] in ("P", "U"):
            r[3] = math.sqrt(max(0.0, float(jac[k] @ cov @ jac[k])))
    for term, entries in aliased(fit):
        e = next(e for e in fit.model.random if e.name == term)
        label = [str(t) for t in fit.model.traits] if e.t == len(fit.model.traits) > 1 else [str(i + 1) for i in range(e.t)]
        at = [names.index(n) for n in (f"{term}[{label[i]},{label[j]}]" for i, j in entries) if n in names]
        if len(at) < 2:
            continue
        for k in at:
            rows[k][3:] = [None, "N"]
        total = jac[at].sum(axis=0)
        code = standing(total, "[1,2]")
        rows.append([len(rows) + 1, "+".join(names[k] for k in at), float(now[at].sum()), math.sqrt(max(0.0, float(total @ cov @ total))) if code == "U" else None, code])
    return fit.spark.createDataFrame([tuple(r) for r in rows], "i int, name string, value double, se double, constraint string")


def reference(fit: Fit, text: str) -> tuple[str, int, int]:
    """A component named as term, term[i], term[i,j], term:label or a~b: the term (or residual) and its two columns."""
    m = fit.model
    sizes = {e.name: e.t for e in m.random} | {("residual" + (f"({s})" if s is not None else "")): len(m.traits) for s in m.sections}
    labels = {n: [str(t) for t in m.traits] if t == len(m.traits) > 1 else [str(i + 1) for i in range(t)] for n, t in sizes.items()}
    if "~" in text:
        (a, i, _), (b, j, _) = (reference(fit, x.strip()) for x in text.split("~", 1))
        if a != b:
            raise ValueError(f"{text!r}: the two columns are of different terms")
        return a, i, j
    if text in sizes:
        if sizes[text] > 1:
            raise ValueError(f"{text!r} has {sizes[text]} columns: name one")
        return text, 0, 0
    for name in sorted(sizes, key=len, reverse=True):
        rest = text[len(name) :]
        if not text.startswith(name) or not rest:
            continue
        if rest[0] == ":" and rest[1:] in labels[name]:
            k = labels[name].index(rest[1:])
            return name, k, k
        got = re.fullmatch(r"\[([^,\]]+)(?:,([^\]]+))?\]", rest)
        if got:
            at = [labels[name].index(x.strip()) if x.strip() in labels[name] else int(x) - 1 if x.strip().isdigit() else -1 for x in (got[1], got[2] or got[1])]
            if all(0 <= k < sizes[name] for k in at):
                return name, at[0], at[1]
    raise ValueError(f"no component {text!r}")


def _matrices(fit: Fit, theta: np.ndarray) -> dict[str, np.ndarray]:
    m, like = fit.model, fit.likelihood
    out = {e.name: structures.sigma(theta[ss], e.term.struct, e.t, e.term.rank) for e, (ss, _) in zip(m.random, like.slices)}
    for s, sl in zip(m.sections, like.residual):
        if m.structure(s).struct == "none":
            continue
        name = "residual" + (f"({s})" if s is not None else "")
        out[name] = np.array([[math.exp(2 * theta[sl][0])]]) if m.residual.axes else structures.sigma(theta[sl], m.structure(s).struct, len(m.traits), m.structure(s).rank)
    return out


def target_ratios(fit: Fit, targets: list[dict], exposure: dict[str, dict] | None = None, level: float = 0.95, width_max: float = 1.5) -> DataFrame:
    """Variances, shares, heritabilities, total breeding values and correlations of targets with direct and indirect
    effects: target, quantity, component, estimate, se, ci_low, ci_high, flag.

    A target: name, direct, and where they are there indirect_within (a column of the same term), indirect_between (a column
    of another) and other (a list of further components), all as in reference(). exposure, by target: d, k_within,
    k_between, c, s_within, s_between and k_other (by component), 1 where not given. V = d s2 + k_w s2_w + k_b s2_b + others
    is a target's sum of variances and V + 2 c cov its phenotypic variance; h2 and shares are over these. h2_ext adds what
    the indirect effects and the covariance contribute. A total breeding value weighs the term's columns by sqrt(d) and
    sqrt(d) s, and tau2 is its variance over the phenotypic one. Correlations have intervals on Fisher's scale. Flags:
    FLOOR, NOT_ESTIMATED, NOT_IDENTIFIED, COND_BOUND, NOT_ESTIMABLE, OK.
    """
    resolved = []
    for t in targets:
        got = {"name": t["name"], "direct": reference(fit, t["direct"])}
        for part in ("indirect_within", "indirect_between"):
            got[part] = reference(fit, t[part]) if t.get(part) else None
        if got["indirect_within"] and got["indirect_within"][0] != got["direct"][0]:
            raise ValueError(f"{t['name']}: direct and indirect_within are of one term")
        got["other"] = {o: reference(fit, o) for o in t.get("other", [])}
        got["e"] = {k: 1.0 for k in ("d", "k_within", "k_between", "c", "s_within", "s_between")} | (exposure or {}).get(t["name"], {})
        resolved.append(got)
    genetic = list(dict.fromkeys([t["direct"][0] for t in resolved] + [t["indirect_between"][0] for t in resolved if t["indirect_between"]]))
    names = {n: [str(x) for x in fit.model.traits] if len(s) == len(fit.model.traits) > 1 else [str(i + 1) for i in range(len(s))] for n, s in _matrices(fit, fit.theta).items()}

    def quantities(theta: np.ndarray) -> dict[tuple[str, str, str], float]:
        s, q, phenotypic = _matrices(fit, theta), {}, {}
        get = lambda r: float(s[r[0]][r[1], r[2]])
        for t in resolved:
            name, e, d, w, b = t["name"], t["e"], t["direct"], t["indirect_within"], t["indirect_between"]
            direct, within, between = e["d"] * get(d), e["k_within"] * get(w) if w else 0.0, e["k_between"] * get(b) if b else 0.0
            cov = float(s[d[0]][d[1], w[1]]) if w else 0.0
            others = {o: float(e.get("k_other", {}).get(o, 1.0)) * get(r) for o, r in t["other"].items()}
            parts = {"direct": direct} | ({"indirect_within": within} if w else {}) | ({"indirect_between": between} if b else {}) | others
            total = sum(parts.values())
            whole = total + 2 * e["c"] * cov
            phenotypic[name] = whole
            q |= {("var", name, k): v for k, v in parts.items()} | ({("var", name, "cov_direct_indirect"): e["c"] * cov} if w else {})
            q |= {("var", name, "sum"): total, ("var", name, "phenotypic"): whole}
            q |= {("share", name, k): v / total for k, v in parts.items()}
            q |= {("h2", name, "h2"): direct / whole} | ({("h2", name, "h2_indirect_within"): within / whole} if w else {}) | ({("h2", name, "h2_indirect_between"): between / whole} if b else {})
            extended = (direct + 2 * e["c"] * cov + within) / whole
            q |= {("h2", name, "h2_ext_within"): extended, ("h2", name, "h2_ext_total"): extended + between / whole}
            if w:
                both = get(d) * get(w)
                q["h2", name, "r_direct_indirect"] = cov / math.sqrt(both) if both > 0 else math.nan
        for kind, terms in (("cor", genetic), ("rescor", [n for n in s if n.startswith("residual")])):
            for n in terms:
                for i in range(len(s[n])):
                    for j in range(i + 1, len(s[n])):
                        both = s[n][i, i] * s[n][j, j]
                        q[kind, n, f"{names[n][i]}~{names[n][j]}"] = float(s[n][i, j] / math.sqrt(both)) if both > 0 else math.nan
        for n in genetic:
            here = [t for t in resolved if t["direct"][0] == n]
            mean_d = sum(t["e"]["d"] for t in here) / len(here) if here else 1.0
            vectors = {}
            for t in here:
                v = np.zeros(len(s[n]))
                v[t["direct"][1]] = math.sqrt(t["e"]["d"])
                if t["indirect_within"]:
                    v[t["indirect_within"][1]] = math.sqrt(t["e"]["d"]) * t["e"]["s_within"]
                vectors[f"own:{t['name']}"] = (v, t["name"])
            for t in resolved:
                if t["indirect_between"] and t["indirect_between"][0] == n:
                    v = np.zeros(len(s[n]))
                    v[t["indirect_between"][1]] = math.sqrt(mean_d) * t["e"]["s_between"]
                    vectors[f"cross:{t['name']}"] = (v, t["name"])
            listed = list(vectors.items())
            for i, (a, (v, receiver)) in enumerate(listed):
                own = float(v @ s[n] @ v)
                q |= {("tbv_var", n, a): own, ("tau2", n, a): own / phenotypic[receiver]}
                for b, (u, _) in listed[i + 1 :]:
                    cross, other = float(v @ s[n] @ u), float(u @ s[n] @ u)
                    q |= {("tbv_cov", n, f"{a}~{b}"): cross, ("tbv_cor", n, f"{a}~{b}"): cross / math.sqrt(own * other) if own * other > 0 else math.nan}
        return q

    now = quantities(fit.theta)
    keys, jac = list(now), np.zeros((len(now), len(fit.theta)))
    for j in range(len(fit.theta)):
        h = 1e-5 * max(1.0, abs(fit.theta[j]))
        e = np.eye(len(fit.theta))[j] * h
        up, down = quantities(fit.theta + e), quantities(fit.theta - e)
        jac[:, j] = [(up[k] - down[k]) / (2 * h) for k in keys]
    jac = np.nan_to_num(jac)
    cov, flat = fit.curvature()
    se = np.sqrt(np.maximum(0.0, np.einsum("ij,jk,ik->i", jac, cov, jac)))
    share = np.maximum(np.abs(jac).sum(axis=1), 1e-300)
    bound = np.abs(jac[:, fit.at_bound & fit.free]).sum(axis=1) / share
    lost = np.abs(jac[:, (flat**2).sum(axis=1) > 0.5]).sum(axis=1) / share
    z, rows = normal_ppf(0.5 + level / 2), []
    for k, (kind, target, part) in enumerate(keys):
        value = now[kind, target, part]
        lo, hi, flag = value - z * se[k], value + z * se[k], "OK"
        if not math.isfinite(value) or kind == "var" and value == 0:
            flag = "NOT_ESTIMATED"
        elif kind == "var" and part not in ("sum", "phenotypic", "cov_direct_indirect") and bound[k] > 0.5:
            flag = "FLOOR"
        elif lost[k] > 0.5:
            flag = "NOT_IDENTIFIED"
        elif bound[k] > 0.05:
            flag = "COND_BOUND"
        if (kind in ("cor", "rescor", "tbv_cor") or part == "r_direct_indirect") and math.isfinite(value):
            r = min(max(value, -0.999999), 0.999999)
            half = z * se[k] / max(1 - value * value, 1e-8)
            lo, hi = math.tanh(math.atanh(r) - half), math.tanh(math.atanh(r) + half)
            flag = "NOT_ESTIMABLE" if flag == "OK" and hi - lo > width_max else flag
        rows.append((target, kind, part, float(value) if math.isfinite(value) else None, float(se[k]), float(lo) if math.isfinite(lo) else None, float(hi) if math.isfinite(hi) else None, flag))
    return fit.spark.createDataFrame(rows, "target string, quantity string, component string, estimate double, se double, ci_low double, ci_high double, flag string")


def report(fit: Fit) -> str:
    """A fit in words: the model's size, likelihood, components with their errors and standing, fixed effects, diagnostics."""
    d, lines = fit.diagnostics, []
    lines.append(f"{fit.model.n} observations, {fit.rank} fixed columns, {sum(e.t * e.q for e in fit.model.random)} random effects, {int(fit.free.sum())} free parameters")
    lines.append(f"log likelihood {fit.loglik:.4f}, AIC {fit.aic:.2f}, BIC {fit.bic:.2f}, {'converged' if fit.converged else 'NOT converged'}")
    if d:
        lines.append(f"decrement {d['decrement']:.2e}, relative gradient {d['projected_gradient']:.2e}, smallest curvature {d['curvature']:.3g}, {d['n_at_bound']} at a bound")
    lines.append("components:")
    for r in components(fit).collect():
        lines.append(f"  V{r['i']:<3} {r['name']:<32} {r['value']:>12.6g} {'' if r['se'] is None else format(r['se'], '12.4g'):>12} {r['constraint']}")
    lines.append("fixed effects:")
    for r in fit.fixed().collect():
        lines.append(f"  {r['effect']:<37} {r['estimate']:>12.6g} {r['se']:>12.4g}")
    for name, seconds in fit.timings.items():
        lines.append(f"{name}: {seconds:.2f} s")
    return "\n".join(lines)


def gradient_check(fit: Fit) -> float:
    """Largest difference between the fit's gradient and central differences of its value."""
    g = fit.likelihood.value_and_gradient(fit.theta)[1]
    return float(np.abs(g - optimise.gradient(fit.likelihood, fit.theta)).max(initial=0.0))
