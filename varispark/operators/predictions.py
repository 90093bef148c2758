"""Predictions from a fit: marginal means over a grid of factors, with random parts, their errors and differences."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame

from varispark.operators import inference
from varispark.operators.reml import Fit


def design_row(fit: Fit, values: dict) -> np.ndarray:
    """Row of the fixed design at values of its columns, over all effects; columns of surfaces count as zero, where they
    average the surface."""
    m, row = fit.model, np.zeros(fit.model.m)
    for e in m.fixed:
        if e.name == "(empty cells)":
            continue
        code, x = 0, 1.0
        for name, levels in e.columns or []:
            if not levels:
                x *= float(values.get(name, 0.0))
            elif values[name] in levels:
                code = code * len(levels) + levels.index(values[name])
            else:
                x = 0.0
        if x:
            row[e.offset + code] = x
    return row


def grid(fit: Fit, classify: list[str], levels: dict | None = None, at: dict | None = None, average: str = "equal", weights: dict | None = None, random: bool = True, most: int = 100_000) -> tuple[list[tuple], np.ndarray]:
    """The classified cells and their rows over all effects.

    Factors of the fixed formula that aren't classified are averaged over all their levels: equally, by how often their
    levels occur together (average = "proportional"), and each averaged combination's weight may be given (weights, by the
    tuple of its levels in the order of the formula). Numbers are at their means unless classified (then at levels[name])
    or given in at. A classified name may be a plain random term of one trait: its level's effect is added if random.
    """
    m, spec = fit.model, fit.model.spec
    factors = list(spec["levels"])
    numbers = sorted({c for t in spec["fixed"] for c in t if c not in factors and not any(c in names for *_, names in spec.get("surfaces", {}).values())})
    terms = {e.term.factors[0]: e for e in m.random if e.absorbed is None and e.t == 1 and len(e.term.factors) == 1 and e.term.level in ("id", "fixed") and "parts" not in e.term.options}
    unknown = [c for c in classify if c not in factors and c not in numbers and c not in terms]
    if unknown:
        raise ValueError(f"{', '.join(unknown)}: neither in the fixed formula nor a random term of one trait")
    if average not in ("equal", "proportional"):
        raise ValueError("average is 'equal' or 'proportional'")
    levels, at = levels or {}, at or {}
    free = [c for c in numbers if c not in at and c not in classify]
    lag = [c for c in free if c.startswith("__lag")]
    if lag:
        raise ValueError("no predictions of models with a lag")
    data = m.source.na.drop(subset=[*factors, *numbers]) if factors or numbers else m.source
    from pyspark.sql import functions as F

    means = data.agg(*[F.avg(c).alias(c) for c in free]).first().asDict() if free else {}
    values: dict[str, list] = {}
    for c in classify:
        every = spec["levels"].get(c) or (terms[c].labels if c in terms else None)
        if c in levels:
            values[c] = list(levels[c])
        elif c in at:
            values[c] = list(at[c]) if isinstance(at[c], (list, tuple)) else [at[c]]
        elif every is not None:
            values[c] = list(every)
        else:
            raise ValueError(f"levels of the number {c} are not given")
        if every is not None and (wrong := [v for v in values[c] if v not in every]):
            raise ValueError(f"{c} has no level {wrong[0]!r}")
    averaged = [c for c in factors if c not in classify]
    inner = [list(levels.get(c, spec["levels"][c])) for c in averaged]
    combos = list(itertools.product(*inner))
    cells = list(itertools.product(*[values[c] for c in classify]))
    if len(combos) * len(cells) > most:
        raise ValueError(f"the grid has more than {most} points")
    share = np.ones(len(combos))
    if average == "proportional" and averaged:
        seen = {tuple(r[c] for c in averaged): r["count"] for r in data.groupBy(*averaged).count().collect()}  # combinations of levels
        share = np.array([float(seen.get(c, 0)) for c in combos])
    if weights is not None:
        share = share * np.array([float(weights.get(c, weights.get(c[0], 0.0) if len(c) == 1 else 0.0)) for c in combos])
    if share.sum() <= 0:
        raise ValueError("all weights are zero")
    share = share / share.sum()
    rows = np.zeros((len(cells), m.m))
    for k, cell in enumerate(cells):
        fixed = {**means, **{c: v for c, v in at.items() if not isinstance(v, (list, tuple))}, **dict(zip(classify, cell))}
        for combo, w in zip(combos, share):
            if w:
                rows[k] += w * design_row(fit, {**fixed, **dict(zip(averaged, combo))})
        for c, v in zip(classify, cell):
            if random and c in terms:
                rows[k, terms[c].offset + terms[c].labels.index(v)] = 1.0
    return cells, rows


def predict(fit: Fit, classify: str, levels: dict | None = None, at: dict | None = None, average: str = "equal", weights: dict | None = None, random: bool = True, vcov: str = "simple") -> DataFrame:
    """A row for each classified cell (classify = "trt:gid"): its levels, predicted, se and estimable; null where a cell
    isn't estimable. vcov = "kenward-roger" adjusts the errors of the fixed part, for predictions without a random one."""
    names = [c.strip() for c in classify.replace("+", ":").split(":") if c.strip()]
    cells, rows = grid(fit, names, levels, at, average, weights, random)
    p = fit.model.p
    if vcov == "kenward-roger":
        if np.abs(rows[:, p:]).sum():
            raise ValueError("the adjustment is one of fixed effects: predict with random=False")
        cov = rows[:, :p] @ inference.kenward_roger_covariance(fit) @ rows[:, :p].T
    elif vcov == "simple":
        cov = rows @ fit.cinv @ rows.T
    else:
        raise ValueError("vcov is 'simple' or 'kenward-roger'")
    ok = [inference.estimable(fit, r) for r in rows]
    kinds = []
    for k, c in enumerate(names):
        first = cells[0][k] if cells else ""
        kinds.append(f"`{c}` " + ("string" if isinstance(first, str) else "boolean" if isinstance(first, bool) else "long" if isinstance(first, (int, np.integer)) else "double"))
    out = [(*cell, float(r @ fit.estimates) if good else None, math.sqrt(max(0.0, cov[k, k])) if good else None, good) for k, (cell, r, good) in enumerate(zip(cells, rows, ok))]
    return fit.spark.createDataFrame(out, ", ".join([*kinds, "predicted double", "se double", "estimable boolean"]))


def differences(fit: Fit, classify: str, **options) -> tuple[DataFrame, float]:
    """Differences of all pairs of the predictions (a, b, difference, sed), and the root mean square of their errors."""
    names = [c.strip() for c in classify.replace("+", ":").split(":") if c.strip()]
    cells, rows = grid(fit, names, **options)
    cov = rows @ fit.cinv @ rows.T
    i, j = np.triu_indices(len(rows), 1)
    square = np.maximum(0.0, cov[i, i] + cov[j, j] - 2 * cov[i, j])
    value = rows @ fit.estimates
    label = [":".join(map(str, c)) for c in cells]
    out = [(label[a], label[b], float(value[a] - value[b]), float(s)) for a, b, s in zip(i, j, np.sqrt(square))]
    return fit.spark.createDataFrame(out, "a string, b string, difference double, sed double"), float(np.sqrt(square.mean())) if len(square) else math.nan
