"""Structural lag: y_t = sum over traits u of Psi[t, u] W_t y_u + X b + Z u + e, with a likelihood over Psi.

The responses and their lags enter one cross-product pass; any Psi is then a linear map of the sums. The Jacobian
log |det(I - M)|, where M has blocks Psi[t, u] W_t, is summed over blocks of units, where the edges lie.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.functions import optimise
from varispark.functions.special import normal_ppf
from varispark.operators import reml
from varispark.shipping import ship


@dataclass
class Spec:
    """Entries of Psi, receivers in rows and emitters in columns: which are free, and the values of the others."""

    traits: list
    mask: np.ndarray
    value: np.ndarray
    names: list[str] = field(default_factory=list)

    def matrix(self, free: np.ndarray) -> np.ndarray:
        out = np.where(self.mask, 0.0, self.value)
        out[self.mask] = free
        return out

    def nilpotent(self) -> bool:
        """Whether no trait can act on itself through others, so that the Jacobian is zero whatever the units' edges."""
        pattern = (self.mask | (self.value != 0)).astype(float)
        return not np.linalg.matrix_power(pattern, len(pattern)).any()


def spec(traits: list, struct: str = "full", mask: np.ndarray | None = None, emitters: list | None = None, receivers: list | None = None, value: np.ndarray | None = None) -> Spec:
    """struct: full, diag, or mask with the free entries given; only receivers' rows and emitters' columns stay free."""
    q = len(traits)
    free = {"full": np.ones((q, q), dtype=bool), "diag": np.eye(q, dtype=bool), "mask": None if mask is None else np.asarray(mask, dtype=bool)}.get(struct)
    if free is None or free.shape != (q, q):
        raise ValueError("struct is full, diag or mask, and a mask has a row and a column for each trait")
    for names, axis in ((receivers, 0), (emitters, 1)):
        if names is not None:
            if set(names) - set(traits):
                raise ValueError(f"unknown traits {sorted(set(names) - set(traits))}")
            keep = np.isin(np.arange(q), [traits.index(n) for n in names])
            free = free & (keep[:, None] if axis == 0 else keep[None, :])
    fixed = np.zeros((q, q)) if value is None else np.where(free, 0.0, np.asarray(value, dtype=float))
    if not np.isfinite(fixed).all():
        raise ValueError("values of Psi are finite")
    return Spec(list(traits), free, fixed, [f"Psi[{traits[i]}<-{traits[j]}]" for i, j in zip(*np.nonzero(free))])


def log_jacobian(edges: DataFrame, psis: list, max_units: int = 5_000, traits: list | None = None) -> dict:
    """log |det(I - M)| for each psi, a number or a matrix between traits; edges: block, src, dst, w (and trait, the
    receiver, where traits have edges of their own). A block has at most max_units units times traits, since its matrix is
    dense; more are an error. Psi is in the region where each real eigenvalue of M is below one, so that 1 - s M is regular
    for every s between zero and one; beyond it the result is -inf."""
    points = [np.atleast_2d(np.asarray(p, dtype=float)) for p in psis]
    q, own = len(points[0]), "trait" in edges.columns
    names = list(traits) if traits is not None else list(range(q))
    ship(edges.sparkSession)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        units = pd.Index(pd.unique(pd.concat([part["src"], part["dst"]])))
        n = len(units)
        if n * (q if own else 1) > max_units:
            raise ValueError(f"a block has more than {max_units} units")
        w = np.zeros((q if own else 1, n, n))
        receiver = part["trait"].map({t: i for i, t in enumerate(names)}).to_numpy(int) if own else np.zeros(len(part), dtype=int)
        np.add.at(w, (receiver, units.get_indexer(part["src"]), units.get_indexer(part["dst"])), part["w"].to_numpy(float))
        values = None if own else np.linalg.eigvals(w[0])
        out = []
        for p in points:
            if own:
                each = np.linalg.eigvals(np.einsum("tu,tij->tiuj", p, w).reshape(q * n, q * n))
            else:  # the eigenvalues of M are products of those of Psi and W
                each = np.multiply.outer(np.linalg.eigvals(p), values).ravel()
            real = np.abs(each.imag) <= 1e-8 * np.maximum(1.0, np.abs(each))
            inside = bool((each[real].real < 1).all())
            x = float(np.log(np.abs(1 - each)).sum()) if inside else -math.inf
            out.append(x if inside else -math.inf)
        return pd.DataFrame({"k": range(len(points)), "x": out})

    columns = ["block", "src", "dst", "w"] + (["trait"] if own else [])
    sums = edges.select(*columns).groupBy("block").applyInPandas(one, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    found = {r["k"]: r["x"] for r in sums}
    return {_key(p): found.get(k, 0.0) for k, p in enumerate(psis)}


def mean_terms(model: reml.Model, edges: DataFrame, psis: list, max_units: int = 5_000) -> dict:
    """Half of log |Y'Y| - log |X'X| for each psi, where Y = (I - M)^-1 X are the means of the untransformed responses: what
    restricting on these, and not on the transformed ones, changes. Blocks are solved where they lie; their sums are as large
    as the fixed effects. model: of build(), in this session."""
    if model.rows is None or "unit" not in model.spec.get("lag_names", {}):
        raise ValueError("the criterion on the untransformed response takes a model of lag.build(), built in this session")
    unit, names = model.spec["lag_names"]["unit"], model.spec["lag"].traits
    points = [np.atleast_2d(np.asarray(p, dtype=float)) for p in psis]
    q, own = len(points[0]), "trait" in edges.columns
    lags = {e.offset for e in model.fixed if e.name.startswith("__lag")}
    columns = [c for c in range(model.p) if c not in lags]
    place = {c: k for k, c in enumerate(columns)}
    size = len(columns)
    if not size:
        return {k: 0.0 for k in map(_key, psis)}
    ship(edges.sparkSession)
    x = F.filter("coo", lambda e: e["c"].isin(columns))
    members = edges.select("block", F.col("src").alias("u")).unionByName(edges.select("block", F.col("dst").alias("u"))).distinct()
    rows = model.rows.select(F.col(f"__keep_{unit}").alias("u"), F.col("t").cast("int").alias("t"), x["c"].alias("c"), x["x"].alias("x"))
    # Units without an edge keep their means; they are dealt out as blocks of their own.
    lone = F.concat(F.lit("alone "), F.pmod(F.xxhash64("u"), F.lit(64)).cast("string"))
    rows = rows.join(members.withColumn("block", F.concat(F.lit("b "), F.col("block").cast("string"))), "u", "left").withColumn("block", F.coalesce("block", lone))
    sides = edges.select(F.concat(F.lit("b "), F.col("block").cast("string")).alias("block"), "src", "dst", "w", *(["trait"] if own else []))

    def one(part: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((len(points) + 1, size, size))
        if len(part):
            linked = pd.unique(pd.concat([links["src"], links["dst"]]))
            units = pd.Index(linked if len(linked) else pd.unique(part["u"]))
            n = len(units)
            if len(links) and n * q > max_units:
                raise ValueError(f"a block has more than {max_units} units")
            mean = np.zeros((q * n, size))
            at = part["t"].to_numpy() * n + units.get_indexer(part["u"])
            for k, cs, xs in zip(at, part["c"], part["x"]):
                mean[k, [place[c] for c in cs]] += xs
            w = np.zeros((q, n, n)) if len(links) else None
            if len(links):
                i, j, v = units.get_indexer(links["src"]), units.get_indexer(links["dst"]), links["w"].to_numpy(float)
                for t in range(q):
                    mine = (links["trait"] == names[t]).to_numpy() if own else np.ones(len(links), dtype=bool)
                    np.add.at(w[t], (i[mine], j[mine]), v[mine])
            out[-1] = mean.T @ mean
            for k, p in enumerate(points):
                y = mean if w is None else np.linalg.solve(np.eye(q * n) - np.einsum("tu,tij->tiuj", p, w).reshape(q * n, q * n), mean)
                out[k] = y.T @ y
        k, i, j = np.nonzero(out)
        return pd.DataFrame({"k": k, "i": i, "j": j, "x": out[k, i, j]})

    found = rows.groupBy("block").cogroup(sides.groupBy("block")).applyInPandas(one, "k int, i int, j int, x double").groupBy("k", "i", "j").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros((len(points) + 1, size, size))
    total[found["k"], found["i"], found["j"]] = found["x"]
    logs = np.linalg.slogdet(total)[1]
    return {_key(p): float(logs[k] - logs[-1]) / 2 for k, p in enumerate(psis)}


def _key(p):
    return float(p) if np.ndim(p) == 0 else tuple(map(tuple, np.asarray(p, dtype=float).tolist()))


def build(df: DataFrame, unit: str, edges: DataFrame, fixed: str, random: str | None = None, residual: str | None = None, trait: str | None = None, lag: Spec | None = None, **options) -> reml.Model:
    """The model with the lagged responses as further columns, one for each entry of Psi that is free or not zero. Rows are
    units (and traits, in long form), and none may lack a response. edges: block, src, dst, w, with a zero diagonal."""
    response, right = fixed.split("~", 1)
    rows = df.withColumn("__response", F.expr(response).cast("double"))
    if rows.where("__response is null or isnan(__response)").limit(1).count():
        raise ValueError("a lag needs every unit's response")
    if edges.where((F.col("src") == F.col("dst")) & (F.col("w") != 0)).limit(1).count():
        raise ValueError("a unit is not its own neighbour")
    lag = lag or spec([None])
    used = [(i, j) for i in range(len(lag.traits)) for j in range(len(lag.traits)) if lag.mask[i, j] or lag.value[i, j]]
    names = []
    for i, j in used:
        emitted = rows.where(F.col(trait) == F.lit(lag.traits[j])) if trait else rows
        values = emitted.select(F.col(unit).alias("dst"), F.col("__response").alias("__emitted"))
        own = edges.where(F.col("trait") == F.lit(lag.traits[i])) if "trait" in edges.columns else edges
        name = "__lag" if not trait else f"__lag_{i}_{j}"
        lagged = own.join(values, "dst").groupBy(F.col("src").alias("__src")).agg(F.sum(F.col("w") * F.col("__emitted")).alias(name))
        match = F.col(unit) == F.col("__src")
        if trait:
            match = match & (F.col(trait) == F.lit(lag.traits[i]))
        rows = rows.join(lagged, match, "left").drop("__src").na.fill(0.0, [name])
        names.append(name)
    if trait:
        options = {"trait": trait, "unit": unit} | options
    model = reml.build(rows, " + ".join([f"__response ~ {right}", *names]), random, residual, keep=(unit,), **options)
    model.spec["lag"] = lag
    model.spec["lag_names"] = {"unit": unit}
    model.spec["lag_columns"] = used
    return model


def at(model: reml.Model, psi) -> reml.Model:
    """The model of y - M y, without the lags' columns. psi: a number, or the matrix between traits."""
    matrix = np.atleast_2d(np.asarray(psi, dtype=float))
    lags = [e for e in model.fixed if e.name.startswith("__lag")]
    places = [e.offset for e in lags]
    turn = np.eye(model.m + 1)
    for e, (i, j) in zip(lags, model.spec.get("lag_columns", [(0, 0)])):
        turn[e.offset, model.m] = -matrix[i, j]
    turn = np.delete(turn, places, axis=1)
    move = lambda e: replace(e, offset=e.offset - sum(p < e.offset for p in places))

    def turned(g: reml.Sums) -> reml.Sums:
        new = turn.T @ g.dense() @ turn
        i, j = np.nonzero(new)
        return reml.Sums(i, j, new[i, j], turn.shape[1])

    cells = {k: (u, {t: turned(g) for t, g in sums.items()}) for k, (u, sums) in model.cells.items()}
    k = len(places)
    return replace(model, fixed=[move(e) for e in model.fixed if e not in lags], random=[move(e) for e in model.random], cells=cells, p=model.p - k, m=model.m - k, design=None, rows=None)


def fit(model: reml.Model, edges: DataFrame, low: float = -0.9, high: float = 0.9, steps: int = 19, rounds: int = 3, jacobian: bool = True, **options) -> tuple[float, reml.Fit, list[tuple[float, float]]]:
    """For one entry of Psi: psi, the fit at it, and the profile of (psi, -2 log likelihood): a grid that closes in around
    the best point.

    Without jacobian, log |det| is left out, as for lags of nilpotent W (it is zero there). ml=True gives the likelihood.
    """
    profile: dict[float, float] = {}
    best, theta = None, None
    for _ in range(rounds):
        points = [float(p) for p in np.linspace(low, high, steps)]
        det = log_jacobian(edges, points) if jacobian else dict.fromkeys(points, 0.0)
        for p in points:
            if not math.isfinite(det[p]):
                continue
            one = reml.fit(at(model, p), theta=theta, **options)
            theta = one.theta
            value = one.neg2 - 2 * det[p]
            profile[p] = value
            if best is None or value < best[0]:
                best = (value, p, one)
        width = (high - low) / (steps - 1)
        low, high = max(low, best[1] - width), min(high, best[1] + width)
    return best[1], best[2], sorted(profile.items())


@dataclass
class LagFit:
    spec: Spec
    psi: np.ndarray  # the free entries
    se: np.ndarray
    neg2: float
    fit: reml.Fit
    criterion: str

    def report(self, level: float = 0.95) -> DataFrame:
        """entry, estimate, se, ci_low, ci_high of the free entries of Psi."""
        z = normal_ppf(0.5 + level / 2)
        rows = [(n, float(p), float(s), float(p - z * s), float(p + z * s)) for n, p, s in zip(self.spec.names, self.psi, self.se)]
        return self.fit.spark.createDataFrame(rows, "entry string, estimate double, se double, ci_low double, ci_high double")


def fit_psi(model: reml.Model, edges: DataFrame, criterion: str = "jacobian", start: np.ndarray | None = None, rounds: int = 30, tol: float = 1e-6, **options) -> LagFit:
    """All free entries of Psi together, by quasi-Newton steps on the profile over the variances.

    criterion: "jacobian" for the restricted likelihood of y - M y and log |det(I - M)|, "ml" for the likelihood with both,
    "reml_y" for the restricted likelihood of y itself, whose means are (I - M)^-1 X b.
    The profile's derivatives are central differences, whose points share one Jacobian job. An acyclic Psi has none.
    """
    if criterion not in ("jacobian", "ml", "reml_y"):
        raise ValueError("criterion is 'jacobian', 'ml' or 'reml_y'")
    lag: Spec = model.spec["lag"]
    k, state = int(lag.mask.sum()), {"theta": None}
    acyclic = lag.nilpotent()

    def values(points: list[np.ndarray]) -> list[tuple[float, reml.Fit | None]]:
        matrices = [lag.matrix(p) for p in points]
        det = [0.0] * len(points) if acyclic else list(log_jacobian(edges, matrices, traits=lag.traits).values())
        means = list(mean_terms(model, edges, [m for m, d in zip(matrices, det) if math.isfinite(d)]).values()) if criterion == "reml_y" and any(map(math.isfinite, det)) else []
        means = iter(means)
        out = []
        for m, d in zip(matrices, det):
            if math.isfinite(d) and criterion == "reml_y":
                d += next(means)
            if not math.isfinite(d):
                out.append((math.inf, None))
                continue
            one = reml.fit(at(model, m), theta=state["theta"], ml=criterion == "ml", **options)
            state["theta"] = one.theta
            out.append((one.neg2 - 2 * d, one))
        return out

    h = 1e-3

    def with_gradient(x: np.ndarray) -> tuple[float, np.ndarray]:
        eye = np.eye(k) * h
        got = [v for v, _ in values([x, *[x + e for e in eye], *[x - e for e in eye]])]
        return got[0], np.array([(a - b) / (2 * h) if math.isfinite(a) and math.isfinite(b) else 0.0 for a, b in zip(got[1 : k + 1], got[k + 1 :])])

    x = np.zeros(k) if start is None else np.asarray(start, dtype=float)
    best, value, _ = optimise.minimise(with_gradient, x, low=-5.0, high=5.0, rounds=rounds, tol=tol)
    hess = optimise.hessian(lambda p: with_gradient(p)[1], best, h=10 * h, low=-5.0, high=5.0)
    size, vectors = np.linalg.eigh(hess)
    se = np.sqrt(np.maximum(0.0, 2 * ((vectors**2) / np.maximum(size, 1e-12)).sum(axis=1))) if k else np.zeros(0)
    return LagFit(lag, best, se, value, values([best])[0][1], criterion)


def weakly_identified(lag: Spec) -> list[str]:
    """Pairs of traits with both directions free: beside a random term whose incidence is the edges themselves, who acts on
    whom is then identified only weakly."""
    t = lag.traits
    return [f"{t[i]}/{t[j]}" for i in range(len(t)) for j in range(i) if lag.mask[i, j] and lag.mask[j, i]]
