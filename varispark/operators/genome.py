"""Genome scans on a fitted model: loci are tested in the dimension of the levels, one pass over the markers.

With P the projection of the fit, a term's incidence Z gives c = Z'Py and C = Z'PZ once, on the driver, from the mixed-model
equations. A locus with doses s then has score s'c and information s'Cs; several terms (own genotype, neighbours) are
tested one by one and jointly, and by trait. Products of two terms' doses need sums over pairs of levels, which one more
pass over the rows gives. Markers are tested in batches where they lie, and exact refits take their columns from the sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.functions.special import chi2_sf
from varispark.operators import products, refits, reml
from varispark.operators.reml import Effects, Fit, Model, Sums
from varispark.plans.hypotheses import FAMILIES, parse_test, parts as parts_of
from varispark.shipping import ship

PAIR_TESTS = ("pair", "pair|dir", "pair|ind", "pair|dir+ind")


def blocks(model: Model, term: str) -> list[slice]:
    """The columns of a term, for each trait."""
    e = next((e for e in model.random if e.name == term), None)
    if e is None or e.absorbed is not None:
        raise ValueError(f"no term {term!r} in the equations (terms: {', '.join(e.name for e in model.random)})")
    if e.t not in (1, len(model.traits)) or e.t == 1 and len(model.traits) > 1:
        raise ValueError(f"{term!r} has no column for each trait")
    return [slice(e.offset + k * e.q, e.offset + (k + 1) * e.q) for k in range(e.t)]


def project(fit: Fit, terms: list[str]) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """c of each column block (term by term, traits within) and C of each pair of blocks."""
    m = fit.model
    full, _ = fit.likelihood.reduced(fit.theta)
    at = [k for t in terms for k in blocks(m, t)]
    c = [full[k, m.m] - full[k, : m.m] @ fit.solution for k in at]
    big = [[full[k, j] - full[k, : m.m] @ fit.cinv @ full[: m.m, j] for j in at] for k in at]
    return c, big


def scan(fit: Fit, markers: DataFrame, terms: list[str], dose: str = "dose", snp: str = "snp") -> DataFrame:
    """snp, and for each term beta_k, se_k, chi2_k; with several terms also chi2_joint and p_joint, for models of one trait.

    markers: one row per locus, with an array of doses in the order of the terms' levels. Loci without variation have nulls.
    """
    if len(fit.model.traits) > 1:
        raise ValueError("models of several traits take scan_tests()")
    ship(markers.sparkSession)
    c, big = project(fit, terms)
    q = len(c[0])
    if any(len(x) != q for x in c):
        raise ValueError("the terms of one scan have the same levels")
    k = len(terms)
    names = [f"{x}_{t + 1}" for t in range(k) for x in ("beta", "se", "chi2")] + (["chi2_joint", "p_joint"] if k > 1 else [])
    held = markers.sparkSession.sparkContext.broadcast((c, big))  # as large as the terms' part of the equations

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, big = held.value
        for pdf in frames:
            s = np.stack(pdf[dose].to_numpy()).astype(float) if len(pdf) else np.zeros((0, q))
            num = np.stack([s @ x for x in c], axis=1)
            den = np.stack([np.stack([((s @ big[a][b]) * s).sum(axis=1) for b in range(k)], axis=1) for a in range(k)], axis=1)
            out = {snp: pdf[snp]}
            for t in range(k):
                d = np.where(den[:, t, t] > 1e-10, den[:, t, t], np.nan)
                out |= {f"beta_{t + 1}": num[:, t] / d, f"se_{t + 1}": 1 / np.sqrt(d), f"chi2_{t + 1}": num[:, t] ** 2 / d}
            if k > 1:
                ok = np.linalg.cond(den) < 1e10 if len(den) else np.zeros(0, dtype=bool)
                joint = np.full(len(s), np.nan)
                joint[ok] = np.einsum("ij,ij->i", num[ok], np.linalg.solve(den[ok], num[ok][:, :, None])[:, :, 0])
                out |= {"chi2_joint": joint, "p_joint": [chi2_sf(x, k) if np.isfinite(x) else np.nan for x in joint]}
            yield pd.DataFrame(out)

    kind = markers.schema[snp].dataType.simpleString()
    found = markers.select(snp, dose).mapInPandas(run, f"{snp} {kind}, " + ", ".join(f"{n} double" for n in names))
    return found.select(snp, *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


def solved(num: np.ndarray, den: np.ndarray, hypothesis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each locus L b, its standard errors, chi-square and degrees of freedom, from scores and information; not a
    number where a column has no information of its own."""
    n, r = len(num), len(hypothesis)
    value, se, chi2 = np.full((n, r), np.nan), np.full((n, r), np.nan), np.full(n, np.nan)
    diagonal = np.einsum("nii->ni", den)
    ok = (diagonal > 1e-10).all(axis=1) & np.isfinite(den).all(axis=(1, 2))
    if ok.any():
        scale = np.sqrt(diagonal[ok])
        ok[ok] = np.linalg.cond(den[ok] / (scale[:, :, None] * scale[:, None, :])) < 1e10
    if ok.any():
        inv = np.linalg.inv(den[ok])
        b = np.einsum("nij,nj->ni", inv, num[ok])
        lb, v = b @ hypothesis.T, np.einsum("ri,nij,sj->nrs", hypothesis, inv, hypothesis)
        value[ok], se[ok] = lb, np.sqrt(np.einsum("nrr->nr", v))
        chi2[ok] = np.einsum("nr,nr->n", lb, np.linalg.solve(v, lb[:, :, None])[:, :, 0])
    return value, se, chi2, np.full(n, r)


@dataclass
class Projection:
    """What tests of linear families need of a fit: c and C of each family and trait, in this order."""

    families: list[str]
    traits: list[str]
    c: list[np.ndarray]
    big: list[list[np.ndarray]]


def projection(fit: Fit, families: dict[str, str]) -> Projection:
    linear = [f for f in ("dir", "ind") if f in families]
    return Projection(linear, [str(t) for t in fit.model.traits] if len(fit.model.traits) > 1 else [""], *project(fit, [families[f] for f in linear]))


def save_projection(fit: Fit, families: dict[str, str], path: str) -> None:
    """The projection as tables, so that markers are scanned without the fit: arrays by place, and a description in JSON."""
    import json

    spark, p = fit.spark, projection(fit, families)
    rows = [(a, -1, i, 0, float(x)) for a, v in enumerate(p.c) for i, x in enumerate(v)]
    rows += [(a, b, int(i), int(j), float(m[i, j])) for a, line in enumerate(p.big) for b, m in enumerate(line) for i, j in zip(*np.nonzero(m))]
    spark.createDataFrame(rows, "a int, b int, i int, j int, x double").write.mode("overwrite").parquet(f"{path}/projection")
    meta = {"families": p.families, "traits": p.traits, "q": len(p.c[0]), "theta": fit.theta.tolist()}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_projection(spark, path: str) -> Projection:
    import json

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    table, q, k = spark.read.parquet(f"{path}/projection").toPandas(), meta["q"], len(meta["families"]) * len(meta["traits"])
    c, big = [np.zeros(q) for _ in range(k)], [[np.zeros((q, q)) for _ in range(k)] for _ in range(k)]
    for (a, b), part in table.groupby(["a", "b"]):
        if b < 0:
            c[a][part["i"].to_numpy()] = part["x"].to_numpy()
        else:
            big[a][b][part["i"].to_numpy(), part["j"].to_numpy()] = part["x"].to_numpy()
    return Projection(meta["families"], meta["traits"], c, big)


def scan_tests(fit: Fit | Projection, markers: DataFrame, families: dict[str, str], tests: list[str], maf: float | None = None, keep: str | None = None, coding: str = "count", ploidy: int = 2) -> DataFrame:
    """A scan with the test grammar of parse_test: snp and maf; for each test k chi2_k, df_k and p_k, and for each of its
    rows j beta_k_j and se_k_j.

    fit: a fit, or a projection that was saved. families: the terms of dir (own doses) and ind (others' doses). The family sim is the product of a row's own dose and
    the sum of its neighbours', for each trait; it takes doses that are centred, and its sums over rows are those of products.py.
    markers: snp, dose (array in the order of the levels), and keep, a boolean
    column, if named: loci that it leaves out, rare and constant ones are there with nulls.
    """
    ship(markers.sparkSession)
    traits = fit.traits if isinstance(fit, Projection) else [str(t) for t in fit.model.traits] if len(fit.model.traits) > 1 else [""]
    parsed = [parse_test(t, traits) for t in tests]
    used = sorted({key for columns, _, _ in parsed for c in columns for key in c}, key=lambda f: (FAMILIES.index(f[0]), f[1]))
    needs_sim = any(f == "sim" for f, _ in used)
    linear = [f for f in ("dir", "ind") if any(u[0] == f for u in used) or needs_sim]
    own = fit if isinstance(fit, Projection) else projection(fit, {f: families[f] for f in linear if f in families})
    missing = [f for f in linear if f not in own.families]
    if missing or needs_sim and isinstance(fit, Projection):
        raise ValueError(f"no term for {', '.join(missing) or 'sim'}")
    c, big = own.c, own.big
    place = {(f, k): i * len(traits) + k for i, f in enumerate(own.families) for k in range(len(traits))}
    q = {len(x) for x in c}
    if len(q) > 1:
        raise ValueError("the families of one scan have the same levels")
    if needs_sim and coding == "count":
        raise ValueError("sim takes centred doses: coding is 'sign' or 'centred'")
    t = len(traits)
    rows = markers.select("snp", "dose", *([F.col(keep).alias("keep")] if keep else []))
    if needs_sim:
        rows = rows.join(products.products(fit, markers.select("snp", "dose"), products.design_of(fit, families)), "snp")
    held = markers.sparkSession.sparkContext.broadcast((c, big))  # as large as the equations
    names = [n for k, (_, _, labels) in enumerate(parsed) for n in (f"chi2_{k + 1}", f"df_{k + 1}", f"p_{k + 1}", *[f"{x}_{k + 1}_{j + 1}" for j in range(len(labels)) for x in ("beta", "se")])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, big = held.value
        for pdf in frames:
            s = np.stack(pdf["dose"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, len(c[0])))
            share = {"count": s / ploidy, "fraction": s, "sign": (s + 1) / 2, "centred": s - s.min(axis=1, keepdims=True)}[coding].mean(axis=1) if len(s) else np.zeros(0)
            rare = np.minimum(share, 1 - share) if coding != "centred" else np.full(len(s), np.nan)
            live = (s.max(axis=1) > s.min(axis=1)) if len(s) else np.zeros(0, dtype=bool)
            if maf is not None and coding != "centred":
                live &= rare >= maf
            if keep:
                live &= pdf["keep"].fillna(False).to_numpy(dtype=bool)
            x = s[live]
            num = {key: x @ c[place[key]] for key in used if key[0] != "sim"}
            den = {(a, b): ((x @ big[place[a]][place[b]]) * x).sum(axis=1) for a in used for b in used if "sim" not in (a[0], b[0])}
            if needs_sim:
                of = lambda name, size: np.stack(pdf[name].to_numpy())[live] if live.any() else np.zeros((0, size))
                own, inner, cross = of("num", t), of("den", t * t).reshape(-1, t, t), of("cross", 2 * t * t).reshape(-1, 2, t, t)
                for k in range(t):
                    num["sim", k] = own[:, k]
                    for j in range(t):
                        den[("sim", k), ("sim", j)] = inner[:, k, j]
                        for i, f in enumerate(("dir", "ind")):
                            den[(f, j), ("sim", k)] = den[("sim", k), (f, j)] = cross[:, i, j, k]
            out = {"snp": pdf["snp"], "maf": rare}
            for k, (columns, hypothesis, labels) in enumerate(parsed):
                score = np.stack([sum(w * num[key] for key, w in col.items()) for col in columns], axis=1)
                information = np.stack([np.stack([sum(w * v * den[a, b] for a, w in left.items() for b, v in right.items()) for right in columns], axis=1) for left in columns], axis=1)
                value, se, chi2, df = solved(score, information, hypothesis)
                whole = np.full((len(s), 2 + 2 * len(labels)), np.nan)
                whole[live, 0] = chi2
                whole[live, 1] = [chi2_sf(v, len(hypothesis)) if np.isfinite(v) else np.nan for v in chi2]
                whole[live, 2::2], whole[live, 3::2] = value, se
                out |= {f"chi2_{k + 1}": whole[:, 0], f"df_{k + 1}": float(len(hypothesis)), f"p_{k + 1}": whole[:, 1]}
                for j in range(len(labels)):
                    out |= {f"beta_{k + 1}_{j + 1}": whole[:, 2 + 2 * j], f"se_{k + 1}_{j + 1}": whole[:, 3 + 2 * j]}
            yield pd.DataFrame(out)

    kind = markers.schema["snp"].dataType.simpleString()
    found = rows.mapInPandas(run, f"snp {kind}, maf double, " + ", ".join(f"{n} double" for n in names))
    return found.select("snp", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in ["maf", *names]])


def scan_loco(null_without: Callable[[object], Fit], markers: DataFrame, terms: list[str], chrom: str = "chr", **options) -> DataFrame:
    """A scan in which each chromosome's loci are tested on the null fit made without it; chromosomes are few."""
    parts = [scan(null_without(r[0]), markers.where(F.col(chrom) == F.lit(r[0])), terms, **options) for r in markers.select(chrom).distinct().orderBy(chrom).collect()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_columns(model: Model, columns: np.ndarray, names: list[str]) -> Model:
    """The model with further fixed effects that are combinations of its columns (one column of weights each): a locus is
    one of its term's, so its sums follow from those that are there."""
    k, p = columns.shape[1], model.p
    turn = np.zeros((model.m + 1, model.m + 1 + k))
    turn[:p, :p] = np.eye(p)
    turn[: model.m, p : p + k] = columns
    turn[p:, p + k :] = np.eye(model.m + 1 - p)

    def turned(g: Sums) -> Sums:
        new = turn.T @ (g.dense() @ turn)
        i, j = np.nonzero(new)
        return Sums(i, j, new[i, j], model.m + 1 + k)

    cells = {key: (units, {t: turned(g) for t, g in sums.items()}) for key, (units, sums) in model.cells.items()}
    fixed = [*model.fixed, *[Effects(n, p + i, [n]) for i, n in enumerate(names)]]
    return replace(model, fixed=fixed, random=[replace(e, offset=e.offset + k) for e in model.random], cells=cells, p=p + k, m=model.m + k, design=None, rows=None)


def refit(fit: Fit, markers: DataFrame, families: dict[str, str], test: str) -> DataFrame:
    """Exact refits: variances estimated anew with each locus as a fixed effect, and its Wald test: snp, chi2, df, p, neg2,
    converged, and theta; labels' beta_j and se_j.

    A locus is a row and is refitted where it lies, from the sums of the null fit: loci by batches whose equations are
    stacked (refits.py), those that don't converge there, or whose model it doesn't take, by a fit each. markers: the loci to refit, as for
    scan_tests; families are dir and ind.
    """
    m = fit.model
    if m.absorbed:
        raise ValueError("refits take models without an absorbed factor")
    ship(markers.sparkSession)
    traits = [str(t) for t in m.traits] if len(m.traits) > 1 else [""]
    columns, hypothesis, labels = parse_test(test, traits)
    if any(f == "sim" for c in columns for f, _ in c):
        raise ValueError("refits take dir and ind")
    at = {(f, k): b for f, t in families.items() for k, b in enumerate(blocks(m, t))}
    held = markers.sparkSession.sparkContext.broadcast((replace(m, source=None, design=None, rows=None, coder=None, spec={}), fit.theta, fit.free, fit.likelihood.ml))

    names = ["snp", "chi2", "p", "df", "neg2", "converged", "theta", *[f"{x}_{j + 1}" for j in range(len(labels)) for x in ("beta", "se")]]

    def tested(snp, value: float, done: bool, best: np.ndarray, effects: np.ndarray, v: np.ndarray) -> tuple:
        lb, lv = hypothesis @ effects, hypothesis @ v @ hypothesis.T
        chi2 = float(lb @ np.linalg.solve(lv, lb))
        return (snp, chi2, chi2_sf(chi2, len(hypothesis)), float(len(hypothesis)), value, bool(done), best.tolist(), *[x for pair in zip(lb, np.sqrt(np.diag(lv))) for x in pair])

    def alone(null: Model, snp, weights: np.ndarray, theta: np.ndarray, free: np.ndarray, ml: bool) -> tuple:
        """One locus, by a fit of its own."""
        try:
            model = reml._checked(with_columns(null, weights, [f"__locus{j}" for j in range(len(columns))]))
        except ValueError:
            return (snp, *[float("nan")] * 2, float(len(hypothesis)), float("nan"), False, theta.tolist(), *[float("nan")] * (2 * len(labels)))
        one = reml.fit(model, theta=theta, fixed_theta=np.where(free, np.nan, theta), ml=ml)
        place = slice(null.p, null.p + len(columns))
        return tested(snp, one.neg2, one.converged, one.theta, one.solution[place], one.cinv[place, place])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        null, theta, free, ml = held.value
        like = reml.Likelihood(null, ml)
        together = refits.takes(null) and not ml
        step = max(1, refits.BATCH // (6 * (null.m + 1) ** 2))
        for whole in frames:
            for lo in range(0, len(whole), step):
                pdf, out = whole.iloc[lo : lo + step], []
                weights = np.zeros((len(pdf), null.m, len(columns)))
                for i, dose in enumerate(pdf["dose"]):
                    for j, col in enumerate(columns):
                        for key, w in col.items():
                            weights[i, at[key], j] += w * np.asarray(dose, dtype=float)
                results = {}
                if together:
                    alive = refits.independent(null, weights)
                    if alive.any():
                        found = refits.fit(like, theta, free, weights[alive])
                        results = {i: r for i, *r in zip(np.nonzero(alive)[0], *found) if r[2]}
                for i, snp in enumerate(pdf["snp"]):
                    if i in results:
                        best, value, done, effects, v = results[i]
                        out.append(tested(snp, float(value), done, best, effects, v))
                    else:
                        out.append(alone(null, snp, weights[i], theta, free, ml))
                yield pd.DataFrame(out, columns=names)

    kind = markers.schema["snp"].dataType.simpleString()
    more = "".join(f", {x}_{j + 1} double" for j in range(len(labels)) for x in ("beta", "se"))
    return markers.select("snp", "dose").mapInPandas(run, f"snp {kind}, chi2 double, p double, df double, neg2 double, converged boolean, theta array<double>{more}")


def pair_sums(fit: Fit, terms: tuple[str, str], limit: int = 4_000) -> dict[str, np.ndarray]:
    """What tests of a product of two terms' doses need, from one pass over the rows: for pairs of levels (g of the first,
    f of the second) the sums n = R'Py, R'PZ with each term, and R'PR, where R has a column for each pair.

    The pairs number limit at most, as R'PR is held on the driver.
    """
    m = fit.model
    if len(m.traits) > 1 or len(m.sections) > 1 or m.residual.axes or m.absorbed or m.design is None:
        raise ValueError("pairs take models of one trait and one plain residual, built in this session")
    (a,), (b,) = (blocks(m, t) for t in terms)
    qa, qb = a.stop - a.start, b.stop - b.start
    if qa * qb > limit:
        raise ValueError(f"{qa * qb} pairs of levels are more than {limit}")
    inside = lambda k: F.filter("coo", lambda e: (e["c"] >= k.start) & (e["c"] < k.stop))
    pairs = F.flatten(F.transform(inside(a), lambda x: F.transform(inside(b), lambda y: F.struct(((x["c"] - a.start) * qb + y["c"] - b.start + m.m + 1).alias("c"), (x["x"] * y["x"]).alias("x")))))
    rows = m.design.select("coo", pairs.alias("r"))
    every = F.flatten(F.transform("r", lambda x: F.transform(F.concat("coo", "r"), lambda y: F.struct(x["c"].alias("i"), y["c"].alias("j"), (x["x"] * y["x"]).alias("x")))))
    sums = rows.select(F.inline(every)).groupBy("i", "j").agg(F.sum("x").alias("x"))
    full = np.zeros((qa * qb, m.m + 1 + qa * qb))
    got = sums.toPandas()
    full[got["i"].to_numpy() - m.m - 1, got["j"].to_numpy()] = got["x"].to_numpy()
    full /= np.exp(2 * fit.theta[fit.likelihood.residual[0]][0])
    rw, ry, rr = full[:, : m.m], full[:, m.m], full[:, m.m + 1 :]
    c, big = project(fit, list(terms))
    base, _ = fit.likelihood.reduced(fit.theta)
    through = rw @ fit.cinv
    return {
        "num": ry - rw @ fit.solution, "dir": rw[:, a] - through @ base[: m.m, a], "ind": rw[:, b] - through @ base[: m.m, b], "own": rr - through @ rw.T,
        "c_dir": c[0], "c_ind": c[1], "dd": big[0][0], "nn": big[1][1], "dn": big[0][1],
    }


def _pair_tests(k: dict, left: np.ndarray, right: np.ndarray, tests: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """chi2, beta and standard error of the product's effect for each left and right locus, given the effects named."""
    na, nb, qa, qb = len(left), len(right), left.shape[1], right.shape[1]
    products = (left[:, None, :, None] * right[None, :, None, :]).reshape(na * nb, qa * qb)
    num, den = (products @ k["num"]).reshape(na, nb), ((products @ k["own"]) * products).sum(axis=1).reshape(na, nb)
    with_dir = ((products @ k["dir"]).reshape(na, nb, qa) * left[:, None, :]).sum(axis=2)
    with_ind = ((products @ k["ind"]).reshape(na, nb, qb) * right[None, :, :]).sum(axis=2)
    own = {"dir": (left @ k["c_dir"])[:, None] + np.zeros((1, nb)), "ind": (right @ k["c_ind"])[None, :] + np.zeros((na, 1))}
    info = {("dir", "dir"): ((left @ k["dd"]) * left).sum(axis=1)[:, None] + np.zeros((1, nb)), ("ind", "ind"): ((right @ k["nn"]) * right).sum(axis=1)[None, :] + np.zeros((na, 1)), ("dir", "ind"): left @ k["dn"] @ right.T}
    info["ind", "dir"] = info["dir", "ind"]
    cross = {"dir": with_dir, "ind": with_ind}
    out = {}
    for test in tests:
        given = test.split("|")[1].split("+") if "|" in test else []
        r_num, r_den = num, den
        if given:  # what the product has beyond them
            small = np.stack([np.stack([info[x, y] for y in given], axis=-1) for x in given], axis=-2)
            v = np.stack([cross[x] for x in given], axis=-1)
            ok = np.abs(np.linalg.det(small)) > 1e-12
            weights = np.full(v.shape, np.nan)
            weights[ok] = np.linalg.solve(small[ok], v[ok][..., None])[..., 0]
            r_num = num - (weights * np.stack([own[x] for x in given], axis=-1)).sum(axis=-1)
            r_den = den - (weights * v).sum(axis=-1)
        with np.errstate(invalid="ignore", divide="ignore"):
            good = r_den > 1e-9 * np.maximum(den, 1e-300)
            out[test] = tuple(np.where(good, x, np.nan) for x in (r_num**2 / r_den, r_num / r_den, 1 / np.sqrt(np.maximum(r_den, 1e-300))))
    return out


def cogwas(fit: Fit, focal: DataFrame, neighbour: DataFrame, terms: tuple[str, str], tests: list[str] = list(PAIR_TESTS), block: int = 64, top: int = 100, width: float = 0.5) -> dict[str, DataFrame]:
    """Tests of every focal locus with every neighbour locus: top (test, focal, neighbour, chi2, beta, se), best (per test
    and locus of each side: side, snp, other, chi2), histogram (test, bin, n) and meta (test, n, lambda of the histogram).

    Loci of both sides are dealt into blocks of about so many, and each pair of blocks is a tile of matrix products that
    keeps its best pairs only; what tiles return grows with loci, not with pairs. Ties go to the smaller loci.
    """
    unknown = set(tests) - set(PAIR_TESTS)
    if unknown:
        raise ValueError(f"unknown tests {sorted(unknown)} (known: {', '.join(PAIR_TESTS)})")
    spark = fit.spark
    ship(spark)
    held = spark.sparkContext.broadcast(pair_sums(fit, terms))  # at most the square of pair_sums' limit
    deal = lambda df, n, name: df.select(F.col("snp").cast("long").alias("snp"), "dose", F.pmod(F.xxhash64("snp"), F.lit(n)).alias(name))
    n_a, n_b = (max(1, -(-df.count() // block)) for df in (focal, neighbour))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a, b = deal(focal, n_a, "a").withColumn("b", every(n_b)), deal(neighbour, n_b, "b").withColumn("a", every(n_a))

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(left) and len(right):
            left, right = left.sort_values("snp"), right.sort_values("snp")
            sides = left["snp"].to_numpy(), right["snp"].to_numpy()
            found = _pair_tests(held.value, *(np.stack(x["dose"].to_numpy()).astype(float) for x in (left, right)), tests)
            for test, (chi2, beta, se) in found.items():
                flat = np.where(np.isfinite(chi2), chi2, -1.0).ravel()
                for k in np.argsort(-flat, kind="stable")[:top]:
                    if flat[k] >= 0:
                        i, j = divmod(int(k), len(right))
                        rows.append(("top", test, int(sides[0][i]), int(sides[1][j]), float(flat[k]), float(beta[i, j]), float(se[i, j]), 1))
                for side, axis in (("focal", 1), ("neighbour", 0)):
                    grid = flat.reshape(chi2.shape)
                    for i, j in enumerate(grid.argmax(axis=axis)):
                        value = grid[i, j] if axis else grid[j, i]
                        if value >= 0:
                            rows.append((side, test, int(sides[1 - axis][i]), int(sides[axis][j]), float(value), 0.0, 0.0, 1))
                bins, n = np.unique(np.floor(flat[flat >= 0] / width), return_counts=True)
                rows += [("bin", test, int(x), 0, 0.0, 0.0, 0.0, int(c)) for x, c in zip(bins, n)]
        return pd.DataFrame(rows, columns=["kind", "test", "x", "y", "chi2", "beta", "se", "n"])

    schema = "kind string, test string, x long, y long, chi2 double, beta double, se double, n long"
    from pyspark.sql import Window

    found = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInPandas(tile, schema)
    place = F.row_number().over(Window.partitionBy("test").orderBy(F.desc("chi2"), "x", "y"))
    best = F.max(F.struct("chi2", (-F.col("y")).alias("y")))
    histogram = found.where("kind = 'bin'").groupBy("test", F.col("x").alias("bin")).agg(F.sum("n").alias("n"))
    return {
        "top": found.where("kind = 'top'").withColumn("place", place).where(F.col("place") <= top).select("test", F.col("x").alias("focal"), F.col("y").alias("neighbour"), "chi2", "beta", "se"),
        "best": found.where("kind in ('focal', 'neighbour')").groupBy("test", F.col("kind").alias("side"), F.col("x").alias("snp")).agg(best.alias("k")).select("test", "side", "snp", (-F.col("k.y")).alias("other"), "k.chi2"),
        "histogram": histogram,
        "meta": _histogram_lambda(histogram, width),
    }


def _histogram_lambda(histogram: DataFrame, width: float) -> DataFrame:
    """test, n and lambda: the median by interpolation within its bin, over that of chi-square with one degree."""
    from pyspark.sql import Window

    from varispark.operators.scans import MEDIAN_CHI2

    w = Window.partitionBy("test")
    rows = histogram.withColumn("total", F.sum("n").over(w)).withColumn("before", F.sum("n").over(w.orderBy("bin")) - F.col("n"))
    middle = rows.where((F.col("before") < F.col("total") / 2) & (F.col("before") + F.col("n") >= F.col("total") / 2))
    at = (F.col("bin") + (F.col("total") / 2 - F.col("before")) / F.col("n")) * width
    return middle.select("test", F.col("total").alias("n"), (at / MEDIAN_CHI2).alias("lambda"))


def pair_scan(fit: Fit, focal: DataFrame, neighbour: DataFrame, terms: tuple[str, str], block: int = 256, top: int = 100) -> DataFrame:
    """Joint tests of a focal and a neighbour locus: the top pairs by chi2 of the two together: focal, neighbour, chi2.

    Loci of both sides are dealt into blocks; each pair of blocks is a tile of matrix products that keeps its best pairs.
    """
    ship(fit.spark)
    c, big = project(fit, list(terms))
    held = fit.spark.sparkContext.broadcast((c, big))  # as large as the terms' part of the equations
    n_a, n_b = (max(1, -(-df.count() // block)) for df in (focal, neighbour))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    deal = lambda df, n, name: df.select(F.col("snp").cast("long").alias("snp"), "dose", F.pmod(F.xxhash64("snp"), F.lit(n)).alias(name))
    a, b = deal(focal, n_a, "a").withColumn("b", every(n_b)), deal(neighbour, n_b, "b").withColumn("a", every(n_a))

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            (c0, c1), big = held.value
            left, right = left.sort_values("snp"), right.sort_values("snp")
            s, z = (np.stack(x["dose"].to_numpy()).astype(float) for x in (left, right))
            na, nb = (s @ c0)[:, None], (z @ c1)[None, :]
            daa, dbb = ((s @ big[0][0]) * s).sum(axis=1)[:, None], ((z @ big[1][1]) * z).sum(axis=1)[None, :]
            dab = s @ big[0][1] @ z.T
            det = daa * dbb - dab**2
            with np.errstate(invalid="ignore", divide="ignore"):
                chi2 = np.where(det > 1e-10, (dbb * na**2 - 2 * dab * na * nb + daa * nb**2) / det, -1.0).ravel()
            for k in np.argsort(-chi2, kind="stable")[:top]:
                if chi2[k] >= 0:
                    rows.append((int(left["snp"].iloc[k // len(right)]), int(right["snp"].iloc[k % len(right)]), float(chi2[k])))
        return pd.DataFrame(rows, columns=["focal", "neighbour", "chi2"])

    pairs = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInPandas(tile, "focal long, neighbour long, chi2 double")
    return pairs.orderBy(F.desc("chi2"), "focal", "neighbour").limit(top)


def write_scan(result: DataFrame, path: str, tests: list[str]) -> None:
    """A scan as CSV, one row per locus, and beside it a JSON of its tests, loci, thresholds and genomic control."""
    import json

    from varispark.operators import scans

    result.write.mode("overwrite").option("header", True).csv(f"{path}/scan")
    meta = {"tests": tests, "n_snp": result.count()}
    for k in range(len(tests)):
        one = result.select("snp", F.col(f"chi2_{k + 1}").alias("chi2")).where("chi2 is not null")
        n = one.count()
        meta[tests[k]] = {"n": n, "bonferroni": 0.05 / n if n else None, "lambda": scans.lambda_gc(one).first()[0] if n else None}
    spark = result.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def neighbour_kinship(markers: np.ndarray, weights: np.ndarray, near_pd: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Self and neighbour kinships of plants, and the neighbour covariates, from doses of -1 to 1 (plants x loci) and the
    plants' neighbour weights; with near_pd each is the nearest positive definite matrix. Sizes are those of relationship
    matrices that the equations take."""
    doses = np.nan_to_num(np.asarray(markers, dtype=float))
    q = doses.shape[1]
    covariates = doses * (weights @ doses)
    own = ((q - 1) / 2 + doses @ doses.T / 2) / (q - 1)
    other = covariates @ covariates.T / (q - 1)
    return (nearest_pd(own), nearest_pd(other), covariates) if near_pd else (own, other, covariates)


def nearest_pd(a: np.ndarray, rounds: int = 1_000, tol: float = 1e-9, floor: float = 1e-8) -> np.ndarray:
    """The nearest positive definite matrix in the Frobenius norm, by alternating projections with Dykstra's correction
    (Higham 2002): onto matrices without negative eigenvalues, then onto symmetric ones."""
    x, correction = (a + a.T) / 2, np.zeros_like(a, dtype=float)
    for _ in range(rounds):
        r = x - correction
        values, vectors = np.linalg.eigh(r)
        new = (vectors * np.maximum(values, floor * max(values[-1], 1e-300))) @ vectors.T
        correction = new - r
        new = (new + new.T) / 2
        if np.linalg.norm(new - x) <= tol * max(1.0, np.linalg.norm(x)):
            return new
        x = new
    return x


def neighbour_gwas(df: DataFrame, traits: list[str], plant: str, markers: DataFrame, edges: DataFrame, fixed: str = "1", tests: list[str] | None = None, struct: str = "us", max_plants: int = 5_000, **options) -> dict:
    """Scan of plants with their own and their neighbours' doses: scan, fit (self and neighbour kinship), fit_self, shares.

    df: one row per plant; markers: snp and dose, an array of -1 to 1 in the order of sorted plants; edges: src, dst, w.
    The null of tests with dir alone has the self kinship only, that of others both. Several traits have a column each
    and effects per trait. Relationship matrices are held on the driver, so plants number max_plants at most.
    """
    from varispark.operators.design import to_long

    spark = df.sparkSession
    ids = [r[0] for r in df.select(plant).distinct().orderBy(plant).limit(max_plants + 1).collect()]
    if len(ids) > max_plants:
        raise ValueError(f"more than {max_plants} plants")
    place = {v: i for i, v in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for r in edges.where(F.col("src").isin(ids) & F.col("dst").isin(ids)).select("src", "dst", "w").toLocalIterator() if len(ids) <= 200 else edges.join(F.broadcast(spark.createDataFrame([(v,) for v in ids], f"src {df.schema[plant].dataType.simpleString()}")), "src").select("src", "dst", "w").toLocalIterator():
        w[place[r["src"]], place[r["dst"]]] = r["w"]
    size = len(ids)
    ship(spark)

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, other, n = np.zeros((size, size)), np.zeros((size, size)), 0
        weights = shipped.value
        for pdf in frames:
            s = np.nan_to_num(np.stack(pdf["dose"].to_numpy()).astype(float)) if len(pdf) else np.zeros((0, size))
            x = s * (s @ weights.T)
            own, other, n = own + s.T @ s, other + x.T @ x, n + len(s)
        yield pd.DataFrame({"own": [own.ravel().tolist()], "other": [other.ravel().tolist()], "n": [n]})

    shipped = spark.sparkContext.broadcast(w)  # at most max_plants squared
    sums = markers.select("dose").mapInPandas(products, "own array<double>, other array<double>, n long")
    own, other, q = np.zeros((size, size)), np.zeros((size, size)), 0
    for r in sums.toLocalIterator():
        own, other, q = own + np.reshape(r["own"], (size, size)), other + np.reshape(r["other"], (size, size)), q + r["n"]
    k1, k2 = nearest_pd(((q - 1) / 2 + own / 2) / (q - 1)), nearest_pd(other / (q - 1))
    matrices = {"K1": pd.DataFrame(k1, index=ids, columns=ids), "K2": pd.DataFrame(k2, index=ids, columns=ids)}
    many = len(traits) > 1
    tests = tests or (["dir"] if many else ["dir", "sim|dir"])
    own_tests = [t for t in tests if {p.family for side in t.split("|") for p in parts_of(side, t)} <= {"dir"}]
    if many and len(own_tests) < len(tests):
        raise ValueError("with several traits only tests of dir are made: neighbours' incidences take one trait")
    neighbours = edges.where(F.col("w") != 0).groupBy(F.col("src").alias("__src")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("dst").cast("string"), "w"))).alias("__near"))  # a plant's neighbours
    rows = df.withColumn("__other", F.col(plant)).join(neighbours, F.col(plant) == F.col("__src"), "left").withColumn("__near", F.coalesce("__near", F.create_map().cast("map<string,double>")))
    rows = to_long(rows.drop("__src"), [c for c in rows.columns if c not in {*traits, "__src"}], traits).where("y is not null") if many else rows.withColumn("y", F.col(traits[0]))
    term = (lambda c, k: f"{struct}({c}, K={k})") if many else (lambda c, k: f"vm({c}, {k})")
    right = fixed if not many else "trait" if fixed == "1" else f"trait + trait:({fixed})"
    build = dict(matrices=matrices, max_levels=max_plants) | (dict(trait="trait", unit=plant) if many else {}) | options
    full_random = f"~ {term(plant, 'K1')} + {term('__other', 'K2')}"
    residual = f"~ {struct}(trait):units" if many else None
    both = reml.reml(rows, f"y ~ {right}", full_random, residual, **build)
    alone = reml.reml(rows, f"y ~ {right}", f"~ {term(plant, 'K1')}", residual, **build)
    out: dict = {"fit": both, "fit_self": alone, "K1": k1, "K2": k2}
    if own_tests:
        out["scan_self"] = scan_tests(alone, markers, {"dir": term(plant, "K1")}, own_tests, coding="sign")
    others = [t for t in tests if t not in own_tests]
    if others and not many:
        exposed = reml.build(rows, f"y ~ {right}", f"~ {term(plant, 'K1')} + {term('__other', 'K2')} + mm(__near)", residual, **build)
        theta = np.append(np.insert(both.theta, 2, -12.0)[:-1], both.theta[-1])  # the neighbours' own term only lends its columns
        out["scan"] = scan_tests(reml.fit(exposed, fixed_theta=theta), markers, {"dir": term(plant, "K1"), "ind": "mm(__near)"}, others, coding="sign")
    parts = both.components()
    share = []
    for i, t in enumerate(traits):
        name = f"[{t},{t}]" if many else ""
        v = [next(x for k, x in parts.items() if k == f"{p}{name}") for p in (term(plant, "K1"), term("__other", "K2"), "residual")]
        scaled = [v[0] * k1.trace() / size, v[1] * k2.trace() / size, v[2]]
        share.append((t, *[float(x / sum(v)) for x in v], *[float(x / sum(scaled)) for x in scaled]))
    out["shares"] = spark.createDataFrame(share, "trait string, self double, neighbour double, residual double, share_self double, share_neighbour double, share_residual double")
    return out


def neighbour_scale(df: DataFrame, traits: list[str], plant: str, markers: DataFrame, units: DataFrame, scales: list[float], **options) -> DataFrame:
    """The null with neighbours within each radius against that with the self kinship only: scale, trait, shares, loglik,
    loglik_self, lrt, p (one trait: half a chi-square on the boundary). units: block, id, r, c."""
    from varispark.operators.design import neighbours
    from varispark.operators.inference import likelihood_ratio

    rows, kind = [], None
    for s in sorted(scales):
        near = neighbours(units, 1, "euclidean", (1.0 / s, 1.0 / s)).select("src", "dst")
        count = near.groupBy("src").agg((1 / F.count("*")).alias("w"))
        found = neighbour_gwas(df, traits, plant, markers, near.join(count, "src"), tests=["dir"], **options)
        lrt, p = likelihood_ratio(found["fit"], found["fit_self"])
        kind = found["shares"].schema
        rows += [(float(s), *r, float(found["fit"].loglik), float(found["fit_self"].loglik), lrt, p if len(traits) == 1 else None) for r in found["shares"].collect()]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    return df.sparkSession.createDataFrame(rows, f"scale double, {columns}, loglik double, loglik_self double, lrt double, p double")


def pair_kernel_sums(plants: DataFrame, own: pd.DataFrame, other: pd.DataFrame, level: str = "level", near: str = "near", normalise: bool = True, ridge: float = 1e-6) -> DataFrame:
    """The entries of pair_kernel() summed up by the two plants' genotypes: i, j (i no later than j among the relationships), n pairs
    and x, their sum, each pair once.

    The kernel is bilinear in the neighbours' weights, so the sum over the pairs of two genotypes is the product of the weights' sums, and
    no pair is formed: the plants are read once and summed up by genotype, as many rows as there are genotypes by neighbours'. Within a
    genotype half the square's sum and half the diagonal's are the pairs' sum.
    """
    k1, k2 = own.to_numpy(dtype=float), other.to_numpy(dtype=float)
    rows = plants.select(F.col(level).cast("string").alias("l"), F.col(near).cast("map<string,double>").alias("w"))
    known = F.create_map(*[v for k, name in enumerate(other.index) for v in (F.lit(str(name)), F.lit(k))])
    entries = F.filter(F.transform(F.map_entries("w"), lambda e: F.struct(F.element_at(known, e["key"]).alias("k"), e["value"].alias("v"))), lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    held = plants.sparkSession.createDataFrame([(k2.tolist(),)], "m array<array<double>>")  # as large as the genotypes squared
    listed = rows.join(F.broadcast(held), how="cross").select("l", F.coalesce(entries, F.array()).alias("e"), "m")
    square = F.aggregate("e", F.lit(0.0), lambda s, a: s + F.aggregate("e", F.lit(0.0), lambda q, b: q + b["v"] * F.get(F.get("m", a["k"]), b["k"])) * a["v"])
    sizes = listed.select("l", square.alias("d")).groupBy("l").agg(F.count("*").alias("n"), F.sum("d").alias("d")).collect()  # as many as there are genotypes
    sums = listed.select("l", F.inline("e")).groupBy("l", "k").agg(F.sum("v").alias("v")).collect()
    at = {str(name): k for k, name in enumerate(own.index)}
    if any(r["l"] not in at for r in sizes):
        raise ValueError("a plant's genotype is not among the relationships")
    n, d, s = np.zeros(len(at), dtype=np.int64), np.zeros(len(at)), np.zeros((len(at), len(k2)))
    for r in sizes:
        n[at[r["l"]]], d[at[r["l"]]] = r["n"], r["d"]
    for r in sums:
        s[at[r["l"]], r["k"]] = r["v"]
    diagonal = np.diag(k1) * d
    mean = diagonal.sum() / max(1, n.sum())
    if not mean > 0 or not np.isfinite(mean):
        raise ValueError("the kernel has no positive diagonal")
    scale, extra = (mean, ridge) if normalise else (1.0, ridge * mean)
    x = k1 * (s @ k2 @ s.T)
    out = []
    for i in np.nonzero(n)[0].tolist():
        out.append((str(own.index[i]), str(own.index[i]), int(n[i] * (n[i] + 1) // 2), float((x[i, i] + diagonal[i]) / 2 / scale + extra * n[i])))
        out += [(str(own.index[i]), str(own.index[j]), int(n[i] * n[j]), float(x[i, j] / scale)) for j in range(i + 1, len(n)) if n[j]]
    return plants.sparkSession.createDataFrame(out, "i string, j string, n long, x double")


def pair_kernel(plants: DataFrame, own: pd.DataFrame, other: pd.DataFrame, plant: str = "plant", level: str = "level", near: str = "near", block: str | None = None, normalise: bool = True, ridge: float = 1e-6, tile: int = 1_024) -> DataFrame:
    """The kernel of a plant's and its neighbours' genotypes together, as pairs (a, b, x; block first if it is named), each pair
    once: the product of the two plants' own relationship and of that of their neighbours, over the mean of the diagonal if
    normalised, with the ridge (in shares of it) on the diagonal, since a plant without neighbours has a row of zeros.

    plants: plant, level (its genotype) and near, a map from neighbours' genotypes to weights. own and other: relationships
    with genotypes as index and columns, which are broadcast. Pairs are made by tiles of two parts of the plants, or within blocks, so
    that a term vm(plant, K) of blocks.build() takes them as they are.
    """
    ship(plants.sparkSession)
    held = plants.sparkSession.sparkContext.broadcast((own, other))  # as large as the genotypes squared
    rows = plants.select(F.col(plant).cast("string").alias("p"), F.col(level).cast("string").alias("l"), F.col(near).cast("map<string,double>").alias("w"), *([F.col(block).alias("block")] if block else []))

    def parts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Places of the own genotypes, and the neighbours' weights."""
        o, n = held.value
        w = np.zeros((len(pdf), len(n)))
        for k, m in enumerate(pdf["w"]):
            m = dict(m) if m is not None else {}
            if m:
                w[k, n.index.get_indexer(list(m))] += list(m.values())
        at = o.index.get_indexer(pdf["l"])
        if (at < 0).any():
            raise ValueError("a plant's genotype is not among the relationships")
        return at, w

    def diagonal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            at, w = parts(pdf)
            yield pd.DataFrame({"x": np.diag(held.value[0].to_numpy())[at] * ((w @ held.value[1].to_numpy()) * w).sum(axis=1)})

    mean = rows.mapInPandas(diagonal, "x double").agg(F.avg("x")).first()[0]
    if not mean or mean <= 0 or not np.isfinite(mean):
        raise ValueError("the kernel has no positive diagonal")
    scale, extra = (mean, ridge) if normalise else (1.0, ridge * mean)

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        (a, v), (b, w) = parts(left), parts(right)
        x = held.value[0].to_numpy()[np.ix_(a, b)] * (v @ held.value[1].to_numpy() @ w.T) / scale
        if same:
            x += extra * np.eye(len(left))
        i, j = np.nonzero(np.tril(np.ones(x.shape)) if same else np.ones(x.shape))
        return pd.DataFrame({"a": left["p"].to_numpy()[i], "b": right["p"].to_numpy()[j], "x": x[i, j]})

    if block:
        kind = rows.schema["block"].dataType.simpleString()
        return rows.groupBy("block").applyInPandas(lambda pdf: kernel(pdf, pdf, True).assign(block=pdf["block"].iloc[0])[["block", "a", "b", "x"]], f"block {kind}, a string, b string, x double")
    n = max(1, -(-rows.count() // tile))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("p"), F.lit(n)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = dealt.withColumn("i", F.col("own")).withColumn("j", every).where("j <= i")
    right = dealt.withColumn("j", F.col("own")).withColumn("i", every).where("j <= i")
    right = right.toDF(*right.columns)  # columns of its own, as both sides come from one table

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "x": []})
        return kernel(x.sort_values("p"), y.sort_values("p"), bool(x["i"].iloc[0] == x["j"].iloc[0]))

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(lambda x, y: meet(x, y), "a string, b string, x double")
