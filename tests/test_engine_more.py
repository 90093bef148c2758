"""Average information, absorbed factors, scans by trait, refits, pairs, predictions, lags, posteriors, surfaces: against
dense algebra on small data."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varispark.functions import bordered, optimise, splines, structures
from varispark.functions.special import matern
from varispark.operators import bayes, design, genome, inference, lag, predictions, reml, scans, tables
from varispark.plans.grammar import parse_random, parse_residual
from varispark.sources import bundle, images


def gls(y, x, v):
    vi = np.linalg.inv(v)
    cov = np.linalg.inv(x.T @ vi @ x)
    return cov @ x.T @ vi @ y, cov


@pytest.fixture(scope="module")
def two(spark):
    """Two traits with missing records, 12 genotypes."""
    rng = np.random.default_rng(21)
    q, n = 12, 60
    g = rng.integers(0, q, n)
    u = rng.normal(size=(q, 2)) @ np.array([[1.0, 0.0], [0.5, 0.6]]).T
    e = rng.normal(size=(n, 2)) @ np.array([[0.8, 0.0], [0.3, 0.7]]).T
    y = 1000 + u[g] + e
    rows = [(i, f"g{g[i]:02d}", t, float(y[i, k])) for i in range(n) for k, t in enumerate("ab") if not (i % 7 == 0 and k) and not (i % 11 == 0 and not k)]
    pdf = pd.DataFrame(rows, columns=["u", "g", "trait", "y"])
    doses = rng.integers(0, 3, (9, q)).astype(float)
    markers = spark.createDataFrame([(k, d.tolist(), k != 4) for k, d in enumerate(doses)], "snp long, dose array<double>, good boolean")
    fit = reml.reml(spark.createDataFrame(pdf), "y ~ trait", "~ us(g)", "~ us(trait):units", trait="trait", unit="u")
    return pdf, doses, markers, fit


def dense_two(pdf, theta):
    """Design, incidence by trait and covariance of the two-trait data."""
    t, g = (pdf["trait"] == "b").astype(int).to_numpy(), pdf["g"].str[1:].astype(int).to_numpy()
    levels = {v: i for i, v in enumerate(sorted(set(g)))}
    z = np.zeros((len(pdf), 2 * len(levels)))
    z[np.arange(len(pdf)), t * len(levels) + np.array([levels[v] for v in g])] = 1
    same = pdf["u"].to_numpy()[:, None] == pdf["u"].to_numpy()[None, :]
    sg, sr = structures.sigma(theta[:3], "us", 2), structures.sigma(theta[3:], "us", 2)
    v = z @ np.kron(sg, np.eye(len(levels))) @ z.T + same * sr[np.ix_(t, t)]
    return np.column_stack([np.ones(len(pdf)), t]), z, v, sorted(levels)


def test_average_information_equals_working_columns(two):
    pdf, _, _, fit = two
    theta = fit.theta + 0.1
    x, _, v, _ = dense_two(pdf, theta)
    y, h = pdf["y"].to_numpy(), 1e-5
    vi = np.linalg.inv(v)
    p = vi - vi @ x @ np.linalg.inv(x.T @ vi @ x) @ x.T @ vi
    work = []
    for j in range(6):
        e = np.eye(6)[j] * h
        work.append((dense_two(pdf, theta + e)[2] - dense_two(pdf, theta - e)[2]) / (2 * h) @ p @ y)
    want = np.array([[a @ p @ b for b in work] for a in work])
    assert fit.likelihood.average_information(theta) == pytest.approx(want, rel=1e-5, abs=1e-6)
    assert fit.likelihood(theta) == pytest.approx(reml.dense_neg2(y, x, v), abs=1e-6)
    assert tables.gradient_check(fit) < 1e-3


def test_optimisers_agree(two):
    pdf, _, _, fit = two
    other = reml.fit(fit.model, optimizer="bfgs")
    assert fit.converged and fit.neg2 == pytest.approx(other.neg2, abs=1e-6) and fit.diagnostics["pd_hessian"]
    held = reml.fit(fit.model, low=np.array([-12, -12, -12, fit.theta[3] + 0.05, -12, -12.0]))
    assert held.theta[3] == pytest.approx(fit.theta[3] + 0.05) and held.at_bound[3]
    codes = {r["name"]: r["constraint"] for r in tables.components(held).collect()}
    assert codes["us(g)[a,a]"] == "P" and codes["us(g)[b,a]"] == "U" and codes["residual[a,a]"] == "B"
    assert "converged" in tables.report(fit)


def test_variance_leaves_its_floor(spark):
    rng = np.random.default_rng(5)
    g = np.repeat(np.arange(15), 6)
    df = spark.createDataFrame(pd.DataFrame({"y": rng.normal(size=15)[g] + rng.normal(size=90) * 0.5, "g": g}))
    good = reml.reml(df, "y ~ 1", "~ g")
    stuck = reml.fit(good.model, theta=np.array([-12.0, good.theta[1]]))
    assert stuck.neg2 == pytest.approx(good.neg2, abs=1e-6)


def test_absorbed_factor_equals_equations(spark, tmp_path):
    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame({"a": rng.integers(0, 60, n), "b": rng.integers(0, 5, n), "x": rng.normal(size=n)})
    pdf["y"] = 50 + 0.3 * pdf["x"] + rng.normal(size=60)[pdf["a"]] + rng.normal(size=5)[pdf["b"]] * 0.5 + rng.normal(size=n)
    df = spark.createDataFrame(pdf)
    whole, part = reml.reml(df, "y ~ x", "~ a + b"), reml.reml(df, "y ~ x", "~ a + b", absorb="a")
    assert part.model.m < whole.model.m and part.neg2 == pytest.approx(whole.neg2, abs=1e-6)
    assert list(part.components().values()) == pytest.approx(list(whole.components().values()), rel=1e-4)
    theta = whole.theta + 0.2
    assert reml.Likelihood(part.model).value_and_gradient(theta)[1] == pytest.approx(reml.Likelihood(whole.model).value_and_gradient(theta)[1], abs=1e-4)
    fixed = [reml.fit(f.model, fixed_theta=theta) for f in (whole, part)]
    rows = [{(r["term"], r["level"]): (r["blup"], r["pev"]) for r in f.blups().collect()} for f in fixed]
    assert rows[0].keys() == rows[1].keys() and all(rows[0][k] == pytest.approx(rows[1][k], abs=1e-8) for k in rows[0])
    ed = [{r["term"]: r["ed"] for r in f.dimensions().collect()} for f in fixed]
    assert ed[0] == pytest.approx(ed[1], abs=1e-6)
    fits = [sorted((r["x"], r["fitted"]) for r in reml.fitted(f, df).collect()) for f in fixed]
    assert np.array(fits[0]) == pytest.approx(np.array(fits[1]), abs=1e-8)
    doses = spark.createDataFrame([(k, rng.normal(size=5).tolist()) for k in range(4)], "snp long, dose array<double>")
    found = [[tuple(r) for r in genome.scan(f, doses, ["b"]).orderBy("snp").collect()] for f in fixed]
    assert np.array(found[0]) == pytest.approx(np.array(found[1]), rel=1e-6)
    bundle.save_model(spark, part.model, str(tmp_path))
    assert reml.Likelihood(bundle.load_model(spark, str(tmp_path)))(theta) == pytest.approx(fixed[1].neg2, abs=1e-8)
    auto = reml.reml(df, "y ~ x", "~ a + b", max_levels=40)
    assert auto.model.absorbed and auto.neg2 == pytest.approx(whole.neg2, abs=1e-6)


def test_scan_on_a_lattice_equals_least_squares(spark):
    rng = np.random.default_rng(8)
    cells = [(r, c) for r in range(8) for c in range(6) if (r * c) % 5 != 4]
    g = rng.integers(0, 7, len(cells))
    y = rng.normal(size=7)[g] + rng.normal(size=len(cells))
    df = spark.createDataFrame([(float(v), f"g{k}", r, c) for v, k, (r, c) in zip(y, g, cells)], "y double, g string, r int, c int")
    theta = np.array([-0.2, 0.1, 0.5, -0.3])
    fit = reml.reml(df, "y ~ 1", "~ g", "~ ar1(r):ar1(c)", fixed_theta=theta)
    at = np.array(cells, dtype=float)
    near = lambda k, rho: rho ** np.abs(at[:, None, k] - at[None, :, k])
    signed = lambda k, rho: np.sign(rho) ** np.abs(at[:, None, k] - at[None, :, k]) * near(k, abs(rho))
    z = np.eye(7)[g]
    v = np.exp(2 * theta[0]) * z @ z.T + np.exp(2 * theta[1]) * near(0, np.tanh(0.5)) * signed(1, np.tanh(-0.3))
    doses = rng.integers(0, 3, (5, 7)).astype(float)
    got = genome.scan(fit, spark.createDataFrame([(k, d.tolist()) for k, d in enumerate(doses)], "snp long, dose array<double>"), ["g"]).orderBy("snp").collect()
    for r, d in zip(got, doses):
        b, cov = gls(y, np.column_stack([np.ones(len(y)), d[g]]), v)
        assert (r["beta_1"], r["chi2_1"]) == pytest.approx((b[1], b[1] ** 2 / cov[1, 1]), rel=1e-6)


def test_tests_by_trait_equal_least_squares(two):
    pdf, doses, markers, fit = two
    x, z, v, levels = dense_two(pdf, fit.theta)
    y, t, g = pdf["y"].to_numpy(), x[:, 1], pdf["g"].str[1:].astype(int).to_numpy()
    got = {r["snp"]: r for r in genome.scan_tests(fit, markers, {"dir": "us(g)"}, ["dir", "dir[b]", "dir@common", "dir@het"], keep="good").collect()}
    for k, d in enumerate(doses):
        s = d[g]
        b, cov = gls(y, np.column_stack([x, s * (1 - t), s * t]), v)
        b, cov = b[2:], cov[2:, 2:]
        one, c = gls(y, np.column_stack([x, s]), v)
        want = (b @ np.linalg.solve(cov, b), b[1] ** 2 / cov[1, 1], one[2] ** 2 / c[2, 2], (b[1] - b[0]) ** 2 / (cov[0, 0] + cov[1, 1] - 2 * cov[0, 1]))
        if k == 4:
            assert got[k]["chi2_1"] is None
        else:
            assert [got[k][f"chi2_{i}"] for i in (1, 2, 3, 4)] == pytest.approx(want, rel=1e-5) and got[k]["df_1"] == 2 and 0 <= got[k]["p_1"] <= 1
    assert [r["chi2_1"] for r in genome.scan_tests(fit, markers, {"dir": "us(g)"}, ["dir"], maf=0.49).collect()].count(None) > 3
    for wrong in ("foo", "dir@all", "dir[c]", "| dir", "dir + dir@common"):
        with pytest.raises(ValueError):
            genome.parse_test(wrong, ["a", "b"])
    columns, hypothesis, labels = genome.parse_test("dir[a,2] | ind@common", ["a", "b"])
    assert len(columns) == 3 and hypothesis.shape == (2, 3) and labels == ["dir[a]", "dir[b]"]


def test_exact_refits_equal_fits_with_the_locus(two, spark):
    pdf, doses, markers, fit = two
    got = {r["snp"]: r for r in genome.refit(fit, markers.where("snp < 3"), {"dir": "us(g)"}, "dir").collect()}
    for k in range(3):
        s = doses[k][pdf["g"].str[1:].astype(int)]
        more = spark.createDataFrame(pdf.assign(sa=s * (pdf["trait"] == "a"), sb=s * (pdf["trait"] == "b")))
        whole = reml.reml(more, "y ~ trait + sa + sb", "~ us(g)", "~ us(trait):units", trait="trait", unit="u")
        assert got[k]["neg2"] == pytest.approx(whole.neg2, abs=1e-4) and got[k]["converged"]
        b, v = whole.solution[2:4], whole.cinv[2:4, 2:4]
        assert got[k]["chi2"] == pytest.approx(float(b @ np.linalg.solve(v, b)), rel=1e-3)


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(9)
    n, qa, qb = 90, 6, 5
    a, b = rng.integers(0, qa, n), rng.integers(0, qb, n)
    y = rng.normal(size=qa)[a] + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": a, "b": b, "near": [{f"{v}": 1.0} for v in rng.integers(0, qa, n)]}), "y double, a int, b int, near map<string,double>")
    theta = np.array([0.1, -0.4, 0.0])
    left, right = (rng.choice([-1.0, 0.0, 1.0], size=(7, q)) for q in (qa, qb))
    loci = [spark.createDataFrame([(k, d.tolist()) for k, d in enumerate(m)], "snp long, dose array<double>") for m in (left, right)]
    return df, y, a, b, theta, left, right, loci


def test_pairs_equal_least_squares(pairs):
    df, y, a, b, theta, left, right, loci = pairs
    fit = reml.reml(df, "y ~ 1", "~ a + b", fixed_theta=theta)
    za, zb, s = np.eye(6)[a], np.eye(5)[b], np.exp(2 * theta)
    v = s[0] * za @ za.T + s[1] * zb @ zb.T + s[2] * np.eye(len(y))
    out = genome.cogwas(fit, *loci, ("a", "b"), block=3, top=1000)
    rows = {(r["test"], r["focal"], r["neighbour"]): r for r in out["top"].collect()}
    best = {}
    for i, d in enumerate(left):
        for j, e in enumerate(right):
            u, one = d[a] * e[b], np.ones(len(y))
            for test, given in (("pair", []), ("pair|dir", [d[a]]), ("pair|ind", [e[b]]), ("pair|dir+ind", [d[a], e[b]])):
                x = np.column_stack([one, *given, u])
                r = rows.get((test, i, j))
                if np.linalg.matrix_rank(x) < x.shape[1]:
                    assert r is None
                    continue
                beta, cov = gls(y, x, v)
                assert (r["beta"], r["chi2"], r["se"]) == pytest.approx((beta[-1], beta[-1] ** 2 / cov[-1, -1], cov[-1, -1] ** 0.5), rel=1e-5, abs=1e-8)
                best[test, "focal", i] = max(best.get((test, "focal", i), 0.0), r["chi2"])
                best[test, "neighbour", j] = max(best.get((test, "neighbour", j), 0.0), r["chi2"])
    assert {(r["test"], r["side"], r["snp"]): r["chi2"] for r in out["best"].collect()} == pytest.approx(best)
    assert sum(r["n"] for r in out["histogram"].collect()) == len(rows)
    assert {r["test"]: r["n"] for r in out["meta"].collect()}["pair"] == sum(k[0] == "pair" for k in rows)


def test_products_of_doses_equal_least_squares(pairs):
    df, y, a, _, _, left, _, loci = pairs
    near = np.zeros((len(y), 6))
    for i, r in enumerate(df.select("near").collect()):
        for k, w in r[0].items():
            near[i, int(k)] = w
    theta = np.array([0.1, -0.3, 0.0])
    fit = reml.reml(df, "y ~ 1", "~ a + mm(near)", fixed_theta=theta)
    za, s = np.eye(6)[a], np.exp(2 * theta)
    v = s[0] * za @ za.T + s[1] * near @ near.T + s[2] * np.eye(len(y))
    got = {r["snp"]: r for r in genome.scan_tests(fit, loci[0], {"dir": "a", "ind": "mm(near)"}, ["sim|dir", "sim"], coding="sign").collect()}
    for k, d in enumerate(left):
        u = d[a] * (near @ d)
        for t, given in ((1, [d[a]]), (2, [])):
            x = np.column_stack([np.ones(len(y)), *given, u])
            if np.linalg.matrix_rank(x) == x.shape[1]:
                beta, cov = gls(y, x, v)
                assert got[k][f"chi2_{t}"] == pytest.approx(beta[-1] ** 2 / cov[-1, -1], rel=1e-6, abs=1e-9)


def test_predictions_over_several_factors(spark):
    rng = np.random.default_rng(10)
    n = 120
    pdf = pd.DataFrame({"t": rng.choice(list("abc"), n), "s": rng.choice(["p", "q"], n, p=[0.7, 0.3]), "x": rng.normal(size=n), "g": rng.integers(0, 6, n)})
    pdf["y"] = 20 + (pdf["t"] == "b") + 0.5 * (pdf["s"] == "q") * (pdf["t"] == "c") + 0.2 * pdf["x"] + rng.normal(size=6)[pdf["g"]] + rng.normal(size=n)
    fit = reml.reml(spark.createDataFrame(pdf), "y ~ t*s + x", "~ g")
    b, names = fit.estimates, [lab for e in fit.model.fixed for lab in e.labels]

    def mean(t, s, x):
        on = {"(Intercept)": 1, f"t{t}": 1, f"s{s}": 1, f"t{t}:s{s}": 1, "x": x}
        return sum(on.get(k, 0) * v for k, v in zip(names, b))

    xm, share = pdf["x"].mean(), (pdf["s"] == "q").mean()
    cells = {(r["t"], r["s"]): r["predicted"] for r in predictions.predict(fit, "t:s").collect()}
    assert all(cells[t, s] == pytest.approx(mean(t, s, xm)) for t in "abc" for s in "pq")
    equal = {r["t"]: r["predicted"] for r in predictions.predict(fit, "t").collect()}
    own = {r["t"]: r["predicted"] for r in predictions.predict(fit, "t", average="proportional", at={"x": 1.0}).collect()}
    given = {r["t"]: r["predicted"] for r in predictions.predict(fit, "t", weights={"q": 1.0}, levels={"t": ["c"]}).collect()}
    for t in "abc":
        assert equal[t] == pytest.approx((mean(t, "p", xm) + mean(t, "q", xm)) / 2)
        assert own[t] == pytest.approx((1 - share) * mean(t, "p", 1.0) + share * mean(t, "q", 1.0))
    assert given == {"c": pytest.approx(mean("c", "q", xm))}
    u = fit.solution[fit.model.random[0].offset :]
    levels = {r["g"]: r for r in predictions.predict(fit, "g", levels={"t": ["a"], "s": ["p"]}).collect()}
    assert levels[2]["predicted"] == pytest.approx(mean("a", "p", xm) + u[2]) and levels[2]["estimable"]
    assert predictions.predict(fit, "g", random=False).select("predicted").distinct().count() == 1
    plain, kr = (predictions.predict(fit, "t", vcov=v, random=False).collect() for v in ("simple", "kenward-roger"))
    assert all(k["se"] >= p["se"] - 1e-9 for p, k in zip(plain, kr))
    table, rms = predictions.differences(fit, "g")
    assert table.count() == 15 and rms > 0
    with pytest.raises(ValueError):
        predictions.predict(fit, "nothing")


def test_equal_entries_are_found(spark):
    rng = np.random.default_rng(12)
    rows = [(float(v), {f"g{k}": 1.0}, {f"g{k}": 1.0}) for v, k in zip(rng.normal(size=40), rng.integers(0, 5, 40))]
    df = spark.createDataFrame(rows, "y double, one map<string,double>, two map<string,double>")
    fit = reml.reml(df, "y ~ 1", "~ str(~ mm(one) + mm(two), us)", fixed_theta=np.array([0.0, 0.1, 0.0, 0.0]))
    ((_, entries),) = tables.aliased(fit)
    assert entries == [(0, 0), (1, 1)]
    assert {r["constraint"] for r in tables.components(fit).collect()} >= {"N", "F"}


def test_target_ratios_and_references(two):
    _, _, _, fit = two
    t = [{"name": "a", "direct": "us(g):a", "indirect_within": "us(g)[2]", "other": ["residual:a"]}]
    rows = {(r["quantity"], r["component"]): r for r in tables.target_ratios(fit, t, {"a": {"d": 2.0, "k_within": 0.5, "c": 0.7, "s_within": 3.0}}).collect()}
    v = fit.components()
    aa, ab, bb, e = v["us(g)[a,a]"], v["us(g)[b,a]"], v["us(g)[b,b]"], v["residual[a,a]"]
    whole = 2 * aa + 0.5 * bb + e + 1.4 * ab
    assert rows["h2", "h2"]["estimate"] == pytest.approx(2 * aa / whole) and rows["h2", "h2_ext_total"]["estimate"] == pytest.approx((2 * aa + 1.4 * ab + 0.5 * bb) / whole)
    assert rows["tau2", "own:a"]["estimate"] == pytest.approx((2 * aa + 12 * ab + 18 * bb) / whole) and rows["cor", "a~b"]["ci_low"] > -1
    assert tables.reference(fit, "us(g)[1,2]") == ("us(g)", 0, 1) and tables.reference(fit, "us(g):a~us(g):b") == ("us(g)", 0, 1)
    with pytest.raises(ValueError):
        tables.reference(fit, "us(g)")


def test_lag_between_traits(spark):
    rng = np.random.default_rng(14)
    n = 24
    w = (rng.random((n, n)) < 0.15) * 0.2
    np.fill_diagonal(w, 0)
    x, e = np.repeat([0.0, 1.0], n), rng.normal(size=2 * n)
    psi = np.array([[0.0, 0.5], [0.0, 0.0]])
    y = np.linalg.solve(np.eye(2 * n) - np.kron(psi, w), 1 + x + e)
    df = spark.createDataFrame(pd.DataFrame({"id": np.tile(np.arange(n), 2), "trait": ["a"] * n + ["b"] * n, "y": y}))
    edges = spark.createDataFrame([(0, int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "block int, src int, dst int, w double")
    s = lag.spec(["a", "b"])
    model = lag.build(df, "id", edges, "y ~ trait", None, "~ diag(trait):units", trait="trait", lag=s)
    m = np.array([[0.2, 0.3], [-0.1, 0.1]])
    det = list(lag.log_jacobian(edges, [m]).values())[0]
    big = np.eye(2 * n) - np.kron(m, w)
    assert det == pytest.approx(np.linalg.slogdet(big)[1], abs=1e-9)
    own = edges.crossJoin(spark.createDataFrame([("a",), ("b",)], "trait string"))
    assert list(lag.log_jacobian(own, [m], traits=["a", "b"]).values())[0] == pytest.approx(det, abs=1e-9)
    assert list(lag.log_jacobian(edges, [np.eye(2) * 50]).values())[0] == -np.inf
    theta, design_ = np.array([0.1, -0.2]), np.column_stack([np.ones(2 * n), x])
    v = np.diag(np.repeat(np.exp(2 * theta), n))
    assert reml.Likelihood(lag.at(model, m))(theta) == pytest.approx(reml.dense_neg2(big @ y, design_, v), abs=1e-6)
    one = lag.spec(["a", "b"], receivers=["a"], emitters=["b"])
    assert one.nilpotent() and one.names == ["Psi[a<-b]"] and lag.weakly_identified(s) == ["b/a"]
    got = lag.fit_psi(lag.build(df, "id", edges, "y ~ trait", None, "~ diag(trait):units", trait="trait", lag=one), edges)
    (r,) = got.report().collect()
    assert abs(r["estimate"] - 0.5) < 4 * r["se"] and r["se"] > 0


def test_posterior_tools(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(4, 4000))
    for i in range(1, 4000):
        x[:, i] = 0.6 * x[:, i - 1] + 0.8 * x[:, i]
    assert bayes.effective_size(x) == pytest.approx(16_000 * 0.4 / 1.6, rel=0.15)
    assert bayes.nested_rhat(x, 2) < 1.05 < bayes.nested_rhat(x + np.array([0, 0, 2, 2])[:, None], 2)
    g = np.repeat(np.arange(10), 8)
    df = spark.createDataFrame(pd.DataFrame({"y": rng.normal(size=10)[g] + rng.normal(size=80), "g": g}))
    fit = reml.reml(df, "y ~ 1", "~ g")
    for prior in (bayes.Prior("half_t", 1.0), bayes.Prior("inv_gamma", 1.0, shape=2.0, rate=1.0)):
        f = bayes.potential(fit.likelihood, 1.0, fit.theta, prior)
        assert f(fit.theta + 0.1)[1] == pytest.approx(optimise.gradient(lambda t: f(t)[0], fit.theta + 0.1), abs=1e-4)  # noqa: B023
    draws = bayes.sample(fit, chains=4, warmup=120, draws=250, adapt="chees", prior=bayes.Prior(scale=2.0)).cache()
    summary = {r["parameter"]: r for r in bayes.summarise(draws).collect()}
    plain = {r["parameter"]: r for r in bayes.summarise(bayes.sample(fit, sd_scale=2.0, chains=4, warmup=120, draws=250)).collect()}
    assert all(summary[k]["rhat"] < 1.1 and abs(summary[k]["mean"] - plain[k]["mean"]) < 0.2 for k in (0, 1))
    assert all(r["ess"] > 100 for r in bayes.diagnostics(draws).collect())
    effects = {(r["term"], r["effect"]): r for r in bayes.effect_moments(fit, draws).collect()}
    assert abs(effects["g", "3"]["mean"] - fit.solution[4]) < 0.3 and effects["g", "3"]["sd"] > 0


def test_lkj_density_of_two_traits(two):
    """With shape 1 the correlation is uniform: the prior is that of two standard deviations and a flat correlation."""
    _, _, _, fit = two
    density = bayes.make_log_prior(fit.likelihood, bayes.Prior("uniform", 1.0, lkj=1.0), 1.0, fit.theta)
    sd, r = np.array([0.7, 1.3]), np.linspace(-0.8, 0.8, 9)
    got = []
    for v in r:
        low = np.linalg.cholesky(np.outer(sd, sd) * np.array([[1, v], [v, 1]]))
        theta = np.array([np.log(low[0, 0]), low[1, 0], np.log(low[1, 1]), *fit.theta[3:]])
        # density of theta over that of (sd1, sd2, r): its Jacobian
        flat = lambda t: np.array([np.exp(t[0]), np.hypot(t[1], np.exp(t[2])), t[1] / np.hypot(t[1], np.exp(t[2]))])
        jac = np.stack([(flat(theta[:3] + e) - flat(theta[:3] - e)) / 2e-6 for e in np.eye(3) * 1e-6])
        got.append(density(theta)[0] - np.log(abs(np.linalg.det(jac))))
    assert np.ptp(got) < 1e-4


def test_groups_of_sections(spark):
    rng = np.random.default_rng(18)
    rows = [(i, t, s, float(rng.normal())) for i in range(60) for s in ["abc"[i % 3]] for t in ("x", "y")]
    df = spark.createDataFrame(rows, "u int, trait string, site string, y double")
    fit = reml.reml(df, "y ~ trait", None, "~ dsum(~ us(trait):units + diag(trait):units | site, levels=[[a, c], [b]])", trait="trait", unit="u", fixed_theta=np.array([0.1, 0.3, -0.1, 0.2, 0.0]))
    big, t, same = structures.sigma(np.array([0.1, 0.3, -0.1]), "us", 2), np.array([r[1] == "y" for r in rows]).astype(int), np.array([r[0] for r in rows])
    other = structures.sigma(np.array([0.2, 0.0]), "diag", 2)
    own = np.array([r[2] == "b" for r in rows])
    v = (same[:, None] == same[None, :]) * np.where(own[:, None], other[np.ix_(t, t)], big[np.ix_(t, t)])
    assert fit.neg2 == pytest.approx(reml.dense_neg2(np.array([r[3] for r in rows]), np.column_stack([np.ones(120), t]), v), abs=1e-6)
    with pytest.raises(ValueError):
        parse_residual("~ dsum(~ us(trait):units + diag(trait):units | site, levels=[[a], [a]])")


def test_surfaces_by_level_and_on_grids(spark, tmp_path):
    rng = np.random.default_rng(19)
    cells = [(b, r, c) for b in "pq" for r in range(10) for c in range(8)]
    y = [np.sin(r / 3) + 0.1 * c + (b == "q") + rng.normal() * 0.2 for b, r, c in cells]
    df = spark.createDataFrame([(float(v), b, r, c) for v, (b, r, c) in zip(y, cells)], "y double, b string, r int, c int")
    fit = reml.reml(df, "y ~ b", "~ spl2d(r, c, nseg=[6, 4], nest=[2, 1], at=b)")
    assert len(fit.model.random) == 10 and "spl2d(r, c, nseg=[6, 4], nest=[2, 1], at=b)[p]" in fit.model.spec["surfaces"]
    name = "spl2d(r, c, nseg=[6, 4], nest=[2, 1], at=b)[q]"
    at = reml.spatial_trend(fit, name).toPandas()
    want = np.sin(at["r"] / 3) + 0.1 * at["c"]
    assert np.corrcoef(at["trend"], want)[0, 1] > 0.95
    grid = reml.spatial_trend(fit, name, (10, 8)).toPandas()
    both = at.merge(grid.assign(r=grid["r"].round().astype(int), c=grid["c"].round().astype(int)), on=["r", "c"])
    assert len(both) == 80 and both["trend_x"].to_numpy() == pytest.approx(both["trend_y"].to_numpy(), abs=1e-8)
    for kind in ("png", "svg"):
        images.write_map(reml.spatial_trend(fit, name, (12, 9)), "r", "c", "trend", f"{tmp_path}/m.{kind}")
        assert (tmp_path / f"m.{kind}").read_bytes()[:4] == (b"\x89PNG" if kind == "png" else b"<svg")
    with pytest.raises(ValueError):
        images.write_map(df, "r", "c", "y", f"{tmp_path}/m.bmp")
    made = splines.Surface(np.arange(6.0), np.arange(6.0), (4, 4))
    fixed, blocks = made.at(np.arange(6.0), np.arange(6.0))
    assert blocks["row_col"].shape == (6, 25) and np.abs(fixed.mean(axis=0)).max() < 1e-12


def test_structures_by_their_definitions(spark):
    pos = np.array([[0.0, 0.0], [1.0, 0.5], [2.0, -1.0]])
    options = structures.matern_options({"nu": "1.5 F", "delta": "2", "alpha": "0.4", "lambda": "1"})
    assert structures.n_level("mtrn", 3, 3) == 3
    r = structures.correlation(np.array([0.3, np.log(2.0), 0.4]), "mtrn", pos, 3, options)
    d = pos[1] - pos[0]
    u, v = d @ [np.cos(0.4), np.sin(0.4)], d @ [-np.sin(0.4), np.cos(0.4)]
    assert r[0, 1] == pytest.approx(float(matern(np.array((np.sqrt(2) * abs(u) + abs(v) / np.sqrt(2)) / np.exp(0.3)), 1.5)))
    assert structures.reported(np.array([0.3, np.log(2.0), 0.4]), "mtrn", 3, 3, options) == pytest.approx({"phi": np.exp(0.3), "delta": 2.0, "alpha": 0.4})
    assert structures.reported(np.array([0.2]), "cor", 5)["phi"] == pytest.approx(structures.correlation(np.array([0.2]), "cor", np.zeros((5, 1)))[0, 1])
    phi = structures.reported(np.array([0.6]), "sar")["phi"]
    assert structures.correlation(np.array([0.6]), "sar", np.arange(4.0)[:, None])[0, 1] == pytest.approx(phi / (1 + phi * phi / 4))
    half = structures.own("0.5*I + 0.5*J", np.zeros(0), pos)
    assert half == pytest.approx(0.5 * np.eye(3) + 0.5)
    assert structures.own("where(d < 2, 1 - (d/2)^2, 0) + 0.1*I", np.zeros(0), pos) == pytest.approx(structures.own("where(d < 2, 1 - (d/2)^2, 0) + 0.1*I", np.zeros(0), pos).T)
    with pytest.raises(ValueError):
        structures.correlation(np.array([0.0]), "lvr", pos)
    lam, psi = structures.loadings(np.array([0.5, -0.2, 0.3, 0.1, 0.2, 0.3]), "fa", 3)
    assert lam @ lam.T + np.diag(psi) == pytest.approx(structures.sigma(np.array([0.5, -0.2, 0.3, 0.1, 0.2, 0.3]), "fa", 3))


def test_wrong_models_are_refused(spark):
    for wrong in ("~ vm(g, K, junk)", "~ ar1(r, c, d)", "~ us(g, nseg=3)", "~ mtrn(x, nu='a F')", "~ iid()"):
        with pytest.raises(ValueError):
            parse_random(wrong)
    df = spark.createDataFrame([(float(i % 5), float(i), 2.0 * i, i % 3) for i in range(30)], "y double, x double, z double, g int")
    with pytest.raises(ValueError, match="rank"):
        reml.build(df, "y ~ x + z", "~ g")
    gaps = spark.createDataFrame([(float(i), 0.5 * i if i != 3 else 1.7) for i in range(8)], "y double, p double")
    with pytest.raises(ValueError, match="lattice"):
        reml.build(gaps, "y ~ 1", "~ ar1(p)")
    half = reml.build(gaps.where("y <> 3"), "y ~ 1", "~ ar1(p)")
    assert half.random[0].q == 8 and half.random[0].labels[3] == 1.5


def test_large_means_keep_their_precision(spark):
    rng = np.random.default_rng(22)
    g = np.repeat(np.arange(8), 5)
    y = rng.normal(size=8)[g] + rng.normal(size=40)
    a, b = (reml.reml(spark.createDataFrame(pd.DataFrame({"y": y + c, "g": g})), "y ~ 1", "~ g", fixed_theta=np.array([0.0, 0.1])) for c in (0.0, 1e9))
    assert a.neg2 == pytest.approx(b.neg2, abs=1e-4) and b.estimates[0] - 1e9 == pytest.approx(a.estimates[0], abs=1e-5)


def test_design_at_scale_equals_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(24)
    doses = rng.integers(0, 3, (40, 23)).astype(float)
    doses[5] = doses[6] = np.nan_to_num(doses[5])
    long = spark.createDataFrame([(i, j, float(doses[j, i])) for j in range(40) for i in range(23) if (i * j) % 17 != 3], "snp int, gen int, dose double")
    whole = {(r["i"], r["j"]): r["k"] for r in design.grm(long).collect()}
    monkeypatch.setattr(design, "TILE", 5)
    monkeypatch.setattr(design, "CHUNK", 7)
    assert {(r["i"], r["j"]): r["k"] for r in design.grm(long).collect()} == pytest.approx(whole) and len(whole) == 40 * 41 // 2
    near = {(r["a"], r["b"]): r["r2"] for r in design.ld_pairs(long, 5).collect()}
    monkeypatch.setattr(design, "RUN", 4)
    assert {(r["a"], r["b"]): r["r2"] for r in design.ld_pairs(long, 5).collect()} == pytest.approx(near) and max(b - a for a, b in near) == 5
    levels = design.level_table(long, "snp")
    parts = design.level_table(long, "snp", rows=6)
    assert sorted(map(tuple, levels.collect())) == sorted(map(tuple, parts.collect())) == [(i, i) for i in range(23)]
    values = spark.createDataFrame([(float(v),) for v in rng.normal(size=1001)] + [(None,)], "v double")
    assert scans.exact_median(values, "v").first()[0] == pytest.approx(np.median([r[0] for r in values.collect()[:-1]]))


def test_nearest_positive_definite_matrix():
    a = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    near = genome.nearest_pd(a)
    values, vectors = np.linalg.eigh(a)
    assert np.linalg.eigvalsh(near).min() > 0 and np.linalg.norm(near - a) == pytest.approx(np.linalg.norm((vectors * np.maximum(values, 0)) @ vectors.T - a), rel=1e-3)


def test_neighbour_scan(spark):
    rng = np.random.default_rng(26)
    n, loci = 36, 30
    m = rng.choice([-1.0, 1.0], size=(n, loci))
    at = [(i // 6, i % 6) for i in range(n)]
    units = spark.createDataFrame([(0, i, float(r), float(c)) for i, (r, c) in enumerate(at)], "block int, id int, r double, c double")
    df = spark.createDataFrame([(i, float(0.7 * m[i, 2] + rng.normal())) for i in range(n)], "id int, y double")
    markers = spark.createDataFrame([(k, m[:, k].tolist()) for k in range(loci)], "snp long, dose array<double>")
    got = genome.neighbour_gwas(df, ["y"], "id", markers, design.neighbour_weights(units))
    rows = {r["snp"]: r for r in got["scan_self"].collect()}
    assert len(rows) == loci and max(rows, key=lambda k: rows[k]["chi2_1"]) == 2
    assert got["scan"].where("chi2_1 is not null").count() == loci
    (share,) = got["shares"].collect()
    assert share["self"] + share["neighbour"] + share["residual"] == pytest.approx(1)
    k1 = ((loci - 1) / 2 + m @ m.T / 2) / (loci - 1)
    assert got["K1"] == pytest.approx(genome.nearest_pd(k1), abs=1e-6)


def test_workers_need_no_path(tmp_path):
    """A scan from a folder of its own, without the package on the workers' path."""
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(Path(reml.__file__).parents[2])!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        from varispark.operators import genome, reml
        df = spark.createDataFrame([(float(i % 7), f"g{{i % 4}}") for i in range(40)], "y double, g string")
        loci = spark.createDataFrame([(0, [0.0, 1.0, 2.0, 1.0])], "snp long, dose array<double>")
        print(genome.scan(reml.reml(df, "y ~ 1", "~ g"), loci, ["g"]).count())
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.stdout.strip().endswith("1"), done.stderr[-2000:]


def test_scan_files_and_thresholds(spark, two, tmp_path):
    _, _, markers, fit = two
    genome.write_scan(genome.scan_tests(fit, markers, {"dir": "us(g)"}, ["dir"]), str(tmp_path), ["dir"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/scan").count() == 9
    assert '"n_snp": 9' in spark.read.text(f"{tmp_path}/meta").first()[0]
    assert F and inference


def test_likelihoods_from_the_covariance_of_rows(two, spark):
    pdf, _, _, fit = two
    whole = reml.fit(fit.model, engine="dense")
    assert whole.neg2 == pytest.approx(fit.neg2, abs=1e-5) and whole.solution == pytest.approx(fit.solution, abs=1e-3)
    theta = fit.theta + 0.1
    a, b = (reml.fit(fit.model, fixed_theta=theta, engine=k) for k in ("mme", "dense"))
    assert a.neg2 == pytest.approx(b.neg2, abs=1e-6) and a.solution == pytest.approx(b.solution, abs=1e-6) and a.cinv == pytest.approx(b.cinv, abs=1e-7)
    assert b.likelihood.value_and_gradient(theta)[1] == pytest.approx(a.likelihood.value_and_gradient(theta)[1], abs=1e-4)
    assert b.likelihood.average_information(theta) == pytest.approx(a.likelihood.average_information(theta), rel=1e-4, abs=1e-5)
    df = spark.createDataFrame(pdf)
    reduced = reml.reml(df, "y ~ trait", "~ rr(g)", "~ diag(trait):units", trait="trait", unit="u")
    s = structures.sigma(reduced.theta[:2], "rr", 2)
    assert np.linalg.matrix_rank(s) == 1 and reduced.converged
    with pytest.raises(ValueError):
        reml.fit(reduced.model, engine="mme")


def test_models_without_a_residual(spark):
    rng = np.random.default_rng(30)
    pos = np.sort(rng.random(25) * 10)
    y = np.linalg.cholesky(np.exp(-np.abs(pos[:, None] - pos[None, :])) + 1e-9 * np.eye(25)) @ rng.normal(size=25)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": pos}))
    fit = reml.reml(df, "y ~ 1", "~ exp(p)", "~ none")
    v = np.exp(2 * fit.theta[0]) * structures.correlation(fit.theta[1:], "exp", pos[:, None])
    assert fit.converged and len(fit.theta) == 2 and fit.neg2 == pytest.approx(reml.dense_neg2(y, np.ones((25, 1)), v), abs=1e-6)
    assert fit.blups().count() == 25 and "residual" not in fit.components()


def test_inverses_by_blocks_equal_plain_ones(spark):
    rng = np.random.default_rng(33)
    n = 500
    a, b = rng.integers(0, 30, n), rng.integers(0, 200, n)
    w = np.zeros((n, 233))
    w[:, :3] = rng.normal(size=(n, 3))
    w[np.arange(n), 3 + a], w[np.arange(n), 33 + b] = 1, 1
    c = w.T @ w + 0.5 * np.eye(233)
    i, j = np.nonzero(c - np.diag(np.diag(c)))
    split = bordered.search(233, [np.arange(3), np.arange(3, 33), np.arange(33, 233)], i, j)
    assert len(split.border) == 33 and split.blocks == 200
    inv, logdet = bordered.inverse(c, split)
    assert inv == pytest.approx(np.linalg.inv(c), abs=1e-10) and logdet == pytest.approx(np.linalg.slogdet(c)[1])
    with pytest.raises(np.linalg.LinAlgError):
        bordered.inverse(c - 3 * np.eye(233), split)
    nested = rng.integers(0, 20, n)
    pdf = pd.DataFrame({"y": rng.normal(size=20)[nested] + rng.normal(size=n), "s": nested, "g": [f"{s}-{k}" for s, k in zip(nested, rng.integers(0, 6, n))]})
    fit = reml.reml(spark.createDataFrame(pdf), "y ~ 1", "~ s + g", fixed_theta=np.array([0.1, -0.5, 0.2]))
    assert fit.likelihood.split().blocks >= 20
    c, _, _, _ = fit.likelihood.equations(fit.theta)
    assert fit.cinv == pytest.approx(np.linalg.inv(c), abs=1e-9)
    plain = reml.Likelihood(fit.model)
    plain._split = None
    assert plain.value_and_gradient(fit.theta)[1] == pytest.approx(fit.likelihood.value_and_gradient(fit.theta)[1], abs=1e-6)


def test_saved_projections_scan_alike(two, spark, tmp_path):
    _, _, markers, fit = two
    genome.save_projection(fit, {"dir": "us(g)"}, str(tmp_path))
    tests = ["dir", "dir@het"]
    one, other = ([tuple(r) for r in genome.scan_tests(x, markers, {"dir": "us(g)"}, tests).orderBy("snp").collect()] for x in (fit, genome.load_projection(spark, str(tmp_path))))
    assert one == other
