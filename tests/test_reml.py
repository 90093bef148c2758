"""The engine from cross-products agrees with dense formulas."""

import numpy as np
import pandas as pd
import pytest

from varispark.functions import structures
from varispark.operators import design, oneway, reml


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(1)
    n, q = 160, 9
    g, b, x = rng.integers(0, q, n), rng.integers(0, 3, n), rng.normal(size=n)
    y = 1 + 0.5 * x + (b == 2) * 0.7 + rng.normal(size=q)[g] + rng.normal(size=n) * 0.8
    pdf = pd.DataFrame({"y": y, "g": [f"g{v}" for v in g], "b": [f"b{v}" for v in b], "x": x, "pos": g, "w": rng.integers(1, 4, n).astype(float)})
    fixed = np.column_stack([np.ones(n), b == 1, b == 2, x]).astype(float)
    return spark.createDataFrame(pdf), pdf, fixed, np.eye(q)[g]


def test_one_factor(field):
    df, pdf, x, z = field
    f = reml.reml(df, "y ~ b + x", "~ g")
    s, e = np.exp(2 * f.theta)
    v = s * z @ z.T + e * np.eye(len(pdf))
    y = pdf["y"].to_numpy()
    assert f.converged and f.neg2 == pytest.approx(reml.dense_neg2(y, x, v), abs=1e-8)
    vi = np.linalg.inv(v)
    beta = np.linalg.solve(x.T @ vi @ x, x.T @ vi @ y)
    assert np.allclose([r["estimate"] for r in f.fixed().collect()], beta)
    u = s * z.T @ vi @ (y - x @ beta)
    assert np.allclose([r["blup"] for r in f.blups().collect()], u, atol=1e-8)
    ed = f.dimensions().first()
    assert 0 < ed["ed"] < ed["q"]
    assert f.vpredict("V1/(V1+V2)")[0] == pytest.approx(s / (s + e))
    with pytest.raises(ValueError):
        f.vpredict("__import__('os')")
    assert reml.fitted(f, df).count() == len(pdf)
    assert f.predict("b").count() == 3 and f.wald().count() == 3 and f.varcomp().count() == 2


def test_weights_and_levels(field):
    df, pdf, x, z = field
    f = reml.reml(df, "y ~ b + x", "~ ar1(pos)", weights="w")
    k = structures.correlation(f.theta[1:2], "ar1", np.arange(z.shape[1]))
    v = np.exp(2 * f.theta[0]) * z @ k @ z.T + np.exp(2 * f.theta[2]) * np.diag(1 / pdf["w"].to_numpy())
    assert f.neg2 == pytest.approx(reml.dense_neg2(pdf["y"].to_numpy(), x, v), abs=1e-5)


def test_relationship(field):
    df, pdf, x, z = field
    names = sorted(pdf["g"].unique())
    k = pd.DataFrame(0.3 + 0.7 * np.eye(len(names)), index=names, columns=names)
    f = reml.reml(df, "y ~ b + x", "~ vm(g, K)", matrices={"K": k})
    v = np.exp(2 * f.theta[0]) * z @ k.to_numpy() @ z.T + np.exp(2 * f.theta[1]) * np.eye(len(pdf))
    assert f.neg2 == pytest.approx(reml.dense_neg2(pdf["y"].to_numpy(), x, v), abs=1e-8)


def test_two_traits_with_missing_records(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"t{t}", f"g{i % 6}", i % 6, t, float(rng.normal() + t + (i % 6) / 3)) for i in range(48) for t in range(2) if not (i % 7 == 0 and t)]
    pdf = pd.DataFrame(rows, columns=["unit", "trait", "g", "gi", "ti", "y"])
    f = reml.reml(spark.createDataFrame(pdf), "y ~ 0 + trait", "~ diag(g)", "~ us(trait):units", trait="trait", unit="unit")
    sg, sr = structures.sigma(f.theta[:2], "diag", 2), structures.sigma(f.theta[2:], "us", 2)
    t, g, u = pdf["ti"].to_numpy(), pdf["gi"].to_numpy(), pdf["unit"].to_numpy()
    v = sg[np.ix_(t, t)] * (g[:, None] == g) + sr[np.ix_(t, t)] * (u[:, None] == u)
    assert f.neg2 == pytest.approx(reml.dense_neg2(pdf["y"].to_numpy(), np.eye(2)[t], v), abs=1e-8)


def test_sections(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame([(f"e{i % 2}", f"g{i % 5}", float(rng.normal() * (1 + i % 2) + i % 5)) for i in range(60)], columns=["env", "g", "y"])
    f = reml.reml(spark.createDataFrame(pdf), "y ~ env", "~ g", "~ dsum(~ units | env)")
    e = pdf["env"].to_numpy() == "e1"
    z = np.eye(5)[np.arange(60) % 5]
    v = np.exp(2 * f.theta[0]) * z @ z.T + np.diag(np.where(e, np.exp(2 * f.theta[2]), np.exp(2 * f.theta[1])))
    assert f.neg2 == pytest.approx(reml.dense_neg2(pdf["y"].to_numpy(), np.column_stack([np.ones(60), e]).astype(float), v), abs=1e-8)


def test_grouped_statistics_agree(field, spark):
    df, pdf, _, z = field
    from pyspark.sql import functions as F

    got = oneway.neg2_loglik(oneway.group_stats(df, "g", F.col("y")), 0.5, 0.7).first()["neg2"]
    v = 0.5 * z @ z.T + 0.7 * np.eye(len(pdf))
    n = len(pdf)
    assert got == pytest.approx(reml.dense_neg2(pdf["y"].to_numpy(), np.ones((n, 1)), v) + (n - 1) * np.log(2 * np.pi), abs=1e-8)


def test_ld_prune_drops_copies(spark):
    rows = [(s, g, float((g * (1 if s < 3 else 7) + (s == 2) * g) % 3)) for s in (0, 1, 4) for g in range(12)]
    df = spark.createDataFrame(rows, "snp int, gen int, dose double")
    assert sorted(r["snp"] for r in design.ld_prune(df, 0.9, 5).collect()) == [0] or design.ld_prune(df, 0.9, 5).count() <= 2


def test_gradient_is_that_of_the_value(field, spark):
    from varispark.functions import optimise

    df = field[0]
    for random in ("~ g", "~ ar1(pos)", "~ g + exp(pos)"):
        like = reml.Likelihood(reml.build(df, "y ~ b + x", random))
        theta = like.start() + 0.1
        assert np.allclose(like.value_and_gradient(theta)[1], optimise.gradient(like, theta), atol=1e-4)


def test_small_residual_beside_large_effects(spark):
    """Balanced cells of two traits: the matrix of residual mean squares, though the likelihood's value has few digits of it."""
    rng = np.random.default_rng(7)
    q, k = 10, 7
    g, e = rng.normal(0, 0.4, (q, 1, 2)), rng.normal(0, 1, (q, k, 2)) * [2e-3, 3e-2]
    y = 5 + g + e
    rows = [(f"{i}:{j}", i, t, float(y[i, j, n])) for i in range(q) for j in range(k) for n, t in enumerate("ab")]
    fit = reml.reml(spark.createDataFrame(rows, "u string, g int, trait string, y double"), "y ~ trait", "~ us(g)", "~ us(trait):units", trait="trait", unit="u")
    left = (y - y.mean(axis=1, keepdims=True)).reshape(-1, 2)
    want = left.T @ left / (q * (k - 1))
    got = structures.sigma(fit.theta[3:], "us", 2)
    assert fit.converged and got == pytest.approx(want, rel=1e-5)


def test_sums_of_units_in_one_job(spark, monkeypatch):
    """Three traits with gaps, weights and sections: likelihood from one job of sums, of rows whose repeats are refused."""
    rng = np.random.default_rng(8)
    rows = [(u, f"t{t}", f"s{u % 2}", u % 5, float(rng.normal()), float(rng.uniform(0.5, 2))) for u in range(60) for t in range(3) if rng.random() < 0.7]
    names = "u long, trait string, sec string, g int, y double, w double"
    calls, real = [], reml._unit_sums
    monkeypatch.setattr(reml, "_unit_sums", lambda *a: calls.append(1) or real(*a))
    model = reml.build(spark.createDataFrame(rows, names), "y ~ trait", "~ us(g)", "~ dsum(~ us(trait):units | sec)", trait="trait", unit="u", weights="w")
    assert calls and model.n == len(rows) and model.log_weights == pytest.approx(sum(np.log(r[5]) for r in rows))
    y, centre = np.array([r[4] for r in rows]), np.mean([r[4] for r in rows])
    x = np.column_stack([np.ones(len(rows)), *[[float(r[1] == f"t{k}") for r in rows] for k in (1, 2)]])
    theta = rng.normal(0, 0.3, 18)
    g, r0, r1 = (structures.sigma(theta[k : k + 6], "us", 3) for k in (0, 6, 12))
    v = np.array([[(g[int(a[1][1]), int(b[1][1])] if a[3] == b[3] else 0) + ((r0, r1)[a[0] % 2][int(a[1][1]), int(b[1][1])] / np.sqrt(a[5] * b[5]) if a[0] == b[0] else 0) for b in rows] for a in rows])
    assert reml.Likelihood(model)(theta) == pytest.approx(reml.dense_neg2(y - centre, x, v), rel=1e-8)
    with pytest.raises(ValueError, match="two records"):
        reml.build(spark.createDataFrame(rows + rows[:1], names), "y ~ trait", "~ us(g)", "~ us(trait):units", trait="trait", unit="u")


def test_absorbed_sums(spark):
    """Sums of absorbed levels and their products by numbers of rows, from a table that is written once, equal those of the rows."""
    rng = np.random.default_rng(9)
    rows = [(f"p{rng.integers(12)}", int(rng.integers(4)), float(rng.integers(3)), float(rng.normal())) for _ in range(90)]
    model = reml.build(spark.createDataFrame(rows, "p string, g int, x double, y double").repartition(5), "y ~ x", "~ p + g", absorb="p")
    assert "Exchange" not in model.absorbed.levels._jdf.queryExecution().executedPlan().toString()
    centre = np.mean([r[3] for r in rows])
    w = {p: np.array([[1.0, r[2], *[float(r[1] == k) for k in range(4)], r[3] - centre] for r in rows if r[0] == p]) for p in {r[0] for r in rows}}
    got = {r["level"]: (r["n"], {e["c"]: e["x"] for e in r["e"]}) for r in model.absorbed.levels.collect()}
    assert set(got) == set(w)
    for p, (n, e) in got.items():
        assert n == len(w[p]) and [e.get(c, 0.0) for c in range(7)] == pytest.approx(w[p].sum(axis=0), abs=1e-12)
    for n, (count, sums) in model.absorbed.by_n.items():
        mine = [v.sum(axis=0) for v in w.values() if len(v) == n]
        assert count == len(mine) and sums.dense() == pytest.approx(sum(np.outer(v, v) for v in mine), abs=1e-12)


@pytest.mark.parametrize("shrunk, swapped", [(60, False), (60, True), (3600, False)])
def test_residuals_far_below_the_other_variances(spark, shrunk, swapped):
    """Means of many rows: the likelihood lost the digits of its descent, which ended far from the estimates' closed form."""
    rng = np.random.default_rng(7)
    g, sd = np.repeat(np.arange(10), 7), np.array([0.0024, 0.033]) / np.sqrt(shrunk)
    y = np.column_stack([0.5 + 0.3 * (g % 3), 3.0 + 0.2 * g]) + rng.normal(size=(70, 2)) * sd
    y = y[:, ::-1] if swapped else y
    means = np.array([y[g == k].mean(axis=0) for k in range(10)])
    within = (y - means[g]).T @ (y - means[g]) / 60
    between = np.cov(means.T) - within / 7
    df = spark.createDataFrame([(f"{i}", int(g[i]), t, float(y[i, k])) for i in range(70) for k, t in enumerate("ab")], "u string, g int, trait string, y double").coalesce(1)
    f = reml.reml(df, "y ~ trait", "~ us(g)", "~ us(trait):units", trait="trait", unit="u")
    got = [structures.sigma(f.theta[k : k + 3], "us", 2) for k in (0, 3)]
    correlation = lambda s: s[0, 1] / np.sqrt(s[0, 0] * s[1, 1])
    assert f.converged
    for s, want in zip(got, (between, within)):
        assert np.diag(s) == pytest.approx(np.diag(want), rel=1e-4) and correlation(s) == pytest.approx(correlation(want), abs=1e-4)
