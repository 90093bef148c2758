"""Small-sample tests, ratios, lags and posteriors against dense formulas and known distributions."""

import numpy as np
import pandas as pd
import pytest

from varispark.operators import bayes, inference, lag, reml


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(11)
    b, t = map(np.ravel, np.meshgrid(np.arange(8), np.arange(4), indexing="ij"))
    y = 5 + np.array([0, 0.5, 1, 0.2])[t] + rng.normal(size=8)[b] + rng.normal(size=32) * 0.7
    pdf = pd.DataFrame({"y": y, "b": [f"b{v}" for v in b], "t": [f"t{v}" for v in t]})
    return spark.createDataFrame(pdf), pdf


def test_kenward_roger_of_a_balanced_design_is_the_analysis_of_variance(blocks):
    df, pdf = blocks
    f = reml.reml(df, "y ~ t", "~ b")
    got = {r["term"]: r for r in inference.kenward_roger(f).collect()}["t"]
    y = pdf["y"].to_numpy().reshape(8, 4)
    mt = 8 * ((y.mean(0) - y.mean()) ** 2).sum() / 3
    e = ((y - y.mean(0) - y.mean(1)[:, None] + y.mean()) ** 2).sum() / 21
    assert got["df1"] == 3 and got["df2"] == pytest.approx(21, rel=1e-3) and got["f"] == pytest.approx(mt / e, rel=1e-3)


def test_ratios_and_comparisons(blocks):
    df, _ = blocks
    f = reml.reml(df, "y ~ t", "~ b")
    rows = {(r["quantity"], r["component"]): r for r in inference.ratios(f).collect()}
    v = f.components()
    assert rows["share", "b"]["estimate"] == pytest.approx(v["b"] / (v["b"] + v["residual"]))
    assert rows["share", "b"]["se"] == pytest.approx(f.vpredict("V1/(V1+V2)")[1], rel=1e-4)
    less = reml.reml(df, "y ~ t")
    lrt, p = inference.likelihood_ratio(f, less)
    assert lrt == pytest.approx(less.neg2 - f.neg2) and 0 < p < 0.5
    s = inference.summary(f).first()
    assert s["n"] == 32 and s["rank"] == 4 and s["n_par"] == 2 and s["pd_hessian"]
    row = np.zeros(f.model.m)
    row[0] = 1
    other = row.copy()
    other[1] = 1
    d = inference.differences(f, {"t0": row, "t1": other}).first()
    assert d["difference"] == pytest.approx(-f.solution[1]) and d["sed"] == pytest.approx(np.sqrt(f.cinv[1, 1]))
    assert inference.estimable(f, row)


def test_lag_equals_dense(spark):
    rng = np.random.default_rng(2)
    w = np.zeros((30, 30))
    for b in range(3):
        for i in range(10):
            for j in (i - 1, i + 1):
                if 0 <= j < 10:
                    w[b * 10 + i, b * 10 + j] = 0.5
    g, x = rng.integers(0, 5, 30), rng.normal(size=30)
    y = np.linalg.solve(np.eye(30) - 0.4 * w, 1 + x + rng.normal(size=5)[g] + rng.normal(size=30) * 0.6)
    df = spark.createDataFrame(pd.DataFrame({"id": range(30), "y": y, "x": x, "g": [f"g{v}" for v in g]}))
    edges = spark.createDataFrame([(int(i) // 10, int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "block int, src long, dst long, w double")
    assert lag.log_jacobian(edges, [0.3])[0.3] == pytest.approx(np.linalg.slogdet(np.eye(30) - 0.3 * w)[1])
    model = lag.build(df, "id", edges, "y ~ x", "~ g")
    fixed, design, z = lag.at(model, 0.25), np.column_stack([np.ones(30), x]), np.eye(5)[g]
    theta = np.log([0.8, 0.6])
    v = 0.64 * z @ z.T + 0.36 * np.eye(30)
    assert reml.Likelihood(fixed)(theta) == pytest.approx(reml.dense_neg2((np.eye(30) - 0.25 * w) @ y, design, v), abs=1e-8)
    psi, fit, profile = lag.fit(model, edges, steps=9, rounds=2)
    assert -0.9 <= psi <= 0.9 and fit.converged and min(profile, key=lambda r: r[1])[0] == psi
    with pytest.raises(ValueError):
        lag.build(df.selectExpr("id", "case when id > 3 then y end as y", "x", "g"), "id", edges, "y ~ x", "~ g")


def test_posterior(blocks):
    df, _ = blocks
    f = reml.reml(df, "y ~ t", "~ b")
    what = bayes.kinds(f.likelihood)
    assert what == ["sd", "sd"]
    theta = np.array([0.3, -0.2, 0.7])
    _, grad = bayes.log_prior(theta, ["sd", "cor", "free"], 1.5, theta * 0)
    h = 1e-6
    for k in range(3):
        e = np.eye(3)[k] * h
        up, down = (bayes.log_prior(theta + s * e, ["sd", "cor", "free"], 1.5, theta * 0)[0] for s in (1, -1))
        assert grad[k] == pytest.approx((up - down) / (2 * h), abs=1e-6)
    draws = bayes.sample(f, chains=2, warmup=150, draws=300).cache()
    got = {r["parameter"]: r for r in bayes.summarise(draws).collect()}
    assert all(r["rhat"] < 1.1 and 0.5 < r["accepted"] <= 1 for r in got.values())
    # the posterior of the residual's parameter by quadrature
    u = bayes.potential(f.likelihood, 2 * max(np.exp(f.theta)), f.theta)
    a, b = np.meshgrid(np.linspace(-4, 2.5, 90), np.linspace(-1.2, 0.6, 60), indexing="ij")
    dens = np.array([-u(np.array(t))[0] for t in zip(a.ravel(), b.ravel())]).reshape(a.shape)
    dens = np.exp(dens - dens.max())
    assert got[1]["mean"] == pytest.approx(float((dens * b).sum() / dens.sum()), abs=0.05)


def test_pruning(spark):
    from varispark.operators import design

    rng = np.random.default_rng(4)
    m = rng.integers(0, 3, (12, 40)).astype(float)
    m[3], m[4], m[9], m[11] = m[2], 1.0, 2 - m[0], m[0]  # a copy, one without variation, a turned copy far off, a copy elsewhere
    rows = [(k, f"i{j}", float(v), int(k > 9)) for k, x in enumerate(m) for j, v in enumerate(x)]
    markers = spark.createDataFrame(rows, "snp long, gen string, dose double, chr int")
    z = [(x - x.mean()) / (x.std() or np.nan) / np.sqrt(40) for x in m]

    def brute(limit, window, duplicates):
        kept = []
        for c in (0, 1):
            places = [k for k in range(12) if (k > 9) == c and np.isfinite(z[k]).all()]
            mine = []
            for at, k in enumerate(places):
                if not any((z[k] @ z[j]) ** 2 >= limit - 1e-12 for j in mine if at - places.index(j) <= window):
                    mine.append(k)
            kept += mine
        return [k for i, k in enumerate(kept) if not duplicates or not any(abs(z[k] @ z[j]) > 1 - 1e-9 for j in kept[:i])]

    for args in ((0.8, 3, True), (0.8, 3, False), (0.05, 4, True)):
        assert sorted(r[0] for r in design.ld_prune(markers, *args).collect()) == brute(*args)
