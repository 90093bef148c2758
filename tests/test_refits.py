"""Refits by batches against fits one by one."""

import time

import numpy as np
import pandas as pd
import pytest

from varispark.operators import genome, refits, reml
from varispark.plans.hypotheses import parse_test


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(4)
    q = 12
    rows = [(u, t, f"g{u % q:02}", float(rng.normal(5, 1)), float(rng.normal() + ((u % q) * 0.2 if t == "b" else np.sin(3.0 * (u % q))))) for u in range(150) for t in "ab" if rng.random() < 0.9]
    k = pd.DataFrame(0.5 ** np.abs(np.subtract.outer(np.arange(q), np.arange(q))), index=[f"g{i:02}" for i in range(q)], columns=[f"g{i:02}" for i in range(q)])
    df = spark.createDataFrame(rows, "u long, t string, g string, x double, y double")
    doses = rng.choice([0.0, 1.0, 2.0], (40, q))
    doses[3] = 1.0  # constant: no information
    doses[4] = doses[5]
    markers = spark.createDataFrame([(i, d.tolist()) for i, d in enumerate(doses)], "snp long, dose array<double>").repartition(2)
    return reml.reml(df, "y ~ t + x", "~ us(g, K=K)", "~ us(t):units", trait="t", unit="u", matrices={"K": k}), markers, doses


@pytest.mark.parametrize("test", ["dir", "dir@het"])
def test_batches_equal_single_fits(model, test):
    fit, markers, _ = model
    together = {r["snp"]: r for r in genome.refit(fit, markers, {"dir": "us(g, K=K)"}, test).collect()}
    columns, hypothesis, _ = parse_test(test, ["a", "b"])
    at = genome.blocks(fit.model, "us(g, K=K)")
    for snp in (0, 1, 5, 17):
        dose = np.asarray(model[2][snp])
        w = np.zeros((fit.model.m, len(columns)))
        for j, col in enumerate(columns):
            for (_, k), x in col.items():
                w[at[k], j] += x * dose
        one = reml.fit(genome.with_columns(fit.model, w, [f"l{j}" for j in range(len(columns))]), theta=fit.theta, fixed_theta=np.where(fit.free, np.nan, fit.theta))
        b, v = one.solution[fit.model.p : fit.model.p + len(columns)], one.cinv[fit.model.p : fit.model.p + len(columns)][:, fit.model.p : fit.model.p + len(columns)]
        lb, lv = hypothesis @ b, hypothesis @ v @ hypothesis.T
        r = together[snp]
        assert r["converged"] and one.neg2 - 1e-3 < r["neg2"] < one.neg2 + 1e-5
        assert r["chi2"] == pytest.approx(float(lb @ np.linalg.solve(lv, lb)), rel=5e-3, abs=1e-4)
    assert together[3]["converged"] is False and together[4]["chi2"] == pytest.approx(together[5]["chi2"])


def test_gradient_of_the_stacked_equations(model):
    fit, _, doses = model
    at = genome.blocks(fit.model, "us(g, K=K)")
    w = np.zeros((3, fit.model.m, 2))
    for i in range(3):
        for k in range(2):
            w[i, at[k], k] = doses[i]
    batch = refits.Batch(fit.likelihood, w)
    rng = np.random.default_rng(5)
    theta, which = np.stack([fit.theta + 0.1 * rng.normal(size=len(fit.theta)) for _ in range(3)]), np.arange(3)
    value, grad, _, _ = batch.evaluate(theta, which)
    for i in range(3):
        like = reml.Likelihood(genome.with_columns(fit.model, w[i], ["a", "b"]))
        v, g = like.value_and_gradient(theta[i])
        assert value[i] == pytest.approx(v) and grad[i] == pytest.approx(g, rel=1e-5, abs=1e-5)


def test_many_loci_a_second(model):
    fit, _, _ = model
    rng = np.random.default_rng(6)
    at = genome.blocks(fit.model, "us(g, K=K)")
    w = np.zeros((300, fit.model.m, 2))
    for k in range(2):
        w[:, at[k], k] = rng.normal(size=(300, at[k].stop - at[k].start))
    began = time.time()
    _, value, done, _, _ = refits.fit(fit.likelihood, fit.theta, fit.free, w)
    assert done.mean() > 0.9 and np.isfinite(value).all() and 300 / (time.time() - began) > 10
