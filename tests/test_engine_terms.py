"""Terms beyond single factors, and residuals on lattices, against dense covariance matrices."""

import numpy as np
import pandas as pd
import pytest

from varispark.functions import splines, structures
from varispark.operators import reml


def ar1(q, rho):
    return rho ** np.abs(np.subtract.outer(np.arange(q), np.arange(q)))


@pytest.fixture(scope="module")
def plot(spark):
    rng = np.random.default_rng(3)
    r, c = map(np.ravel, np.meshgrid(np.arange(7), np.arange(5), indexing="ij"))
    noise = np.linalg.cholesky(np.kron(ar1(7, 0.6), ar1(5, 0.4))) @ rng.normal(size=35)
    pdf = pd.DataFrame({"r": r * 2 + 1, "c": c, "x": rng.normal(size=35), "g": [f"g{v}" for v in rng.integers(0, 6, 35)]})
    pdf["y"] = 3 + pdf["x"] + noise
    keep = np.delete(np.arange(35), [4, 11, 12, 30])
    return spark.createDataFrame(pdf.iloc[keep]), pdf.iloc[keep], keep


def test_lattice_residual_with_empty_cells(plot):
    df, pdf, keep = plot
    f = reml.reml(df, "y ~ x", "~ g", "~ ar1(r):ar1(c)")
    s, e, rr, rc = np.exp(2 * f.theta[0]), np.exp(2 * f.theta[1]), *np.tanh(f.theta[2:])
    z = pd.get_dummies(pdf["g"]).to_numpy(float)
    dense = lambda s, e, rr, rc: reml.dense_neg2(pdf["y"].to_numpy(), np.column_stack([np.ones(len(pdf)), pdf["x"]]), s * z @ z.T + e * np.kron(ar1(7, rr), ar1(5, rc))[np.ix_(keep, keep)])
    assert f.neg2 == pytest.approx(dense(s, e, rr, rc), abs=1e-6) and f.converged and f.rank == 2
    for k in range(1, 4):
        for d in (-0.05, 0.05):
            t = f.theta.copy()
            t[k] += d
            assert dense(np.exp(2 * t[0]), np.exp(2 * t[1]), *np.tanh(t[2:])) > f.neg2 - 1e-7
    assert list(f.components()) == ["g", "residual", "residual.r", "residual.c"]
    one = reml.reml(df, "y ~ x", None, "~ id(r):ar1(c)")
    k = np.kron(np.eye(7), ar1(5, np.tanh(one.theta[1])))[np.ix_(keep, keep)]
    assert one.neg2 == pytest.approx(reml.dense_neg2(pdf["y"].to_numpy(), np.column_stack([np.ones(len(pdf)), pdf["x"]]), np.exp(2 * one.theta[0]) * k), abs=1e-6)
    with pytest.raises(ValueError):
        reml.build(df.unionByName(df), "y ~ x", None, "~ ar1(r):ar1(c)")
    with pytest.raises(ValueError):
        reml.build(df, "y ~ x", None, "~ ar9(r):units")


def test_sections_of_lattices(spark, plot):
    df, pdf, keep = plot
    from pyspark.sql import functions as F

    both = df.withColumn("s", F.lit("a")).unionByName(df.withColumn("y", F.col("y") * 2).where("c > 0").withColumn("s", F.lit("b")))
    f = reml.reml(both, "y ~ s + x", None, "~ dsum(~ ar1(r):ar1(c) | s)")
    assert f.converged and f.likelihood.size == 6 and f.model.grids == {"a": (7, 5), "b": (7, 4)}


def test_shared_levels_and_weighted_incidence(spark):
    rng = np.random.default_rng(5)
    n, q = 150, 8
    g = rng.integers(0, q, n)
    w = rng.random((n, q)) * (rng.random((n, q)) < 0.4)
    u = rng.multivariate_normal([0, 0], [[1, -0.4], [-0.4, 0.5]], q)
    y = 1 + u[g, 0] + w @ u[:, 1] + rng.normal(size=n)
    rows = [(float(y[i]), f"g{g[i]}", {f"g{j}": float(w[i, j]) for j in range(q) if w[i, j]}) for i in range(n)]
    df = spark.createDataFrame(rows, "y double, g string, near map<string,double>")
    k = pd.DataFrame(0.2 + 0.8 * np.eye(q), index=[f"g{j}" for j in range(q)], columns=[f"g{j}" for j in range(q)])
    f = reml.reml(df, "y ~ 1", "~ str(~ g + mm(near), us, K=K)", matrices={"K": k})
    s = structures.sigma(f.theta[:3], "us", 2)
    z = np.hstack([np.eye(q)[g], w])
    v = z @ np.kron(s, k.to_numpy()) @ z.T + np.exp(2 * f.theta[3]) * np.eye(n)
    assert f.converged and f.neg2 == pytest.approx(reml.dense_neg2(y, np.ones((n, 1)), v), abs=1e-7)
    assert f.blups().count() == 2 * q and len(f.components()) == 4
    alone = reml.reml(df, "y ~ 1", "~ mm(near)")
    v = np.exp(2 * alone.theta[0]) * w @ w.T + np.exp(2 * alone.theta[1]) * np.eye(n)
    assert alone.neg2 == pytest.approx(reml.dense_neg2(y, np.ones((n, 1)), v), abs=1e-7)


def test_own_correlation_and_maximum_likelihood(spark, plot):
    df, pdf, keep = plot
    f = reml.reml(df, "y ~ x", "~ own(r, 'exp(-exp(p1) * d)', n_par=1)", fixed_theta=np.array([np.nan, 0.2, np.nan]), ml=True)
    pos = sorted(pdf["r"].unique())
    z = (pdf["r"].to_numpy()[:, None] == np.array(pos)).astype(float)
    k = np.exp(-np.exp(0.2) * np.abs(np.subtract.outer(pos, pos)))
    v = np.exp(2 * f.theta[0]) * z @ k @ z.T + np.exp(2 * f.theta[2]) * np.eye(len(pdf))
    y, x = pdf["y"].to_numpy(), np.column_stack([np.ones(len(pdf)), pdf["x"]])
    vi = np.linalg.inv(v)
    e = y - x @ np.linalg.solve(x.T @ vi @ x, x.T @ vi @ y)
    assert f.neg2 == pytest.approx(np.linalg.slogdet(v)[1] + e @ vi @ e, abs=1e-6) and f.converged
    assert f.loglik == pytest.approx(-0.5 * (f.neg2 + len(y) * np.log(2 * np.pi)))
    with pytest.raises(ValueError):
        structures.own("__import__('os')", np.zeros(1), np.zeros((2, 1)))
    again = reml.reml(df, "y ~ x", "~ g", restarts=2)
    assert again.neg2 <= reml.reml(df, "y ~ x", "~ g").neg2 + 1e-9


def test_spline_surface_term(plot):
    df, pdf, _ = plot
    f = reml.reml(df, "y ~ x", "~ spl2d(r, c, nseg=3)")
    at = pdf[["r", "c"]].drop_duplicates().sort_values(["r", "c"])
    lines, blocks = splines.surface(at["r"].to_numpy(float), at["c"].to_numpy(float), (3, 3))
    rows = at.reset_index(drop=True).reset_index().merge(pdf, on=["r", "c"])
    x = np.column_stack([np.ones(len(rows)), rows["x"], lines[rows["index"]]])
    v = np.exp(2 * f.theta[5]) * np.eye(len(rows))
    for t, z in zip(f.theta, blocks.values()):
        z = z[rows["index"]]
        v = v + np.exp(2 * t) * z @ z.T
    assert f.neg2 == pytest.approx(reml.dense_neg2(rows["y"].to_numpy(), x, v), abs=1e-6)
    trend = reml.spatial_trend(f, "spl2d(r, c, nseg=3)").toPandas()
    assert len(trend) == len(at) and np.isfinite(trend["trend"]).all()
