"""Covariances between traits whose estimates are singular."""

import numpy as np
import pytest

from varispark.functions import cone, structures
from varispark.operators import reml, tables


def simulated(spark, t, rank, groups, n):
    rng = np.random.default_rng(t)
    u = rng.normal(size=(groups, rank)) @ rng.normal(size=(t, rank)).T
    rows = [(i, i % groups, f"t{k:02}", float(u[i % groups, k] + rng.normal())) for i in range(n) for k in range(t)]
    return spark.createDataFrame(rows, "u long, g long, t string, y double")


@pytest.mark.parametrize("t, rank", [(3, 1), (6, 2)])
def test_singular_estimates_are_reached(spark, t, rank):
    model = reml.build(simulated(spark, t, rank, 10 * t, 80 * t), "y ~ t", "~ us(g)", "~ diag(t):units", trait="t", unit="u")
    fits = [reml.fit(model, optimizer=o) for o in ("cone", "auto")]
    assert fits[0].neg2 == pytest.approx(fits[1].neg2, abs=0.02)
    for f in fits:
        assert f.converged and rank <= f.faces["us(g)"] < t
        like, (ss, _) = f.likelihood, f.likelihood.slices[0]
        s = structures.sigma(f.theta[ss], "us", t)
        values, q = np.linalg.eigh(s)
        # No direction within the cone raises the likelihood: neither opening the null space nor moving within the face.
        c = cone.cells([("us", ss, t)], f.free)[0]
        grad = like.value_and_gradient(f.theta)[1]
        null = q[:, values < 1e-5 * values[-1]]
        slopes = [grad @ c.move(f.theta, np.outer(n, n), len(f.theta)) for n in null.T]
        assert null.shape[1] == t - f.faces["us(g)"] and min(slopes) > -1e-2
        own = [grad @ c.move(f.theta, np.outer(v, v), len(f.theta)) * x for v, x in zip(q.T, values) if x > 1e-3]
        assert np.abs(own).max() < 1e-2
    codes = {r["name"]: r["constraint"] for r in tables.components(fits[1]).collect()}
    assert codes["us(g)[t00,t00]"] == "B" and codes["us(g)[t01,t00]"] == "B"


def test_moves_of_a_matrix():
    rng = np.random.default_rng(1)
    c = cone.Cell(np.arange(1, 7), 3)
    theta = rng.normal(size=8)
    d = rng.normal(size=(3, 3))
    d = d + d.T
    h = 1e-6
    moved = theta + h * c.move(theta, d, 8)
    assert (c.matrix(moved) - c.matrix(theta)) / h == pytest.approx(d, abs=1e-4)
    back = theta.copy()
    c.put(back, c.matrix(theta))
    assert back == pytest.approx(theta)


def test_zero_variances_and_other_parameters(spark):
    """A variance at its floor beside an autoregression, which moves on its own scale."""
    rng = np.random.default_rng(2)
    rows = [(i % 12, i % 7, float(rng.normal() + 0.8 * np.sin(i % 12))) for i in range(240)]
    df = spark.createDataFrame(rows, "r long, g long, y double")
    model = reml.build(df, "y ~ 1", "~ g + ar1(r)")
    a, b = reml.fit(model, optimizer="cone"), reml.fit(model)
    assert a.neg2 == pytest.approx(b.neg2, abs=1e-3) and a.converged
    assert a.components()["g"] < 1e-2
