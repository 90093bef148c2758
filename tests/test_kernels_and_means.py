"""Pair kernels, and restricted likelihoods of untransformed responses, against dense ones."""

import numpy as np
import pandas as pd
import pytest

from varispark.operators import blocks, genome, lag, reml


@pytest.fixture(scope="module")
def plants(spark):
    rng = np.random.default_rng(11)
    names = [f"g{i}" for i in range(6)]
    k1, k2 = (pd.DataFrame(r ** np.abs(np.subtract.outer(np.arange(6), np.arange(6))), index=names, columns=names) for r in (0.5, 0.7))
    rows = [(f"p{i:02}", names[rng.integers(6)], {n: float(rng.integers(1, 4)) for n in rng.choice(names, rng.integers(0, 4), replace=False)} if i else None, f"s{i % 4}", float(rng.normal())) for i in range(40)]
    return rows, k1, k2, spark.createDataFrame(rows, "plant string, level string, near map<string,double>, site string, y double").repartition(3)


@pytest.mark.parametrize("tile", [1_024, 7])
def test_pair_kernel(plants, tile):
    rows, k1, k2, df = plants
    w = np.array([[(r[2] or {}).get(n, 0.0) for n in k2.index] for r in rows])
    at = [k1.index.get_loc(r[1]) for r in rows]
    want = k1.to_numpy()[np.ix_(at, at)] * (w @ k2.to_numpy() @ w.T)
    m = np.diag(want).mean()
    for normalise in (True, False):
        full = (want / m + 1e-6 * np.eye(40)) if normalise else want + 1e-6 * m * np.eye(40)
        got = {(r["a"], r["b"]): r["x"] for r in genome.pair_kernel(df, k1, k2, tile=tile, normalise=normalise).collect()}
        assert len(got) == 40 * 41 // 2
        assert all(x == pytest.approx(full[int(a[1:]), int(b[1:])], abs=1e-10) for (a, b), x in got.items())


@pytest.mark.parametrize("normalise", [True, False])
def test_kernel_sums_are_those_of_the_pairs(plants, normalise):
    """Sums by genotypes, also with plants that have no neighbours, equal those of the pairs."""
    rows, k1, k2, df = plants
    level, want = {r[0]: r[1] for r in rows}, {}
    for r in genome.pair_kernel(df, k1, k2, normalise=normalise, ridge=0.01).collect():
        key = tuple(sorted((level[r["a"]], level[r["b"]])))
        n, x = want.get(key, (0, 0.0))
        want[key] = n + 1, x + r["x"]
    got = {(r["i"], r["j"]): (r["n"], r["x"]) for r in genome.pair_kernel_sums(df, k1, k2, normalise=normalise, ridge=0.01).collect()}
    assert set(got) == set(want)
    assert all(n == want[k][0] and x == pytest.approx(want[k][1], rel=1e-10) for k, (n, x) in got.items())


def test_kernel_as_a_term_of_blocks(plants, spark):
    rows, k1, k2, df = plants
    kin = genome.pair_kernel(df, k1, k2, block="site", ridge=0.01)
    assert kin.where("block is null").count() == 0 and kin.count() == 4 * 10 * 11 // 2
    like = blocks.build(df, "y ~ 1", "~ vm(plant, K)", "site", relationships={"K": kin})
    big = np.zeros((40, 40))
    for r in kin.collect():
        i, j = int(r["a"][1:]), int(r["b"][1:])
        big[i, j] = big[j, i] = r["x"]
    y = np.array([r[4] for r in rows])
    theta = np.array([-0.2, 0.1])
    v = np.exp(2 * theta[0]) * big + np.exp(2 * theta[1]) * np.eye(40)
    assert like(theta) == pytest.approx(reml.dense_neg2(y - y.mean(), np.ones((40, 1)), v), rel=1e-8)


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(12)
    n, edges = 24, []
    for i in range(20):  # four units have no neighbour
        for j in {(i // 5) * 5 + k for k in rng.choice(5, 2, replace=False)} - {i}:
            edges.append((i // 5, i, int(j), 0.5))
    rows = [(i, t, float(rng.normal()), float(rng.normal())) for i in range(n) for t in "ab"]
    return rows, edges, spark.createDataFrame(rows, "u long, t string, x double, y double"), spark.createDataFrame(edges, "block long, src long, dst long, w double")


def test_mean_terms(field, spark):
    rows, edges, df, e = field
    model = lag.build(df, "u", e, "y ~ t + x", residual="~ diag(t):units", trait="t", lag=lag.spec(["a", "b"], "full"))
    psi = np.array([[0.3, -0.2], [0.1, 0.4]])
    w = np.zeros((24, 24))
    for _, i, j, v in edges:
        w[i, j] += v
    order = sorted(range(len(rows)), key=lambda k: (rows[k][1], rows[k][0]))
    x = np.array([[1.0, rows[k][1] == "b", rows[k][2]] for k in order])
    a = np.eye(48) - np.kron(psi, w)
    means = np.linalg.solve(a, x)
    want = (np.linalg.slogdet(means.T @ means)[1] - np.linalg.slogdet(x.T @ x)[1]) / 2
    got = lag.mean_terms(model, e, [psi, np.zeros((2, 2))])
    assert list(got.values()) == pytest.approx([want, 0.0], abs=1e-10)
    both = e.crossJoin(spark.createDataFrame([("a",), ("b",)], "trait string"))
    assert list(lag.mean_terms(model, both, [psi]).values()) == pytest.approx([want])
    # The whole criterion: the restricted likelihood of y with its own means and covariance.
    y = np.array([rows[k][3] for k in order])
    theta = np.array([0.1, -0.2])
    v = np.diag(np.repeat(np.exp(2 * theta), 24))
    ai = np.linalg.inv(a)
    one = reml.Likelihood(lag.at(model, psi))(theta)
    det = next(iter(lag.log_jacobian(e, [psi], traits=["a", "b"]).values()))
    dense = reml.dense_neg2(y, means, ai @ v @ ai.T) - np.linalg.slogdet(means.T @ means)[1] + np.linalg.slogdet(x.T @ x)[1]
    assert one - 2 * det - 2 * want == pytest.approx(dense)


def test_criterion_on_the_untransformed_response(field):
    _, _, df, e = field
    one = df.where("t = 'a'")
    model = lag.build(one, "u", e, "y ~ x")
    fits = {c: lag.fit_psi(model, e, c, rounds=8) for c in ("jacobian", "reml_y")}
    a, b = (float(fits[c].psi[0]) for c in ("jacobian", "reml_y"))
    assert np.isfinite([a, b]).all() and abs(a - b) < 0.5 and fits["reml_y"].criterion == "reml_y"
    at = fits["reml_y"].psi[0]
    d = lag.log_jacobian(e, [at])[at] + lag.mean_terms(model, e, [at])[at]
    assert fits["reml_y"].neg2 == pytest.approx(reml.fit(lag.at(model, at)).neg2 - 2 * d, abs=1e-6)
    with pytest.raises(ValueError):
        lag.fit_psi(model, e, "other")
