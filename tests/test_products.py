"""Products of two families' doses against least squares on all rows: several traits, missing records, slabs and tiles of any size."""

import numpy as np
import pandas as pd
import pytest

from varispark.operators import genome, products, reml


def gls(y, x, v):
    vi = np.linalg.inv(v)
    cov = np.linalg.inv(x.T @ vi @ x)
    return cov @ x.T @ vi @ y, cov


@pytest.mark.parametrize("rows, tile", [(products.SLAB, products.TILE), (40, 3)])
def test_two_traits(spark, monkeypatch, rows, tile):
    monkeypatch.setattr(products.products, "__defaults__", (rows, tile))
    rng = np.random.default_rng(7)
    n, q = 90, 6
    g, h = rng.integers(0, q, n), rng.integers(0, q, n)
    pdf = pd.DataFrame([(u, t, f"g{g[u]}", f"g{h[u]}", float(rng.normal() + g[u] * (t == "b"))) for u in range(n) for t in "ab" if rng.random() < 0.85], columns=["u", "t", "g", "h", "y"])
    doses = rng.choice([-1.0, 1.0], (8, q))
    doses[5] = 1.0
    markers = spark.createDataFrame([(k, d.tolist(), "clash", 1) for k, d in enumerate(doses)], "snp long, dose array<double>, num string, tile int").repartition(3)
    theta = np.array([0.1, 0.3, -0.2, -0.3, 0.1, 0.2, 0.0, 0.4, -0.1])
    fit = reml.reml(spark.createDataFrame(pdf).repartition(4), "y ~ t", "~ us(g) + us(h)", "~ us(t):units", trait="t", unit="u", fixed_theta=theta)
    tests = ["sim", "sim@common", "sim@het|dir", "sim[b]|dir + ind", "dir"]
    got = {r["snp"]: r for r in genome.scan_tests(fit, markers, {"dir": "us(g)", "ind": "us(h)"}, tests, coding="sign").collect()}
    low = [np.array([[np.exp(a), 0], [b, np.exp(c)]]) for a, b, c in theta.reshape(3, 3)]
    s = [x @ x.T for x in low]
    t = (pdf["t"] == "b").to_numpy(int)
    one = lambda c: (pdf[c].to_numpy()[:, None] == pdf[c].to_numpy()[None, :])
    v = sum(k[np.ix_(t, t)] * one(c) for k, c in zip(s, ("g", "h", "u")))
    x0, y = np.column_stack([np.ones(len(pdf)), t]), pdf["y"].to_numpy()
    level = {c: pdf[c].str[1:].to_numpy(int) for c in "gh"}
    for k, d in enumerate(doses):
        if k == 5:
            assert got[k]["chi2_1"] is None
            continue
        own, other = d[level["g"]], d[level["h"]]
        by = lambda z: [z * (1 - t), z * t]
        u = by(own * other)
        for i, (cols, contrast) in enumerate([(u, np.eye(2)), ([own * other], np.eye(1)), ([*u, *by(own)], np.array([[-1.0, 1, 0, 0]])), ([*u, *by(own), *by(other)], np.array([[0.0, 1, 0, 0, 0, 0]])), (by(own), np.eye(2))]):
            x = np.column_stack([x0, *cols])
            if np.linalg.matrix_rank(x) < x.shape[1]:
                continue
            b, cov = gls(y, x, v)
            lb, lv = contrast @ b[2:], contrast @ cov[2:, 2:] @ contrast.T
            assert got[k][f"chi2_{i + 1}"] == pytest.approx(lb @ np.linalg.solve(lv, lb), rel=1e-6, abs=1e-9), (k, tests[i])


def test_refusals(spark):
    df = spark.createDataFrame([(i % 4, i % 3, float(i * i % 7)) for i in range(40)], "g long, h long, y double")
    fit = reml.reml(df, "y ~ 1", "~ g", fixed_theta=np.zeros(2))
    markers = spark.createDataFrame([(0, [1.0, -1.0, 1.0, -1.0])], "snp long, dose array<double>")
    with pytest.raises(ValueError, match="no term"):
        genome.scan_tests(fit, markers, {"dir": "g"}, ["sim"], coding="sign")
    with pytest.raises(ValueError, match="centred"):
        genome.scan_tests(fit, markers, {"dir": "g", "ind": "g"}, ["sim"])
