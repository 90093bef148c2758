import math

import numpy as np
import pytest

from varispark.functions import special, structures
from varispark.plans import grammar


@pytest.mark.parametrize("struct,rank", [("iid", 1), ("diag", 1), ("us", 1), ("fa", 1), ("fa", 2), ("chol", 1), ("ante", 1), ("corh", 1)])
def test_sigma_is_positive_definite(struct, rank):
    rng = np.random.default_rng(3)
    for _ in range(5):
        s = structures.sigma(rng.normal(size=structures.n_sigma(struct, 4, rank)) * 0.5, struct, 4, rank)
        assert np.allclose(s, s.T) and np.linalg.eigvalsh(s).min() > 0


def test_rr_is_singular_and_counts():
    s = structures.sigma(np.ones(structures.n_sigma("rr", 4, 2)), "rr", 4, 2)
    assert np.linalg.matrix_rank(s) == 2
    assert structures.n_sigma("us", 4) == 10 and structures.n_sigma("fa", 4, 2) == 11 and structures.n_sigma("chol", 4, 1) == 7


def test_start_gives_the_variance():
    for struct in ("iid", "diag", "us", "chol", "corh"):
        assert structures.sigma(structures.sigma_start(struct, 3, 1, 2.0), struct, 3, 1)[0, 0] == pytest.approx(2.0)


@pytest.mark.parametrize("kind", ["cor", "ar1", "ar2", "ar3", "sar", "ma1", "ma2", "arma", "exp", "gau", "iexp", "ieuc", "lvr", "sph", "mtrn", "corg"])
def test_correlations(kind):
    pos = np.arange(6.0)[:, None]
    k = structures.correlation(np.full(structures.n_level(kind, 6), 0.3), kind, pos)
    assert np.allclose(np.diag(k), 1) and np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > -1e-8


def test_ar1_and_ar2_agree():
    pos = np.arange(5.0)[:, None]
    one = structures.correlation([0.4], "ar1", pos)
    assert np.allclose(one, math.tanh(0.4) ** np.abs(np.subtract.outer(range(5), range(5))))
    assert np.allclose(structures.correlation([0.4, 0.0], "ar2", pos), one)


def test_matern_half_is_exponential():
    d = np.array([0.0, 0.3, 1.0, 2.5])
    assert np.allclose(special.matern(d, 0.5), np.exp(-d), atol=1e-8)
    assert np.allclose(special.matern(d, 1.5), (1 + d) * np.exp(-d), atol=1e-8)


def test_tails():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert special.chi2_sf(4.0, 2) == pytest.approx(math.exp(-2), abs=1e-14)
    assert special.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-10)
    assert special.normal_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-9)


def test_grammar():
    y, intercept, terms = grammar.parse_fixed("log(y) ~ a*x - 1")
    assert (y, intercept, terms) == ("log(y)", False, [("a",), ("x",), ("a", "x")])
    t = grammar.parse_random("~ g + us(h) + fa(k, rank=2) + vm(id, A) + ar1(r, c)")
    assert [(x.struct, x.level, x.rank) for x in t] == [("iid", "id", 1), ("us", "id", 1), ("fa", "id", 2), ("iid", "fixed", 1), ("iid", "ar1", 1)]
    assert grammar.parse_residual("~ dsum(~ diag(trait):units | env)").section == "env"
    with pytest.raises(ValueError):
        grammar.parse_random("~ us(g, shape=3)")
