"""Neighbours by tiles: against brute force, and without a broadcast of units or a shuffle of their pairs."""

import random
import re

import pytest

from varispark.operators import design
from varispark.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("window, rank, spacing", [("chebyshev", 1, (1.0, 1.0)), ("chebyshev", 3, (1.0, 1.0)), ("euclidean", 2, (0.7, 1.3)), ("euclidean", 1, (0.1, 0.1))])
def test_neighbours_brute_force(spark, window, rank, spacing):
    rng = random.Random(5)
    units = [(b, k, rng.choice([rng.randrange(-9, 30), rng.uniform(-9, 30)]) * 1.0, rng.randrange(-9, 30) * 1.0) for b in ("a", None, "b") for k in range(150)]
    units += [("a", 900, None, 1.0), ("a", 901, 3.0, 3.0), ("a", 902, 3.0, 3.0)]
    got = {(r["block"], r["src"], r["dst"]) for r in design.neighbours(spark.createDataFrame(units, "block string, id long, r double, c double"), rank, window, spacing).collect()}
    want = set()
    for b, i, r, c in units:
        for b2, j, r2, c2 in units:
            if b is None or b != b2 or r is None or r2 is None or (r, c) == (r2, c2):
                continue
            dist = ((r - r2) ** 2 * spacing[0] ** 2 + (c - c2) ** 2 * spacing[1] ** 2) ** 0.5
            if abs(r - r2) <= rank and abs(c - c2) <= rank if window == "chebyshev" else dist <= rank * min(spacing):
                want.add((b, i, j))
    assert got == want


def test_border_covariate_without_broadcast(spark):
    assert "Broadcast" not in plan(catalogue.border_covariate(spark, DATA))


def test_neighbourhood_shuffles_units_only(spark):
    text = plan(catalogue.neighbourhood_level_incidence(spark, DATA))
    assert "Broadcast" not in text and len(re.findall(r"Exchange hashpartitioning", text)) == 2


def test_exposure_has_one_shuffle_of_entries(spark):
    text = plan(catalogue.exposure_functionals(spark, DATA))
    assert "Broadcast" not in text and len(re.findall(r"Exchange hashpartitioning", text)) == 3 and text.count("SortMergeJoin") == 1


def test_exposure_with_repeated_entries_and_rows_of_one_side(spark):
    z = spark.createDataFrame([(1, "a", 2.0), (1, "a", 1.0), (1, "b", 1.0), (2, "a", 5.0), (4, None, 3.0), (4, "c", 1.0)], "src long, level string, x double")
    own = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (3, "b", 2.0), (4, "b", 1.0), (4, None, 9.0), (None, "a", 9.0)], "src long, level string, x double")
    got = design.exposure(z, direct=own).first()
    # rows 1, 3, 4: d (4 + 4 + 1) / 3, k (4 + 1 + 1 + 0 + 9 + 1) / 3, c (2 * 3) / 3, s (4 + 0 + 4) / 3
    assert (got["rows"], got["d"], got["c"]) == (3, 3.0, 2.0)
    assert abs(got["k"] - 16 / 3) < 1e-12 and abs(got["s"] - 8 / 3) < 1e-12
    alone = design.exposure(z).first()
    assert (alone["rows"], alone["d"], alone["c"]) == (3, 1.0, None) and abs(alone["k"] - 41 / 3) < 1e-12


def test_separable_pairs_shuffle_units_only(spark):
    text = plan(catalogue.separable_cov_pairs(spark, DATA))
    assert "Broadcast" not in text and len(re.findall(r"Exchange hashpartitioning", text)) == 2


def test_lag_shuffles_no_pairs(spark):
    text = plan(catalogue.lag_ystar(spark, DATA))
    assert text.count("SortMergeJoin") + text.count("BroadcastHashJoin") == 2 and "Window" not in text


def test_tasks_grow_with_the_units(spark, monkeypatch):
    monkeypatch.setattr(design, "UNITS", 100)  # 1,500 orders
    for query in (catalogue.neighbourhood_level_incidence, catalogue.exposure_functionals):
        text = plan(query(spark, DATA))
        assert set(re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", text)) == {"15"}
