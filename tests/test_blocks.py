"""Blocks eliminated where they lie, against covariance matrices of all rows and against equations held whole."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from varispark.plans.grammar import parse_random
from varispark.operators import blocks, lag, reml
from varispark.plans.hypotheses import parse_test


@pytest.fixture(scope="module")
def herd(spark):
    rng = np.random.default_rng(0)
    rows, ped = [], []
    for s in range(6):
        for a in range(8):
            ped.append((f"s{s}", f"a{a}", f"a{a - 3}" if a >= 3 else None, f"a{a - 2}" if a >= 2 else "unlisted"))
        for a in range(1, 8):  # a0 has no record
            rows += [(f"s{s}", f"a{a}", f"f{rng.integers(5)}", float(rng.normal()), float(rng.integers(1, 4)), float(rng.normal()) + s * 0.3 + a * 0.1) for _ in range(rng.integers(1, 4))]
    pdf = pd.DataFrame(rows, columns=["site", "gid", "f", "x", "w", "y"])
    kin = blocks.pedigree(spark.createDataFrame(ped, "site string, animal string, sire string, dam string"), "site")
    return pdf, spark.createDataFrame(pdf).repartition(5), kin, kin.toPandas()


def pieces(pdf, k):
    levels = sorted(set(zip(k["block"], k["a"])))
    at = {v: i for i, v in enumerate(levels)}
    big = np.zeros((len(levels),) * 2)
    for b, i, j, x in k[["block", "a", "b", "x"]].itertuples(index=False):
        big[at[b, i], at[b, j]] = big[at[b, j], at[b, i]] = x
    z = np.zeros((len(pdf), len(levels)))
    z[range(len(pdf)), [at[v] for v in zip(pdf["site"], pdf["gid"])]] = 1
    return levels, big, z, *[pd.get_dummies(pdf[c]).to_numpy(float) for c in ("f", "site")]


@pytest.mark.parametrize("weights", [None, "w"])
def test_likelihood_gradient_and_information(herd, weights):
    pdf, df, kin, k = herd
    levels, big, z, zf, zs = pieces(pdf, k)
    like = blocks.build(df, "y ~ x", "~ site + vm(gid, K)", "site", random="~ f", relationships={"K": kin}, weights=weights)
    r = np.diag(1 / (pdf["w"] if weights else np.ones(len(pdf))))
    parts = [zf @ zf.T, zs @ zs.T, z @ big @ z.T, r]
    x, y = np.column_stack([np.ones(len(pdf)), pdf["x"]]), pdf["y"].to_numpy()
    theta = np.log([0.5, 0.7, 0.6, 0.8])
    dense = lambda t: reml.dense_neg2(y - y.mean(), x, sum(np.exp(2 * a) * v for a, v in zip(t, parts)))
    value, grad = like.value_and_gradient(theta)
    assert value == pytest.approx(dense(theta), rel=1e-10) and like(theta) == pytest.approx(value)
    assert grad == pytest.approx([(dense(theta + e) - dense(theta - e)) / 2e-5 for e in np.eye(4) * 1e-5], rel=1e-5, abs=1e-5)
    v = sum(np.exp(2 * a) * p for a, p in zip(theta, parts))
    vi = np.linalg.inv(v)
    p = vi - vi @ x @ np.linalg.solve(x.T @ vi @ x, x.T @ vi)
    work = [2 * np.exp(2 * a) * q @ p @ y for a, q in zip(theta, parts)]
    assert like.average_information(theta) == pytest.approx(np.array([[a @ p @ b for b in work] for a in work]), rel=1e-6, abs=1e-6)
    # Predictions and error variances of all effects, of animals without a record too.
    f = blocks.fit(like, fixed_theta=theta)
    got = {(r["block"], r["level"]): r for r in f.local_blups().where("term = 'vm(gid, K)'").collect()}
    g = np.exp(2 * theta[2]) * big
    u, pev = g @ z.T @ p @ y, np.diag(g - g @ z.T @ p @ z @ g)
    for i, key in enumerate(levels):
        assert (got[key]["blup"], got[key]["pev"]) == pytest.approx((u[i], pev[i]), rel=1e-8, abs=1e-8)
    assert f.solution[0] + f.model.spec["centre"] == pytest.approx(np.linalg.solve(x.T @ vi @ x, x.T @ vi @ y)[0])
    ed = {r["term"]: r["ed"] for r in f.dimensions().collect()}
    ki = np.linalg.inv(big)
    assert ed["vm(gid, K)"] == pytest.approx(len(levels) - np.trace(ki @ (g - g @ z.T @ p @ z @ g)) / np.exp(2 * theta[2]))
    assert set(ed) == {"f", "site", "vm(gid, K)"} and f.blups().count() == 5 + 6 + len(levels)


def test_maximum_likelihood(herd):
    pdf, df, kin, k = herd
    _, big, z, zf, zs = pieces(pdf, k)
    like = blocks.build(df, "y ~ x", "~ site + vm(gid, K)", "site", random="~ f", relationships={"K": kin}, ml=True)
    theta, y = np.log([0.5, 0.7, 0.6, 0.8]), pdf["y"].to_numpy()
    x = np.column_stack([np.ones(len(pdf)), pdf["x"]])

    def dense(t):
        v = sum(np.exp(2 * a) * p for a, p in zip(t, (zf @ zf.T, zs @ zs.T, z @ big @ z.T, np.eye(len(y)))))
        return reml.dense_neg2(y - y.mean(), x, v) - np.linalg.slogdet(x.T @ np.linalg.solve(v, x))[1]

    value, grad = like.value_and_gradient(theta)
    assert value == pytest.approx(dense(theta))
    assert grad == pytest.approx([(dense(theta + e) - dense(theta - e)) / 2e-5 for e in np.eye(4) * 1e-5], rel=1e-5, abs=1e-5)


def test_pedigree(herd):
    """Against the tabular method by hand; offspring of relatives are inbred."""
    k = herd[3]
    a = {(r["a"], r["b"]): r["x"] for r in k[k["block"] == "s0"].to_dict("records")}
    get = lambda i, j: a.get((i, j), a.get((j, i), 0.0))
    for n in range(8):
        s, d = (f"a{n - 3}" if n >= 3 else None), (f"a{n - 2}" if n >= 2 else None)
        assert get(f"a{n}", f"a{n}") == pytest.approx(1 + (get(s, d) / 2 if s and d else 0))
        for m in range(n):
            assert get(f"a{n}", f"a{m}") == pytest.approx(sum(get(p, f"a{m}") for p in (s, d) if p) / 2)


def test_two_traits_equal_the_equations_held_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{u % 7}", f"g{u % 5}", f"f{rng.integers(4)}", u, t, float(rng.normal() + (u % 7) * 0.2)) for u in range(120) for t in "ab" if rng.random() < 0.85]
    df = spark.createDataFrame(rows, "site string, gid string, f string, u long, t string, y double").withColumn("sg", F.concat("site", "gid")).repartition(3)
    like = blocks.build(df, "y ~ t", "~ us(site) + diag(gid)", "site", random="~ diag(f)", residual="~ us(t):units", trait="t", unit="u")
    whole = reml.Likelihood(reml.build(df, "y ~ t", "~ diag(f) + us(site) + diag(sg)", "~ us(t):units", trait="t", unit="u"))
    theta = whole.start() + 0.1 * rng.normal(size=whole.size)
    a, b = like.value_and_gradient(theta), whole.value_and_gradient(theta)
    assert a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1], rel=1e-6, abs=1e-6)
    assert like.average_information(theta) == pytest.approx(whole.average_information(theta), rel=1e-8, abs=1e-8)


def test_refusals_and_null_blocks(herd, spark):
    _, df, kin, _ = herd
    for local in ("~ ar1(gid)", "~ rr(gid)", "~ vm(gid, Q)"):
        with pytest.raises(ValueError):
            blocks.build(df, "y ~ x", local, "site", relationships={"K": kin})
    with pytest.raises(Exception, match="effects, more than 3"):
        blocks.build(df, "y ~ x", "~ gid", "site", max_local=3)
    with pytest.raises(Exception, match="no relationship"):
        blocks.build(df, "y ~ x", "~ vm(gid, K)", "site", relationships={"K": kin.where("a <> 'a5' and b <> 'a5'")})
    holes = df.withColumn("site", F.when(F.col("site") != "s0", F.col("site")))
    assert blocks.build(holes, "y ~ x", "~ gid", "site").model.n == df.where("site <> 's0'").count()


def test_fit_reaches_the_optimum_of_the_whole(herd):
    pdf, df, _, _ = herd
    df = df.withColumn("sg", F.concat("site", "gid"))
    a = blocks.fit(blocks.build(df, "y ~ x", "~ site + gid", "site"))
    b = reml.reml(df, "y ~ x", "~ site + sg")
    assert a.neg2 == pytest.approx(b.neg2, abs=1e-4) and a.converged


def test_fitted_values_of_any_model(spark):
    rng = np.random.default_rng(5)
    rows = []
    for u in range(150):
        g, f, x = u % 6, "pq"[u % 2], float(rng.normal())
        for t, b in (("a", 1.0), ("b", -2.0)):
            rows.append((u, t, f"g{g}", f, x, {f"n{g}": 1.0, f"n{(g + 1) % 6}": 0.5}, b * g + x * (f == "p") + 0.1 * float(rng.normal())))
    df = spark.createDataFrame(rows, "u long, t string, g string, f string, x double, near map<string,double>, y double")
    f = reml.reml(df, "y ~ t + f:x", "~ us(g)", "~ us(t):units", trait="t", unit="u")
    got = reml.fitted(f, df)
    assert got.columns == [*df.columns, "fitted", "resid"]
    assert all(r["s"] < 0.2 for r in got.groupBy("t").agg(F.stddev("resid").alias("s")).collect())
    one = df.where("t = 'a'")
    f = reml.reml(one, "y ~ x", "~ mm(near)")
    sol = {r["level"]: r["blup"] for r in f.blups().collect()}
    b = f.estimates
    for r in reml.fitted(f, one).collect():
        assert r["fitted"] == pytest.approx(b[0] + b[1] * r["x"] + sum(v * sol[k] for k, v in r["near"].items()))
    new = spark.createDataFrame([(None, {"n0": 1.0}, 1.0), (2.0, {"never": 1.0}, 1.0)], "x double, near map<string,double>, y double")
    a, c = reml.fitted(f, new).collect()
    assert a["fitted"] is None and c["fitted"] == pytest.approx(b[0] + 2 * b[1])


def test_region_of_a_lag(spark):
    """Two mutual pairs at 1.5 are beyond it, by trait or not; a ring of three at -2.5 is within."""
    pairs = spark.createDataFrame([("p", "a", "b", 1.0), ("p", "b", "a", 1.0), ("q", "c", "d", 1.0), ("q", "d", "c", 1.0)], "block string, src string, dst string, w double")
    ring = spark.createDataFrame([("p", "a", "b", 1.0), ("p", "b", "c", 1.0), ("p", "c", "a", 1.0)], "block string, src string, dst string, w double")
    traits = lambda e: e.withColumn("trait", F.lit("t"))
    for edges in (pairs, traits(pairs)):
        det = lag.log_jacobian(edges, [1.5, 0.5], traits=["t"])
        assert det[1.5] == -np.inf and det[0.5] == pytest.approx(2 * np.log(0.75))
    for edges in (ring, traits(ring)):
        det = lag.log_jacobian(edges, [-2.5, 1.2], traits=["t"])
        assert det[-2.5] == pytest.approx(np.log(1 + 2.5**3)) and det[1.2] == -np.inf


def test_hypotheses():
    columns, rows, labels = parse_test("dir@het + ind[b, 1] | sim@common", ["a", "b", "c"])
    assert columns == [{("dir", k): 1.0} for k in range(3)] + [{("ind", k): 1.0} for k in range(3)] + [{("sim", k): 1.0 for k in range(3)}]
    assert labels == ["dir[b-a]", "dir[c-a]", "ind[b]", "ind[a]"]
    assert rows.tolist() == [[-1, 1, 0, 0, 0, 0, 0], [-1, 0, 1, 0, 0, 0, 0], [0, 0, 0, 0, 1, 0, 0], [0, 0, 0, 1, 0, 0, 0]]
    _, rows, labels = parse_test(" dir + dir[1] ", ["x"])
    assert rows.tolist() == [[1]] and labels == ["dir"]
    for wrong in ("", "foo", "dir dir", "dir[", "dir[]", "dir[z]", "dir@all", "dir[a]@het", "+ dir", "dir | ind@", "dir + dir@common"):
        with pytest.raises(ValueError):
            parse_test(wrong, ["a", "b"])
    with pytest.raises(ValueError):
        parse_test("dir@het", ["a"])


def test_levels_that_never_meet_need_no_dense_block(spark):
    """One block of 40,000 levels beside an effect of its own: its equations would be 13 GB as a matrix."""
    df = spark.range(80_000).selectExpr("'a' as b", "id % 40000 as lv", "id % 7 as x", "cast(xxhash64(id) % 1000 as double) / 500 + (id % 40000) % 3 as y")
    theta = np.log(np.sqrt([0.5, 0.8]))
    f = blocks.fit(blocks.build(df, "y ~ x", "~ lv", "b", max_local=50_000), fixed_theta=theta)
    g = reml.reml(df, "y ~ x", "~ lv", absorb="lv", fixed_theta=theta)
    assert f.neg2 == pytest.approx(g.neg2, rel=1e-9)
    mine = {r["level"]: (r["blup"], r["pev"]) for r in f.local_blups().collect()}
    other = {str(r["level"]): r["blup"] for r in g.absorbed_blups().collect()}
    assert len(mine) == 40_000 and all(abs(mine[k][0] - v) < 1e-9 for k, v in other.items())


def test_sums_where_rows_pass_by(spark, monkeypatch):
    """Each block's sums from one shuffle of its rows are those of the pairs; parameters that are all given take no derivatives."""
    rng = np.random.default_rng(21)
    rows = [(f"b{rng.integers(5)}", f"a{rng.integers(9)}", f"c{rng.integers(4)}", int(rng.integers(3)), float(rng.normal()), float(rng.normal()), float(rng.uniform(0.5, 2))) for _ in range(400)]
    df = spark.createDataFrame(rows, "blk string, a string, c string, z int, x double, y double, w double").repartition(6)
    terms = parse_random("~ blk + a + c")
    model = reml.build(df, "y ~ x", "~ z", weights="w", absorb=None, keep=("blk", "a", "c"))
    cells = {("0", 0, 0): 0}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # blocks go on over batches
    try:
        found = []
        for table in (blocks._gathered(model, terms, [1, 1, 1], 1, "blk", cells, 2_000), blocks._pack(blocks._sums(model, terms, 1, "blk", False), terms, [1, 1, 1], cells, None, 2_000)):
            found.append({r["block"]: (r["labels"], r["q"], {(c, i, j): x for c, i, j, x in zip(r["cell"], r["i"], r["j"], r["x"])}) for r in table.collect()})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(found[0]) == set(found[1]) == {f"b{k}" for k in range(5)}
    for b, (labels, q, sums) in found[0].items():
        assert (labels, q) == found[1][b][:2] and sums == pytest.approx(found[1][b][2], rel=1e-12)
    like = blocks.build(df, "y ~ x", "~ blk + a", "blk", random="~ z", weights="w")
    monkeypatch.setattr(blocks.BlockLikelihood, "_derivatives", lambda *a: pytest.fail("derivatives"))
    assert blocks.fit(like, fixed_theta=np.zeros(4)).neg2 == pytest.approx(like(np.zeros(4)))
