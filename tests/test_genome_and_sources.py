import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varispark.functions import splines
from varispark.operators import genome, oneway, reml
from varispark.sources import bundle
from varispark.streaming import oneway_stream


@pytest.fixture(scope="module")
def trial(spark):
    rng = np.random.default_rng(7)
    q, n = 20, 120
    g = np.repeat(np.arange(q), n // q)
    nb = rng.permutation(g)
    doses = rng.integers(0, 3, (15, q)).astype(float)
    y = 2 + 0.6 * doses[3][g] + rng.normal(size=q)[g] * 0.5 + rng.normal(size=n)
    pdf = pd.DataFrame({"y": y, "g": [f"g{v:02d}" for v in g], "nb": [f"g{v:02d}" for v in nb]})
    df = spark.createDataFrame(pdf)
    markers = spark.createDataFrame([(k, d.tolist(), k % 3) for k, d in enumerate(doses)], "snp long, dose array<double>, chr int")
    return df, pdf, g, nb, doses, markers, reml.reml(df, "y ~ 1", "~ g + nb")


def gls(y, x, v):
    vi = np.linalg.inv(v)
    cov = np.linalg.inv(x.T @ vi @ x)
    return cov @ x.T @ vi @ y, cov


def test_scan_equals_generalised_least_squares(trial):
    _, pdf, g, nb, doses, markers, fit = trial
    z, w, y = np.eye(20)[g], np.eye(20)[nb], pdf["y"].to_numpy()
    s = np.exp(2 * fit.theta)
    v = s[0] * z @ z.T + s[1] * w @ w.T + s[2] * np.eye(len(y))
    got = {r["snp"]: r for r in genome.scan(fit, markers, ["g", "nb"]).collect()}
    for k, d in enumerate(doses):
        b, cov = gls(y, np.column_stack([np.ones(len(y)), d[g]]), v)
        assert got[k]["beta_1"] == pytest.approx(b[1], abs=1e-6) and got[k]["chi2_1"] == pytest.approx(b[1] ** 2 / cov[1, 1], rel=1e-6)
        b, cov = gls(y, np.column_stack([np.ones(len(y)), d[g], d[nb]]), v)
        assert got[k]["chi2_joint"] == pytest.approx(float(b[1:] @ np.linalg.solve(cov[1:, 1:], b[1:])), rel=1e-6)
    pairs = genome.pair_scan(fit, markers, markers, ("g", "nb"), block=4, top=5).collect()
    first = pairs[0]
    b, cov = gls(y, np.column_stack([np.ones(len(y)), doses[first["focal"]][g], doses[first["neighbour"]][nb]]), v)
    assert first["chi2"] == pytest.approx(float(b[1:] @ np.linalg.solve(cov[1:, 1:], b[1:])), rel=1e-6)
    loco = genome.scan_loco(lambda c: fit, markers, ["g"])
    assert loco.count() == 15


def test_model_and_result_round_trip(spark, trial, tmp_path):
    fit = trial[-1]
    bundle.save_model(spark, fit.model, f"{tmp_path}/model")
    back = bundle.load_model(spark, f"{tmp_path}/model")
    assert reml.Likelihood(back)(fit.theta) == pytest.approx(fit.neg2, abs=1e-9)
    bundle.save_result(fit, f"{tmp_path}/result")
    meta, tables = bundle.load_result(spark, f"{tmp_path}/result")
    assert meta["loglik"] == pytest.approx(fit.loglik) and tables["blups"].count() == 40


def test_splines():
    x = np.linspace(0, 9, 40)
    b = splines.basis(x, 5)
    assert b.shape == (40, 8) and np.allclose(b.sum(axis=1), 1) and (b >= -1e-12).all()
    v, size = splines.decompose(8)
    d = np.diff(np.eye(8), n=2, axis=0)
    assert np.allclose(v.T @ (d.T @ d) @ v, np.diag(size)) and v.shape == (8, 6)
    r, c = map(np.ravel, np.meshgrid(np.arange(8.0), np.arange(6.0)))
    fixed, blocks = splines.surface(r, c, (4, 3))
    assert fixed.shape == (48, 3) and blocks["row_col"].shape == (48, 5 * 4) and np.allclose(fixed.mean(axis=0), 0)


def test_stream_gives_the_batch_statistics(spark, trial, tmp_path):
    df = trial[0]
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = oneway_stream.grouped(stream, "g", F.col("y")).writeStream.format("memory").queryName("levels").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = oneway.neg2_loglik(oneway_stream.statistics(spark.table("levels")), 0.4, 0.9).first()["neg2"]
    assert got == pytest.approx(oneway.neg2_loglik(oneway.group_stats(df, "g", F.col("y")), 0.4, 0.9).first()["neg2"], abs=1e-8)
