"""Models and results on disk: Parquet tables and a JSON description in one folder, on any store that Spark reads."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from varispark.operators.reml import Absorbed, Effects, Fit, Model, Sums, _blocks
from varispark.plans.grammar import Residual, Term


def _plain(x):
    """JSON has no NaN: it becomes null."""
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, np.ndarray):
        return _plain(x.tolist())
    if isinstance(x, np.generic):
        return _plain(x.item())
    return None if isinstance(x, float) and not math.isfinite(x) else x


def _write_json(spark: SparkSession, path: str, content: dict) -> None:
    spark.createDataFrame([(json.dumps(_plain(content)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """manifest (layout of effects) and cells (cross-products as triplets)."""
    effects = lambda es: [{"name": e.name, "offset": e.offset, "labels": e.labels, "t": e.t, "columns": e.columns, "absorbed": e.absorbed, "pos": e.pos, "axes": e.axes, "k": e.k, "term": e.term.__dict__ if e.term else None} for e in es]
    spec = {"fixed": model.spec["fixed"], "intercept": model.spec["intercept"], "levels": model.spec["levels"], "centre": model.spec.get("centre", 0.0)}
    _write_json(spark, f"{path}/manifest", {"fixed": effects(model.fixed), "random": effects(model.random), "residual": model.residual.__dict__, "traits": model.traits, "sections": model.sections, "p": model.p, "m": model.m, "n": model.n, "log_weights": model.log_weights, "response": model.response, "spec": spec, "grids": [[s, *g] for s, g in model.grids.items()], "units": [[s, p, u] for (s, p), (u, _) in model.cells.items()]})
    rows = [(None if s is None else str(s), p, str(a), str(b), int(i), int(j), float(x)) for (s, p), (_, sums) in model.cells.items() for (a, b), g in sums.items() for i, j, x in zip(g.i, g.j, g.x)]
    spark.createDataFrame(rows, "section string, pattern string, t1 string, t2 string, i int, j int, x double").write.mode("overwrite").parquet(f"{path}/cells")
    if model.absorbed:
        rows = [(int(n), int(q), int(i), int(j), float(x)) for n, (q, g) in model.absorbed.by_n.items() for i, j, x in zip(g.i, g.j, g.x)]
        spark.createDataFrame(rows, "n long, q long, i int, j int, x double").write.mode("overwrite").parquet(f"{path}/absorbed")
        model.absorbed.levels.write.mode("overwrite").parquet(f"{path}/levels")


def load_model(spark: SparkSession, path: str, source: DataFrame | None = None) -> Model:
    d = _read_json(spark, f"{path}/manifest")

    def effects(rows: list[dict]) -> list[Effects]:
        out = []
        for e in rows:
            labels = [tuple(x) if isinstance(x, list) else x for x in e["labels"]]
            pos = e["pos"] if e["axes"] or e["pos"] is None else np.array(e["pos"], dtype=float)
            out.append(Effects(e["name"], e["offset"], labels, Term(**e["term"]) if e["term"] else None, e["t"], [tuple(c) for c in e["columns"]] if e["columns"] else None, e["absorbed"], pos, e["axes"], np.array(e["k"]) if isinstance(e["k"], list) else e["k"]))
        return out

    section = {None if s is None else str(s): s for s in d["sections"]}
    cells = {(s, p): (u, {}) for s, p, u in d["units"]}
    for (s, p, t1, t2), (i, j, x) in _blocks(spark.read.parquet(f"{path}/cells"), ["section", "pattern", "t1", "t2"]):
        cells[(section[s], p)][1][(int(t1), int(t2)) if t1.isdigit() else t1 + t2] = Sums(i, j, x, d["m"] + 1)
    spec = {"fixed": [tuple(t) for t in d["spec"]["fixed"]], "intercept": d["spec"]["intercept"], "levels": d["spec"]["levels"], "centre": d["spec"].get("centre", 0.0)}
    absorbed = None
    if any(e["absorbed"] is not None for e in d["random"]):
        groups = {n: (int(q), Sums(i, j, x, d["m"] + 1)) for (n, q), (i, j, x) in _blocks(spark.read.parquet(f"{path}/absorbed"), ["n", "q"])}
        absorbed = Absorbed(groups, spark.read.parquet(f"{path}/levels"))
    if source is None:
        source = spark.createDataFrame([], "none int")
    return Model(effects(d["fixed"]), effects(d["random"]), Residual(**d["residual"]), d["traits"], d["sections"], cells, d["p"], d["m"], d["n"], d["log_weights"], source, d["response"], spec, absorbed=absorbed, grids={s: tuple(g) for s, *g in d["grids"]})


def save_result(fit: Fit, path: str) -> None:
    """Scalars and parameters as JSON, tables as Parquet."""
    _write_json(fit.spark, f"{path}/result", {"loglik": fit.loglik, "aic": fit.aic, "bic": fit.bic, "theta": fit.theta, "hessian": fit.hessian, "converged": bool(fit.converged), "components": fit.components()})
    for name in ("varcomp", "fixed", "blups", "wald", "dimensions"):
        getattr(fit, name)().write.mode("overwrite").parquet(f"{path}/{name}")


def load_result(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    return _read_json(spark, f"{path}/result"), {n: spark.read.parquet(f"{path}/{n}") for n in ("varcomp", "fixed", "blups", "wald", "dimensions")}
