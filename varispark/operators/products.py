"""Products of two families' doses, row by row: what tests of them need, from rows in slabs and loci in tiles.

A locus's product has for each row the own dose times the sum of the neighbours' doses, so it isn't a column of the design and
its tests need sums over rows: with the residuals, with itself and with each column of the design. Rows are packed into slabs once;
each slab meets each tile of loci in a task of its own, which returns these sums, and a second step adds them up over slabs and
takes off what the model explains. Neither rows nor loci nor their products come to the driver; what a task holds is a slab, a
tile, and the equations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.functions import structures
from varispark.operators.reml import Fit
from varispark.shipping import ship
from varispark.storage import checkpointed

#: Rows of a slab and loci of a tile, about; products of so many loci at a time.
SLAB, TILE, STEP = 50_000, 256, 32


def slabs(fit: Fit, rows: int = SLAB) -> DataFrame:
    """The model's rows, packed: slab, then for each row its section, trait and unit, and its entries by row, column and value.
    Rows of a unit are in one slab."""
    m = fit.model
    if m.residual.axes or m.absorbed or m.rows is None:
        raise ValueError("products of doses take models of units without an absorbed factor, built in this session")
    ship(fit.spark)
    n = max(1, -(-m.n // rows))
    sections = {s: k for k, s in enumerate(m.sections)}
    if "unit" in m.rows.columns:
        dealt = m.rows.withColumn("slab", F.pmod(F.xxhash64("section", "unit"), F.lit(n)))
    else:  # each row is a unit; numbers stay as they are once they are written
        dealt = checkpointed(m.rows.withColumn("unit", F.monotonically_increasing_id())).withColumn("slab", F.pmod(F.xxhash64("unit"), F.lit(n)))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["unit", "t"])
        size = part["coo"].map(len).to_numpy()
        entries = [e for row in part["coo"] for e in row]
        section = [sections.get(None if s is None or s != s else s, 0) for s in part["section"]]
        return pd.DataFrame({"slab": [part["slab"].iloc[0]], "section": [section], "t": [part["t"].to_numpy()], "unit": [pd.factorize(part["unit"])[0]], "row": [np.repeat(np.arange(len(part)), size)], "col": [[e["c"] for e in entries]], "x": [[e["x"] for e in entries]]})

    packed = dealt.select("slab", "section", "t", "unit", "coo").groupBy("slab").applyInPandas(pack, "slab long, section array<int>, t array<int>, unit array<int>, row array<int>, col array<int>, x array<double>")
    return checkpointed(packed)


class _Slab:
    """A slab's design, residuals and inverse residual covariance."""

    def __init__(self, s: dict, m: int, sigmas: list[np.ndarray], solution: np.ndarray, at: dict[str, list[tuple[int, int]]]):
        self.m, self.t, unit = m, np.asarray(s["t"]), np.asarray(s["unit"])
        row, col, x = np.asarray(s["row"]), np.asarray(s["col"]), np.asarray(s["x"], dtype=float)
        self.n = len(self.t)
        e = np.zeros(self.n)
        np.add.at(e, row[col == m], x[col == m])
        own = col < m
        row, col, x = row[own], col[own], x[own]
        e -= np.bincount(row, weights=x * solution[col], minlength=self.n)
        order = np.argsort(col, kind="stable")
        self.by_col = row[order], col[order], x[order]
        self.filled, self.starts = np.unique(col[order], return_index=True)
        self.dose = {}
        for f, ranges in at.items():  # entries of the family's term, by row, and the dose that each takes
            mine = np.zeros(len(col), dtype=bool)
            level = np.zeros(len(col), dtype=int)
            for a, b in ranges:
                inside = (col >= a) & (col < b)
                mine |= inside
                level[inside] = col[inside] - a
            r = row[mine]
            by_row = np.argsort(r, kind="stable")
            some, first = np.unique(r[by_row], return_index=True)
            self.dose[f] = some, first, level[mine][by_row], x[mine][by_row]
        # Entries of the inverse covariance, unit by unit: units with the same traits share one.
        a, b, v = [], [], []
        if self.n:
            cut = np.concatenate([[0], np.nonzero(np.diff(unit))[0] + 1, [self.n]])
            section = np.asarray(s["section"])
            cache: dict[tuple, np.ndarray] = {}
            for lo, hi in zip(cut, cut[1:]):
                key = (section[lo], *self.t[lo:hi])
                if key not in cache:
                    ts = list(key[1:])
                    cache[key] = np.linalg.inv(sigmas[key[0]][np.ix_(ts, ts)])
                k = hi - lo
                a.append(np.repeat(np.arange(lo, hi), k))
                b.append(np.tile(np.arange(lo, hi), k))
                v.append(cache[key].ravel())
        self.a, self.b, self.v = (np.concatenate(z) if z else np.zeros(0, dtype=int) for z in (a, b, v))
        self.first = np.unique(self.a, return_index=True)[1]
        self.weighted_residuals = self.inverse(e[:, None])[:, 0] if self.n else e

    def inverse(self, u: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.v[:, None] * u[self.b], self.first, axis=0)

    def doses(self, f: str, s: np.ndarray) -> np.ndarray:
        """Each row's sum of a family's doses, a column for each locus."""
        out = np.zeros((self.n, len(s)))
        some, first, level, x = self.dose[f]
        if len(some):
            out[some] = np.add.reduceat(x[:, None] * s.T[level], first, axis=0)
        return out

    def design(self, v: np.ndarray) -> np.ndarray:
        """W'v."""
        row, _, x = self.by_col
        out = np.zeros((self.m, v.shape[1]))
        if len(row):
            out[self.filled] = np.add.reduceat(x[:, None] * v[row], self.starts, axis=0)
        return out


def products(fit: Fit, markers: DataFrame, families: dict[str, list[slice]], rows: int = SLAB, tile: int = TILE) -> DataFrame:
    """snp, and of its products by traits: num (scores), den (information, row by row) and cross (information with each family and
    trait: family, its trait, the product's trait). families: columns of dir and ind in the model, by trait.

    markers: snp, dose. Each snp is there once.
    """
    m = fit.model
    packed = slabs(fit, rows)
    many, t = m.m, len(m.traits)
    at = {f: [(k.start, k.stop) for k in s] for f, s in families.items()}
    sigmas = [structures.sigma(fit.theta[sl], m.structure(s).struct, t, m.structure(s).rank) for s, sl in zip(m.sections, fit.likelihood.residual)]
    gram = fit.likelihood.reduced(fit.theta)[0][:many, :many]
    held = fit.spark.sparkContext.broadcast((fit.solution, fit.cinv, gram))  # as large as the equations
    n_tiles = max(1, -(-markers.count() // tile))
    kind = markers.schema["snp"].dataType.simpleString()
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = packed.withColumn("tile", every(n_tiles))
    right = markers.select("snp", F.transform("dose", lambda x: x.cast("double")).alias("dose"), F.pmod(F.xxhash64("snp"), F.lit(n_tiles)).alias("tile")).withColumn("slab", every(max(1, -(-m.n // rows))))

    def meet(slab: pd.DataFrame, loci: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(slab) and len(loci):
            own = _Slab(slab.to_dict("records")[0], many, sigmas, held.value[0], at)
            s, names = np.stack(loci["dose"].to_numpy()).astype(float), loci["snp"].tolist()
            for lo in range(0, len(s), STEP):
                part = s[lo : lo + STEP]
                u = own.doses("dir", part) * own.doses("ind", part)
                by = [np.where((own.t == k)[:, None], u, 0.0) for k in range(t)]
                back = [own.inverse(x) for x in by]
                num = np.stack([own.weighted_residuals @ x for x in by], axis=1)
                den = np.stack([(x * y).sum(axis=0) for x in by for y in back], axis=1)
                w = np.stack([own.design(y) for y in back], axis=2)  # columns, loci, traits
                for k in range(len(part)):
                    out.append((int(loci["tile"].iloc[0]), names[lo + k], num[k], den[k], w[:, k].ravel()))
        return pd.DataFrame(out, columns=["tile", "snp", "num", "den", "w"])

    sums = left.groupBy("slab", "tile").cogroup(right.groupBy("slab", "tile")).applyInPandas(meet, f"tile long, snp {kind}, num array<double>, den array<double>, w array<double>")

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        _, cinv, g = held.value
        out = []
        for snp, rows_ in part.groupby("snp", sort=False):
            num, den, w = (np.sum(np.stack(rows_[c].to_numpy()), axis=0) for c in ("num", "den", "w"))
            w = w.reshape(many, t)
            solved = cinv @ w
            dose = rows_["dose"].iloc[0]
            left_over = w - g @ solved
            cross = [float(np.asarray(dose) @ left_over[a:b, k]) for f in ("dir", "ind") for a, b in at[f] for k in range(t)]
            out.append((snp, num, (den.reshape(t, t) - w.T @ solved).ravel(), cross))
        return pd.DataFrame(out, columns=["snp", "num", "den", "cross"])

    doses = markers.select("snp", F.transform("dose", lambda x: x.cast("double")).alias("dose"))
    return sums.join(doses, "snp").groupBy("tile").applyInPandas(lambda part: finish(part), f"snp {kind}, num array<double>, den array<double>, cross array<double>")


def design_of(fit: Fit, families: dict[str, str]) -> dict[str, list[slice]]:
    """The columns of the terms of dir and ind, by trait."""
    from varispark.operators.genome import blocks

    missing = [f for f in ("dir", "ind") if f not in families]
    if missing:
        raise ValueError(f"products take terms of dir and ind: no term for {', '.join(missing)}")
    return {f: blocks(fit.model, families[f]) for f in ("dir", "ind")}
