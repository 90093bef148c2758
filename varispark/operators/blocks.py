"""Mixed models whose many random effects lie within blocks of rows: the likelihood by eliminating each block where it lies.

Rows of different blocks (farms, families, shops, sites) share the fixed effects and a few crossed factors, the border; all
other effects belong to one block. In the mixed-model equations a block's effects then meet only each other and the
border. One pass sums up each block's cross-products, which don't depend on the parameters. Each evaluation of the likelihood
is a job: every block factorises its own part of the equations and sends what elimination leaves on the border, and Spark
adds these up. A second job, with the border's inverse sent back, gives what derivatives need: the entries of the inverse on
the pattern of the sums, traces and working columns. No matrix as large as the number of effects is formed anywhere; the
driver holds the border and a task one block at a time.

So V = A + UU' is never formed either: A, the covariance within blocks, is what is eliminated, and U is the border.

Effects of a block are those of its local terms: levels are told apart within the block, so one that is in two blocks is two
effects. Local terms are independent levels or have a relationship (relationships among a block's levels as a table of
entries, or a pedigree), and any covariance between traits that isn't singular. A block has at most max_local effects;
how many rows it has doesn't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.functions import structures
from varispark.operators import reml
from varispark.operators.reml import Effects, Fit, Likelihood, Model
from varispark.plans.grammar import Term, parse_random
from varispark.shipping import ship
from varispark.storage import checkpointed

_PACKED = "labels array<array<string>>, q array<int>, cell array<int>, i array<int>, j array<int>, x array<double>, kinv array<array<double>>, logk array<double>"


def pedigree(animals: DataFrame, block: str, animal: str = "animal", sire: str = "sire", dam: str = "dam") -> DataFrame:
    """Relationships (block, a, b, x) of each block's animals, inbreeding included, from their parents; a parent that isn't listed
    in the block, or null, is unknown and unrelated. An animal is listed once."""
    ship(animals.sparkSession)
    kind = animals.schema[block].dataType.simpleString()

    def one(part: pd.DataFrame) -> pd.DataFrame:
        names = part["a"].tolist()
        at = {n: k for k, n in enumerate(names)}
        if len(at) < len(names):
            raise ValueError("an animal is listed twice in a block")
        parents = [[at[p] for p in (s, d) if p in at] for s, d in zip(part["s"], part["d"])]
        order, state = [], [0] * len(names)
        for first in range(len(names)):  # parents before their offspring
            stack = [first]
            while stack:
                k = stack[-1]
                ahead = [p for p in parents[k] if state[p] != 2]
                if state[k] == 1 and any(state[p] == 1 for p in ahead):
                    raise ValueError("an animal is its own ancestor")
                if state[k] == 2 or not ahead:
                    stack.pop()
                    if state[k] != 2:
                        state[k] = 2
                        order.append(k)
                else:
                    state[k] = 1
                    stack += ahead
        a = np.zeros((len(names),) * 2)
        done: list[int] = []
        for k in order:
            p = parents[k]
            a[k, done] = a[done, k] = sum((a[q, done] for q in p), np.zeros(len(done))) / 2
            a[k, k] = 1 + (a[p[0], p[1]] / 2 if len(p) == 2 else 0.0)
            done.append(k)
        i, j = np.nonzero(np.tril(a))
        return pd.DataFrame({"block": [part["block"].iloc[0]] * len(i), "a": [names[k] for k in i], "b": [names[k] for k in j], "x": a[i, j]})

    rows = animals.select(F.col(block).alias("block"), *[F.col(c).cast("string").alias(n) for c, n in ((animal, "a"), (sire, "s"), (dam, "d"))])
    return rows.groupBy("block").applyInPandas(one, f"block {kind}, a string, b string, x double")


def _sums(model: Model, terms: list[Term], traits: int, block: str, unit: bool) -> DataFrame:
    """Each block's cross-products of local effects with each other and with the border: block, cell (pattern, t1, t2), term,
    trait and level of the first, those of the second or its place in the border, x."""
    rows = model.rows.withColumn("block", F.col(f"__keep_{block}"))
    level = lambda t: F.concat_ws("|", *[F.col(f"__keep_{c}").cast("string") for c in t.factors])
    local = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("t") if t.struct != "iid" and traits > 1 else F.lit(0)).cast("int").alias("v"), level(t).alias("l"), F.col("scale").alias("x")) for k, t in enumerate(terms)])
    keys = ["t1", "t2", "ki", "vi", "li", "kj", "vj", "lj", "c"]
    if not unit:  # every row is a unit of its own: its pairs are written out and stay in generated code
        rows = rows.withColumns({f"l{k}": level(t) for k, t in enumerate(terms)} | {f"v{k}": (F.col("t") if t.struct != "iid" and traits > 1 else F.lit(0)).cast("int") for k, t in enumerate(terms)})
        own, none = F.col("t").cast("int"), F.lit(None).cast("string")
        first = lambda k: (own.alias("t1"), own.alias("t2"), F.lit(k).alias("ki"), F.col(f"v{k}").alias("vi"), F.col(f"l{k}").alias("li"))
        both = [F.struct(*first(a), F.lit(b).alias("kj"), F.col(f"v{b}").alias("vj"), F.col(f"l{b}").alias("lj"), F.lit(-1).alias("c"), (F.col("scale") * F.col("scale")).alias("x")) for a in range(len(terms)) for b in range(a, len(terms))]
        beside = [F.struct(*first(a), F.lit(-1).alias("kj"), F.lit(0).alias("vj"), none.alias("lj"), F.col("e.c").cast("int").alias("c"), (F.col("scale") * F.col("e.x")).alias("x")) for a in range(len(terms))]
        pattern = F.col("t").cast("string").alias("pattern")
        kept = ["block", "t", "scale", *[f"{c}{k}" for k in range(len(terms)) for c in "lv"]]
        pairs = rows.select("block", pattern, F.inline(F.array(*both))).unionByName(rows.select(*kept, F.explode("coo").alias("e")).select("block", pattern, F.inline(F.array(*beside))))
        return pairs.where("x <> 0").groupBy("block", "pattern", *keys).agg(F.sum("x").alias("x"))
    own = F.struct(F.col("t"), local.alias("loc"), F.col("coo"))
    units = rows.groupBy("block", "unit").agg(F.array_sort(F.collect_list(own)).alias("recs"))  # as many as there are traits
    pattern = F.array_join(F.transform("recs", lambda r: r["t"].cast("string")), ",")

    def pair(a, b=None, e=None, r1=None, r2=None):
        none = F.lit(None)
        second = (b["k"], b["v"], b["l"], F.lit(-1), b["x"]) if b is not None else (F.lit(-1), F.lit(0), none.cast("string"), e["c"], e["x"])
        return F.struct(r1["t"].alias("t1"), r2["t"].alias("t2"), a["k"].alias("ki"), a["v"].alias("vi"), a["l"].alias("li"), second[0].alias("kj"), second[1].alias("vj"), second[2].alias("lj"), second[3].cast("int").alias("c"), (a["x"] * second[4]).alias("x"))

    def of(r1, r2):
        apart = r1["t"] < r2["t"]
        both = F.flatten(F.transform(r1["loc"], lambda a, p: F.transform(F.filter(r2["loc"], lambda b, q: apart | (q >= p)), lambda b: pair(a, b=b, r1=r1, r2=r2))))
        beside = F.flatten(F.transform(r1["loc"], lambda a: F.transform(r2["coo"], lambda e: pair(a, e=e, r1=r1, r2=r2))))
        back = F.flatten(F.transform(F.filter(r2["loc"], lambda a: apart), lambda a: F.transform(r1["coo"], lambda e: pair(a, e=e, r1=r1, r2=r2))))
        return F.concat(both, beside, back)

    pairs = F.flatten(F.transform("recs", lambda r1: F.flatten(F.transform(F.filter("recs", lambda r2: r2["t"] >= r1["t"]), lambda r2: of(r1, r2)))))
    return units.select("block", pattern.alias("pattern"), F.inline(pairs)).where("x <> 0").groupBy("block", "pattern", *keys).agg(F.sum("x").alias("x"))


def _pack(sums: DataFrame, terms: list[Term], t: list[int], cells: dict, kin: DataFrame | None, max_local: int) -> DataFrame:
    """One row for each block: its levels, the sums by numbers, and inverses of its relationships."""
    ship(sums.sparkSession)
    kind = sums.schema["block"].dataType.simpleString()

    def one(part: pd.DataFrame, related: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"block": []} | {c.split()[0]: [] for c in _PACKED.split(", ")})
        labels, kinv, logk, offset, at = [], [], [], [], 0
        for k, term in enumerate(terms):
            seen = sorted(set(part.loc[part["ki"] == k, "li"]))
            if term.level == "fixed":
                mine = related[related["k"] == k]
                every = sorted(set(mine["a"]) | set(mine["b"]))
                missing = set(seen) - set(every)
                if missing:
                    raise ValueError(f"{term.name}: no relationship for {sorted(missing)[:5]}")
                place = {v: n for n, v in enumerate(every)}
                a, b = mine["a"].map(place).to_numpy(), mine["b"].map(place).to_numpy()
                m = np.zeros((len(every),) * 2)
                m[a, b] = m[b, a] = mine["x"].to_numpy()
                m = reml._positive(m)
                low = np.linalg.cholesky(m)
                kinv.append(np.linalg.inv(m).ravel())
                logk.append(2 * float(np.log(np.diag(low)).sum()))
                seen = every
            else:
                kinv.append(np.zeros(0))
                logk.append(0.0)
            labels.append(seen)
            offset.append(at)
            at += t[k] * len(seen)
        if at > max_local:
            raise ValueError(f"a block has {at} effects, more than {max_local}")
        i, j = np.zeros(len(part), dtype=np.int32), at + part["c"].to_numpy()
        for k, x in enumerate(labels):
            code = pd.Index(x, dtype=object)
            for out, side in ((i, "i"), (j, "j")):
                here = (part[f"k{side}"] == k).to_numpy()
                out[here] = offset[k] + part[f"v{side}"].to_numpy()[here] * len(x) + code.get_indexer(part[f"l{side}"].to_numpy()[here])
        kinds, back = np.unique(part["pattern"].astype(str) + ":" + part["t1"].astype(str) + ":" + part["t2"].astype(str) if len(cells) > 1 else np.zeros(len(part)), return_index=True, return_inverse=True)[1:]
        cell = np.array([cells[part["pattern"].iloc[n], part["t1"].iloc[n], part["t2"].iloc[n]] for n in kinds])[back]
        return pd.DataFrame({"block": [part["block"].iloc[0]], "labels": [labels], "q": [[len(x) for x in labels]], "cell": [cell], "i": [i], "j": [j], "x": [part["x"].to_numpy()], "kinv": [kinv], "logk": [logk]})

    if kin is None:
        return sums.groupBy("block").applyInPandas(lambda part: one(part), f"block {kind}, {_PACKED}")
    return sums.groupBy("block").cogroup(kin.groupBy("block")).applyInPandas(one, f"block {kind}, {_PACKED}")


def _gathered(model: Model, terms: list[Term], t: list[int], traits: int, block: str, cells: dict, max_local: int) -> DataFrame:
    """As _pack of _sums, for rows that are units of their own: rows are dealt and sorted by block, once, and each block's sums are
    formed where its rows pass by, so neither pairs of entries nor all rows of a block are held anywhere."""
    ship(model.rows.sparkSession)
    level = lambda x: F.concat_ws("|", *[F.col(f"__keep_{c}").cast("string") for c in x.factors])
    rows = model.rows.select(F.col(f"__keep_{block}").alias("block"), F.col("t").cast("int").alias("t"), "scale", F.col("coo.c").alias("c"), F.col("coo.x").alias("x"), *[level(x).alias(f"l{k}") for k, x in enumerate(terms)])
    kind, n_terms, by_trait = rows.schema["block"].dataType.simpleString(), len(terms), [x.struct != "iid" and traits > 1 for x in terms]
    cell_of = np.array([cells.get((str(v), v, v), -1) for v in range(traits)])
    border = np.int64(1) << 62  # effects are term, trait and number of the level in one whole number; columns of the border come after them

    class Sums:
        """Sums of one block, by cell and the two effects."""

        def __init__(self):
            self.levels: list[dict] = [{} for _ in terms]
            self.key, self.x = np.zeros((3, 0), dtype=np.int64), np.zeros(0)
            self.waiting: list[tuple] = []

        def add(self, part: pa.RecordBatch) -> None:
            v, scale = part.column("t").to_numpy(), part.column("scale").to_numpy()
            cell, effects = cell_of[v], []
            for k in range(n_terms):
                coded = part.column(f"l{k}").dictionary_encode()
                known = self.levels[k]
                number = np.array([known.setdefault(name, len(known)) for name in coded.dictionary.to_pylist()], dtype=np.int64)
                effects.append((np.int64(k) << 52) + ((v if by_trait[k] else 0 * v).astype(np.int64) << 40) + number[coded.indices.to_numpy()])
            n_effects = sum(tk * len(x) for tk, x in zip(t, self.levels))
            if n_effects > max_local:
                raise ValueError(f"a block has {n_effects} effects, more than {max_local}")
            lists = part.column("c")
            of = np.repeat(np.arange(len(v)), pa.compute.list_value_length(lists).to_numpy())
            c, x = border + lists.flatten().to_numpy().astype(np.int64), part.column("x").flatten().to_numpy() * scale[of]
            for a in range(n_terms):
                for b in range(a, n_terms):
                    self.waiting.append((cell, effects[a], effects[b], scale * scale))
                self.waiting.append((cell[of], effects[a][of], c, x))
            if sum(len(w[3]) for w in self.waiting) > 500_000:
                self.settle()

        def settle(self) -> None:
            key = np.concatenate([self.key, *[np.stack(w[:3]) for w in self.waiting]], axis=1)
            x = np.concatenate([self.x, *[w[3] for w in self.waiting]])
            order = np.lexsort(key[::-1])
            key, x = key[:, order], x[order]
            first = np.nonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))[0]
            self.key, self.x, self.waiting = key[:, first], np.add.reduceat(x, first), []

        def row(self) -> dict:
            self.settle()
            labels = [sorted(x) for x in self.levels]
            q = [len(x) for x in labels]
            offset = np.concatenate([[0], np.cumsum([a * b for a, b in zip(t, q)])]).astype(np.int64)
            places = []
            for known, names in zip(self.levels, labels):
                place = np.zeros(len(names), dtype=np.int64)
                place[[known[name] for name in names]] = np.arange(len(names))
                places.append(place)
            keep = self.x != 0
            cell, first, second = self.key[:, keep]

            def at(e: np.ndarray) -> np.ndarray:
                out = np.where(e >= border, offset[-1] + (e - border), 0)
                for k, place in enumerate(places):
                    mine = (e < border) & (e >> 52 == k)
                    out[mine] = offset[k] + ((e[mine] >> 40) & 0xFFF) * q[k] + place[e[mine] & 0xFFFFFFFFFF]
                return out

            return {"labels": labels, "q": q, "cell": cell, "i": at(first), "j": at(second), "x": self.x[keep], "kinv": [[] for _ in terms], "logk": [0.0] * n_terms}

    types = {"labels": pa.list_(pa.list_(pa.string())), "q": pa.list_(pa.int32()), "cell": pa.list_(pa.int32()), "i": pa.list_(pa.int32()), "j": pa.list_(pa.int32()), "x": pa.list_(pa.float64()), "kinv": pa.list_(pa.list_(pa.float64())), "logk": pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_, now, sums, done, held = None, None, None, [], 0

        def packed() -> pa.RecordBatch:
            names = pa.array([b for b, _ in done], kind_)
            return pa.RecordBatch.from_arrays([names, *[pa.array([r[c] for _, r in done], kind_of) for c, kind_of in types.items()]], names=["block", *types])

        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column("block")
            kind_ = ids.type
            cuts = [0, *(np.nonzero(pa.compute.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))[0] + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts, cuts[1:]):
                name = ids[lo].as_py()
                if sums is None or name != now:
                    if sums is not None:
                        done.append((now, sums.row()))
                        held += len(done[-1][1]["x"])
                    now, sums = name, Sums()
                    if held > 500_000:
                        yield packed()
                        done, held = [], 0
                sums.add(batch.slice(lo, hi - lo))
        if sums is not None:
            done.append((now, sums.row()))
        if done:
            yield packed()

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, f"block {kind}, {_PACKED}")


class _Block:
    """One block's part of the equations at given parameters.

    Effects of one term, the leaf, whose levels never meet each other are eliminated level by level, and only the others' equations are
    dense: with D the leaf's own small matrices and G what they are beside the others, the inverse is D^-1 and U S^-1 U', U = (-G, I).
    """

    def __init__(self, row: dict, t: list[int], size: int, same: np.ndarray):
        self.labels, self.t, self.size = row.get("labels"), t, size
        self.q = [int(x) for x in row["q"]]
        self.offset = np.concatenate([[0], np.cumsum([a * b for a, b in zip(t, self.q)])]).astype(int)
        self.n = int(self.offset[-1])
        self.cell, self.i, self.j, self.x = (np.asarray(row[c]) for c in ("cell", "i", "j", "x"))
        self.kinv = [np.asarray(k).reshape(q, q) if len(k) else None for k, q in zip(row["kinv"], self.q)]
        self.logk = np.asarray(row["logk"], dtype=float)
        # Sums of one trait are of half of a symmetric matrix. Those of two traits are of one that isn't, and stand for its sum with
        # its transpose, which has their diagonal twice.
        one = same[self.cell]
        self.beside = self.j >= self.n
        inside = ~self.beside
        mirrored = inside & (~one | (self.i != self.j))
        self.often = np.where(one & (self.i != self.j), 2.0, 1.0)
        self.rows, self.cols = np.concatenate([self.i[inside], self.j[mirrored]]), np.concatenate([self.j[inside], self.i[mirrored]])
        self.source = np.concatenate([np.nonzero(inside)[0], np.nonzero(mirrored)[0]])
        self.leaf, self.lo, self.hi, self.tl, self.ql = None, 0, 0, 1, 0
        for k in sorted(range(len(t)), key=lambda k: -t[k] * self.q[k]):
            lo, hi, q = self.offset[k], self.offset[k + 1], self.q[k]
            own = (self.rows >= lo) & (self.rows < hi) & (self.cols >= lo) & (self.cols < hi)
            if self.kinv[k] is None and q and not ((self.rows[own] - self.cols[own]) % q).any():
                self.leaf, self.lo, self.hi, self.tl, self.ql = k, int(lo), int(hi), t[k], q
                break
        self.rest = np.concatenate([np.arange(self.lo), np.arange(self.hi, self.n)])
        self.at = np.arange(self.n) - self.lo  # place in the leaf or among the others
        self.at[self.rest] = np.arange(len(self.rest))
        self.in_leaf = np.zeros(self.n, dtype=bool)
        self.in_leaf[self.lo : self.hi] = True

    def weighted(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weighted sums: of local effects, in the order of rows and cols, and what each local effect is beside the border and the response."""
        x, here = weights[self.cell] * self.x, self.beside
        return x[self.source], np.bincount(self.i[here] * self.size + self.j[here] - self.n, weights=x[here], minlength=self.n * self.size).reshape(self.n, self.size)

    def times(self, sums: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The weighted sums of local effects times the columns of b."""
        return np.stack([np.bincount(self.rows, weights=sums * c[self.cols], minlength=self.n) for c in b.T], axis=1) if b.shape[1] else np.zeros((self.n, 0))

    def _leafwise(self, d: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The leaf's small matrices times its rows x."""
        return np.einsum("qab,bqw->aqw", d, x.reshape(self.tl, self.ql, x.shape[1])).reshape(x.shape)

    def solve(self, sums: np.ndarray, beside: np.ndarray, sigma_inv: list[np.ndarray]) -> tuple[np.ndarray, float]:
        """The inverse of the block's equations, kept in parts, times what is beside it, and the log determinant."""
        r, c, t, q, m = self.rows, self.cols, self.tl, self.ql, len(self.rest)
        left, right = self.in_leaf[r], self.in_leaf[c]
        k = left & right
        i, j = self.at[r[k]], self.at[c[k]]
        d = np.bincount(((i % max(q, 1)) * t + i // max(q, 1)) * t + j // max(q, 1), weights=sums[k], minlength=q * t * t).astype(float).reshape(q, t, t)
        k = left & ~right
        b = np.bincount(self.at[r[k]] * m + self.at[c[k]], weights=sums[k], minlength=q * t * m).astype(float).reshape(q * t, m)
        k = ~left & ~right
        others = np.bincount(self.at[r[k]] * m + self.at[c[k]], weights=sums[k], minlength=m * m).astype(float).reshape(m, m)  # sums of nothing are whole numbers
        for n, s in enumerate(sigma_inv):
            if n == self.leaf:
                d += s
            elif self.q[n]:
                at = slice(self.at[self.offset[n]], self.at[self.offset[n + 1] - 1] + 1)
                others[at, at] += np.kron(s, np.eye(self.q[n]) if self.kinv[n] is None else self.kinv[n])
        low = np.linalg.cholesky(d)
        self.d = np.linalg.inv(d)
        self.g = self._leafwise(self.d, b)
        others -= b.T @ self.g
        low_s = np.linalg.cholesky(others)
        self.s = np.linalg.inv(others)
        through = np.zeros((self.n, beside.shape[1]))
        first = self._leafwise(self.d, beside[self.lo : self.hi])
        through[self.rest] = self.s @ (beside[self.rest] - b.T @ first)
        through[self.lo : self.hi] = first - self.g @ through[self.rest]
        return through, 2 * float(np.log(np.diagonal(low, axis1=1, axis2=2)).sum() + np.log(np.diag(low_s)).sum())

    def between(self, h: np.ndarray) -> np.ndarray:
        """h' inverse h."""
        leaf = h[self.lo : self.hi]
        u = h[self.rest] - self.g.T @ leaf
        return leaf.T @ self._leafwise(self.d, leaf) + u.T @ self.s @ u

    def inner(self, through: np.ndarray, meet: np.ndarray) -> _Inner:
        """The inverse and through meet through', where they are asked for."""
        return _Inner(self, through, meet)


class _Inner:
    """A symmetric matrix of a block's effects: within levels of the leaf, of the leaf beside the others, and of the others."""

    def __init__(self, b: _Block, through: np.ndarray, meet: np.ndarray):
        self.b = b
        leaf, others, gs = through[b.lo : b.hi], through[b.rest], b.g @ b.s
        met = leaf @ meet
        per = lambda x: x.reshape(b.tl, b.ql, x.shape[1])
        self.own = b.d + np.einsum("aqn,bqn->qab", per(gs), per(b.g)) + np.einsum("aqn,bqn->qab", per(met), per(leaf))
        self.side = met @ others.T - gs
        self.others = b.s + others @ meet @ others.T

    def entries(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Entries i, j, in the leaf those of one level."""
        b, out = self.b, np.zeros(len(i))
        p, q, x, y = b.in_leaf[i], b.in_leaf[j], b.at[i], b.at[j]
        n = max(b.ql, 1)
        k = p & q
        out[k] = self.own[x[k] % n, x[k] // n, y[k] // n]
        k = p & ~q
        out[k] = self.side[x[k], y[k]]
        k = ~p & q
        out[k] = self.side[y[k], x[k]]
        k = ~p & ~q
        out[k] = self.others[x[k], y[k]]
        return out

    def diagonal(self) -> np.ndarray:
        return self.entries(np.arange(self.b.n), np.arange(self.b.n))

    def traces(self) -> list[np.ndarray]:
        """For each term the sums, by traits, with the inverse relationship of the levels."""
        b, out = self.b, []
        for k, (t, q) in enumerate(zip(b.t, b.q)):
            if k == b.leaf:
                out.append(self.own.sum(axis=0))
                continue
            at = b.at[b.offset[k] : b.offset[k + 1]]
            part = self.others[np.ix_(at, at)].reshape(t, q, t, q)
            out.append(np.einsum("aibi->ab", part) if b.kinv[k] is None else np.einsum("aibj,ij->ab", part, b.kinv[k]))
        return out


class BlockLikelihood(Likelihood):
    """The likelihood of a model with local terms; two jobs give its value and gradient."""

    def __init__(self, model: Model, table: DataFrame, cells: list[tuple], ml: bool = False):
        super().__init__(model, ml)
        self.table, self.cells = table, cells
        self.local = [k for k, e in enumerate(model.random) if e.absorbed is not None]
        self.parts = table.rdd.getNumPartitions()
        self._kept: dict[bytes, tuple] = {}

    @property
    def result(self) -> type:
        return BlockFit

    def __getstate__(self) -> dict:
        return super().__getstate__() | {"table": None, "_kept": {}}

    def split(self) -> None:
        """Elimination fills the border's equations, so they have no blocks of their own."""

    def _sigma(self, theta: np.ndarray, k: int) -> np.ndarray:
        e, (ss, _) = self.model.random[k], self.slices[k]
        return structures.sigma(theta[ss], e.term.struct, e.t, e.term.rank)

    def _residual_sigma(self, theta: np.ndarray) -> np.ndarray:
        m = self.model
        return structures.sigma(theta[self.residual[0]], m.residual.struct, len(m.traits), m.residual.rank)

    def _weights(self, full: np.ndarray, change: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each cell its entry of the inverse of the observed traits' covariance, and of inverse * change * inverse."""
        w, d = np.zeros(len(self.cells)), np.zeros((len(change), len(self.cells)))
        for k, (pattern, a, b) in enumerate(self.cells):
            ts = [int(v) for v in pattern.split(",")]
            inv = np.linalg.inv(full[np.ix_(ts, ts)])
            w[k] = inv[ts.index(a), ts.index(b)]
            for n, c in enumerate(change):
                d[n, k] = (inv @ c[np.ix_(ts, ts)] @ inv)[ts.index(a), ts.index(b)]
        return w, d

    def _total(self, frames, size: int) -> np.ndarray:
        """The sum of all partitions' arrays, added up in two steps, so that the driver gets the root of their number."""
        parts = self.table.drop("labels").mapInPandas(frames, "x array<double>")

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = None
            for pdf in batches:
                for x in pdf["x"]:
                    out = np.array(x) if out is None else out + x
            if out is not None:
                yield pd.DataFrame({"x": [out]})

        if self.parts > 16:
            parts = parts.repartition(math.isqrt(self.parts - 1) + 1).mapInPandas(add, "x array<double>")
        out = np.zeros(size)
        for r in parts.toLocalIterator():
            x = np.asarray(r["x"])
            if np.isnan(x).any():
                raise np.linalg.LinAlgError("a block is not positive definite")
            out += x
        return out

    def _shape(self):
        m = self.model
        return [m.random[k].t for k in self.local], m.m + 1, np.array([a == b for _, a, b in self.cells])

    def reduced(self, theta: np.ndarray) -> tuple[np.ndarray, float]:
        """The border's equations after all blocks are eliminated, and what they add to the log determinant."""
        c, logdet = self.weighted(theta)
        t, size, same = self._shape()
        sig = [self._sigma(theta, k) for k in self.local]
        inverses = [np.linalg.inv(s) for s in sig]
        logs = [np.linalg.slogdet(s)[1] for s in sig]
        w, _ = self._weights(self._residual_sigma(theta), [])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out, any_ = np.zeros(size * size + 1), False
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    b = _Block(row, t, size, same)
                    (sums, beside), any_ = b.weighted(w), True
                    try:
                        through, log_c = b.solve(sums, beside, inverses)
                    except np.linalg.LinAlgError:
                        out[:] = np.nan
                        break
                    out[:-1] -= (beside.T @ through).ravel()
                    out[-1] += log_c + sum(q * x + tk * y for q, x, tk, y in zip(b.q, logs, t, b.logk))
            if any_:
                yield pd.DataFrame({"x": [out]})

        total = self._total(run, size * size + 1)
        return c + total[:-1].reshape(size, size), logdet + total[-1]

    def _derivatives(self, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray | None]:
        """Value, gradient and average information; the last point's are kept."""
        key = np.asarray(theta, dtype=float).tobytes()
        if key in self._kept:
            return self._kept[key]
        m, h, grad = self.model, 1e-6, np.zeros(self.size)
        c, _, _, logdet, cinv, log_c = self.inverted(theta)
        solution, quad = self.refined(theta)
        value = logdet + self._log_c(c, log_c) + quad
        z = np.append(-solution, 1.0)
        meet = np.outer(z, z)
        if self.ml:
            meet[m.p : m.m, m.p : m.m] += np.linalg.inv(c[m.p :, m.p :])
        else:
            meet[: m.m, : m.m] += cinv
        t, size, same = self._shape()
        local, slices, rs = self.local, [self.slices[k][0] for k in self.local], self.residual[0]
        step = lambda j: np.eye(self.size)[j] * 1e-5
        sig = [self._sigma(theta, k) for k in local]
        inverses = [np.linalg.inv(s) for s in sig]
        change = [[(self._sigma(theta + step(j), k) - self._sigma(theta - step(j), k)) / 2e-5 for j in range(sl.start, sl.stop)] for k, sl in zip(local, slices)]
        back = [[d @ i for d in ds] for ds, i in zip(change, inverses)]  # what a local term's working columns are of its solution
        r_change = [(self._residual_sigma(theta + step(j)) - self._residual_sigma(theta - step(j))) / 2e-5 for j in range(rs.start, rs.stop)]
        full = self._residual_sigma(theta)
        w, wd = self._weights(full, r_change)
        n_par, n_cells = self.size, len(self.cells)
        # Working columns of the border's random terms, as combinations of its columns.
        effects = np.zeros((m.m, n_par))
        for e, (ss, sl) in zip(m.random, self.slices):
            if e.absorbed is not None:
                continue
            u = solution[e.offset : e.offset + e.t * e.q].reshape(e.t, e.q)
            k = m.random.index(e)
            for j in range(ss.start, ss.stop):
                d = (self._sigma(theta + step(j), k) - self._sigma(theta - step(j), k)) / 2e-5
                effects[e.offset : e.offset + e.t * e.q, j] = (d @ np.linalg.solve(self._sigma(theta, k), u)).ravel()
            for j in range(sl.start, sl.stop):
                kin = self.level(e, theta[sl]) + 1e-10 * np.eye(e.q)
                d = (self.level(e, (theta + step(j))[sl]) - self.level(e, (theta - step(j))[sl])) / 2e-5
                effects[e.offset : e.offset + e.t * e.q, j] = (d @ np.linalg.solve(kin, u.T)).T.ravel()
        border = np.vstack([effects, np.zeros((1, n_par))])
        lengths = [n_cells, n_cells, sum(x * x for x in t), n_par * n_par, n_par * n_par, size * n_par, size * n_par]
        cut = np.concatenate([[0], np.cumsum(lengths)]).astype(int)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out, any_ = np.zeros(cut[-1]), False
            part = [out[x:y] for x, y in zip(cut, cut[1:])]
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    bl = _Block(row, t, size, same)
                    (sums, local), any_ = bl.weighted(w), True
                    through, _ = bl.solve(sums, local, inverses)
                    x = through @ z  # the block's solution
                    inner, beside = bl.inner(through, meet), -through @ meet
                    every, out_ = np.zeros(len(bl.i)), bl.beside
                    every[~out_], every[out_] = inner.entries(bl.i[~out_], bl.j[~out_]), beside[bl.i[out_], bl.j[out_] - bl.n]
                    whole = np.concatenate([-x, z])
                    part[0] += np.bincount(bl.cell, weights=bl.x * every * bl.often, minlength=n_cells)
                    part[1] += np.bincount(bl.cell, weights=bl.x * whole[bl.i] * whole[bl.j] * bl.often, minlength=n_cells)
                    part[2] += np.concatenate([x.ravel() for x in inner.traces()])
                    own = np.zeros((bl.n, n_par))
                    for k, tk in enumerate(t):
                        lo, hi = bl.offset[k], bl.offset[k + 1]
                        for j, d in zip(range(slices[k].start, slices[k].stop), back[k]):
                            own[lo:hi, j] = (d @ x[lo:hi].reshape(tk, bl.q[k])).ravel()
                    here = bl.times(sums, own) + local @ border  # W'R^-1 q, local rows
                    there = local.T @ own
                    products = own.T @ here + border.T @ there
                    for n, j in enumerate(range(rs.start, rs.stop)):
                        moved, aside = bl.weighted(wd[n])
                        a = bl.times(moved, -x[:, None])[:, 0] + aside @ z
                        here[:, j] = a
                        there[:, j] = aside.T @ -x
                        products[j, :] += a @ own
                        products[:, j] += own.T @ a
                    part[3] += products.ravel()
                    part[4] += bl.between(here).ravel()
                    part[5] += there.ravel()
                    part[6] += (through.T @ here).ravel()
            if any_:
                yield pd.DataFrame({"x": [out]})

        total = self._total(run, int(cut[-1]))
        dots, quads, traces, products, inner, there, taken = (total[x:y].copy() for x, y in zip(cut, cut[1:]))
        products, inner, there, taken = products.reshape(n_par, n_par), inner.reshape(n_par, n_par), there.reshape(size, n_par), taken.reshape(size, n_par)
        # The border's own sums.
        base = np.zeros((size, size))
        first = np.zeros((size, n_par))
        for k, (pattern, a, bb) in enumerate(self.cells):
            g = m.cells[(None, pattern)][1].get((a, bb))
            if g is None:
                continue
            dots[k] += g.dot(meet)
            left = np.bincount(g.j, weights=g.x * z[g.i], minlength=size)
            quads[k] += float(left @ z)
            right = np.bincount(g.i, weights=g.x * z[g.j], minlength=size) if a != bb else 0.0
            g.add_to(base, w[k], both=a != bb)
            for n, j in enumerate(range(rs.start, rs.stop)):
                first[:, j] += wd[n, k] * (left + right)
        units = {p: u for (_, p), (u, _) in m.cells.items()}

        def residual(th: np.ndarray) -> float:
            s, out = self._residual_sigma(th), 0.0
            for p, u in units.items():
                ts = [int(v) for v in p.split(",")]
                out += u * np.linalg.slogdet(s[np.ix_(ts, ts)])[1]
            weights, _ = self._weights(s, [])
            return out + float((weights * dots * np.where(same, 1.0, 2.0)).sum())

        little = lambda j: np.eye(self.size)[j] * h
        for j in range(rs.start, rs.stop):
            grad[j] = (residual(theta + little(j)) - residual(theta - little(j))) / (2 * h)
        at = 0
        for k, sl, tk in zip(local, slices, t):
            trace, q = traces[at : at + tk * tk].reshape(tk, tk), m.random[k].absorbed
            at += tk * tk
            grad[sl] = reml.between_gradient(theta[sl], m.random[k].term, tk, q, trace)
        self._random_gradient(theta, meet, grad, h)
        # Working columns of the residual against each other and against those of the border's terms.
        design = base @ border + first + there
        products += border.T @ base @ border
        products[rs] += (first + there).T[rs] @ border
        products[:, rs] += border.T @ (first + there)[:, rs]
        for k, (pattern, a, bb) in enumerate(self.cells):
            ts = [int(v) for v in pattern.split(",")]
            inv, p, q = np.linalg.inv(full[np.ix_(ts, ts)]), ts.index(a), ts.index(bb)
            turned = [inv @ d[np.ix_(ts, ts)] for d in r_change]
            for i, x in enumerate(turned):
                for j, y in enumerate(turned):
                    v = x @ y @ inv
                    products[rs.start + i, rs.start + j] += quads[k] * (v[p, q] + (v[q, p] if a != bb else 0.0))
        reduced = (design - taken)[: m.m]
        information = products - inner - reduced.T @ cinv @ reduced
        information = (information + information.T) / 2
        out = value, grad, information
        self._kept = {key: out}
        return out

    def value_and_gradient(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        return self._derivatives(theta)[:2]

    def average_information(self, theta: np.ndarray) -> np.ndarray:
        if self.ml:
            raise ValueError("takes restricted likelihoods")
        return self._derivatives(theta)[2]


class BlockFit(Fit):
    """A fit whose local effects stay in their blocks: cinv and solution are the border's."""

    def _local(self, frames, schema: str) -> DataFrame:
        return self.likelihood.table.mapInPandas(frames, schema)

    def _inside(self):
        like, m = self.likelihood, self.model
        t, size, same = like._shape()
        inverses = [np.linalg.inv(like._sigma(self.theta, k)) for k in like.local]
        w, _ = like._weights(like._residual_sigma(self.theta), [])
        cinv, z = self.cinv, np.append(-self.solution, 1.0)

        def inside(row: dict) -> tuple[_Block, np.ndarray, _Inner]:
            """The block, its solution, and its part of the whole inverse."""
            b = _Block(row, t, size, same)
            through, _ = b.solve(*b.weighted(w), inverses)
            return b, through @ z, b.inner(through[:, :-1], cinv)

        return inside

    def local_blups(self) -> DataFrame:
        """block, term, trait, level, blup and pev of all local effects, computed where the blocks lie."""
        m, inside = self.model, self._inside()
        names = [m.random[k].name for k in self.likelihood.local]
        traits = [str(x) for x in m.traits]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    b, x, inv = inside(row)
                    pev, out = inv.diagonal(), []
                    for k, (name, t, q) in enumerate(zip(names, b.t, b.q)):
                        for v in range(t):
                            lo = b.offset[k] + v * q
                            out.append(pd.DataFrame({"block": [row["block"]] * q, "term": name, "trait": traits[v] if t > 1 else None, "level": list(b.labels[k]), "blup": x[lo : lo + q], "pev": pev[lo : lo + q]}))
                    yield pd.concat(out)

        kind = self.likelihood.table.schema["block"].dataType.simpleString()
        return self._local(run, f"block {kind}, term string, trait string, level string, blup double, pev double")

    def blups(self) -> DataFrame:
        """term, trait, level, blup, pev of the border's random effects and of the local ones, whose levels are block/level."""
        level = F.concat_ws("/", F.col("block").cast("string"), "level").alias("level")
        return super().blups().unionByName(self.local_blups().select("term", "trait", level, "blup", "pev"))

    def dimensions(self) -> DataFrame:
        like, inside, names = self.likelihood, self._inside(), [self.model.random[k].name for k in self.likelihood.local]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for row in pdf.to_dict("records"):
                    b, _, inv = inside(row)
                    out += [(name, q, float(x[0, 0])) for name, q, x in zip(names, b.q, inv.traces()) if len(x) == 1]
                yield pd.DataFrame(out, columns=["term", "q", "trace"])

        found = self._local(run, "term string, q long, trace double").groupBy("term").agg(F.sum("q").alias("q"), F.sum("trace").alias("trace")).collect()
        parts = self.components()
        rows = [(r["term"], r["q"], float(r["q"] - r["trace"] / parts[r["term"]])) for r in found]
        border = replace(self.model, random=[e for e in self.model.random if e.absorbed is None])
        own = Likelihood(border, like.ml)
        keep = np.concatenate([[j for sl in s for j in range(sl.start, sl.stop)] for e, s in zip(self.model.random, like.slices) if e.absorbed is None] + [list(range(like.residual[0].start, like.size))]).astype(int)
        rest = Fit(border, own, self.theta[keep], self.neg2, True, self.cinv, self.solution, np.zeros((len(keep),) * 2), np.zeros(len(keep), dtype=bool))
        local = self.spark.createDataFrame([(n, int(q), ed, ed / max(1, q - 1)) for n, q, ed in rows], "term string, q int, ed double, h2 double")
        return rest.dimensions().unionByName(local)


def build(df: DataFrame, fixed: str, local: str, block: str, random: str | None = None, residual: str | None = None, trait: str | None = None, unit: str | None = None, weights: str | None = None, relationships: dict[str, DataFrame] | None = None, max_local: int = 2_000, ml: bool = False, **options) -> BlockLikelihood:
    """The likelihood of a model with local terms, its sums packed by blocks.

    local: terms like those of random, whose levels are each block's own: factors, covariances between traits (diag, us, fa,
    chol, ante, corh), and vm(f, K), with relationships[K] a table (block, a, b, x) of each block's relationships, each pair
    once or twice; it may have levels without a record. Rows of a unit are in one block.
    """
    terms = parse_random(local)
    for t in terms:
        if t.level not in ("id", "fixed") or "parts" in t.options or t.struct == "rr" or "Kinv" in t.options:
            raise ValueError(f"{t.name} can't be local: local terms are factors and vm(f, K), with covariances that aren't singular")
        if t.level == "fixed" and t.options["K"] not in (relationships or {}):
            raise ValueError(f"{t.name}: no table of relationships {t.options['K']!r}")
    if not terms:
        raise ValueError("a model with blocks has a local term")
    keep = tuple(dict.fromkeys([block, *[c for t in terms for c in t.factors]]))
    model = reml.build(df, fixed, random, residual, trait=trait, unit=unit, weights=weights, absorb=None, keep=keep, **options)
    if model.residual.axes or model.residual.section or model.residual.struct == "none":
        raise ValueError("blocks take a residual of units without sections")
    if unit and model.rows.groupBy("unit").agg(F.min(f"__keep_{block}").alias("a"), F.max(f"__keep_{block}").alias("b")).where("a <> b").limit(1).count():
        raise ValueError("a unit has rows in two blocks")
    many = len(model.traits)
    t = [many if x.struct != "iid" and many > 1 else 1 for x in terms]
    cells = []
    for _, pattern in sorted(model.cells):
        ts = [int(v) for v in pattern.split(",")]
        cells += [(pattern, a, b) for a in ts for b in ts if a <= b]
    kin = None
    for k, x in enumerate(terms):
        if x.level == "fixed":
            part = relationships[x.options["K"]].select("block", F.lit(k).alias("k"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("x").cast("double").alias("x"))
            kin = part if kin is None else kin.unionByName(part)
    number = {c: n for n, c in enumerate(cells)}
    if unit or kin is not None:
        table = checkpointed(_pack(_sums(model, terms, many, block, bool(unit)), terms, t, number, kin, max_local))
    else:
        table = checkpointed(_gathered(model, terms, t, many, block, number, max_local))
    sizes = table.agg(*[F.sum(F.get("q", F.lit(k))).alias(f"q{k}") for k in range(len(terms))]).first()
    model.random = model.random + [Effects(x.name, -1, [], x, tk, absorbed=int(q)) for x, tk, q in zip(terms, t, sizes)]
    return BlockLikelihood(model, table, cells, ml)


def fit(like: BlockLikelihood, **options) -> BlockFit:
    """As reml.fit."""
    return reml.fit(like.model, like=like, ml=like.ml, **options)
