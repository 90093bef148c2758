"""Linear mixed models by restricted maximum likelihood.

One distributed pass turns the data into cross-products: every unit's non-zero design entries and responses are paired
within the unit and summed by pattern of observed traits and pair of traits. These sums do not depend on the variance
parameters, and only their non-zero entries are kept. The driver then iterates on mixed-model equations as large as the
number of effects, without touching the data again; that number of effects, and not the number of rows, has to fit.

One factor of independent levels may be absorbed: its part of the equations is diagonal, so its levels can be eliminated
one by one where they lie. A level with n rows enters the others' equations through the outer product of its sums, times
a weight that depends on n and the variances only. So these products are summed over the levels of each n, once, and
neither the driver's memory nor its time depends on the number of levels, whose solutions stay in a table.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varispark.functions import bordered, cone, optimise, splines, structures
from varispark.functions.special import chi2_sf, normal_ppf
from varispark.plans.grammar import Residual, Term, parse_fixed, parse_random, parse_residual
from varispark.shipping import ship
from varispark.storage import checkpointed


@dataclass
class Effects:
    """Columns of one fixed term or of one random term's levels."""

    name: str
    offset: int
    labels: list
    term: Term | None = None
    t: int = 1
    columns: list | None = None  # of a fixed term: its columns, each with its levels, none for a number
    absorbed: int | None = None  # number of levels of a factor that has no place in the equations
    pos: np.ndarray | None = None
    axes: list[int] | None = None
    k: np.ndarray | str | None = None

    @property
    def q(self) -> int:
        return len(self.labels) if self.absorbed is None else self.absorbed


class Sums:
    """A matrix of cross-products by its non-zero entries."""

    def __init__(self, i, j, x, size: int, mirror: bool = False):
        i, j, x = np.asarray(i, dtype=np.int64), np.asarray(j, dtype=np.int64), np.asarray(x, dtype=float)
        if mirror:
            off = i != j
            i, j, x = np.concatenate([i, j[off]]), np.concatenate([j, i[off]]), np.concatenate([x, x[off]])
        key, where = np.unique(i * size + j, return_inverse=True)
        self.i, self.j, self.x, self.size = key // size, key % size, np.bincount(where, weights=x, minlength=len(key)), size

    def add_to(self, out: np.ndarray, weight: float, both: bool = False) -> None:
        """Adds a multiple; with both, of the sum with its transpose."""
        out[self.i, self.j] += weight * self.x
        if both:
            out[self.j, self.i] += weight * self.x

    def dot(self, other: np.ndarray) -> float:
        """Sum of the products with the entries of a matrix."""
        return float((other[self.i, self.j] * self.x).sum())

    def dense(self) -> np.ndarray:
        out = np.zeros((self.size, self.size))
        self.add_to(out, 1.0)
        return out

    def at(self, i: int, j: int) -> float:
        return float(self.x[(self.i == i) & (self.j == j)].sum())

    def diagonal(self) -> np.ndarray:
        out, own = np.zeros(self.size), self.i == self.j
        out[self.i[own]] = self.x[own]
        return out


@dataclass
class Absorbed:
    """Sums of the levels of an absorbed factor, by their number of rows, and the levels' own sums as a table."""

    by_n: dict[int, tuple[int, Sums]]  # number of levels with so many rows, and the sum of their outer products
    levels: DataFrame | None = None  # level, n, e: the sums of the other columns, by column

    def __post_init__(self):
        """All products on one pattern of entries, a row for each number of rows."""
        size = next(iter(self.by_n.values()))[1].size
        keys = [g.i * size + g.j for _, g in self.by_n.values()]
        self.keys = np.unique(np.concatenate(keys))
        self.table = np.zeros((len(keys), len(self.keys)))
        for k, (key, (_, g)) in enumerate(zip(keys, self.by_n.values())):
            self.table[k, np.searchsorted(self.keys, key)] = g.x

    def subtract(self, out: np.ndarray, weights: np.ndarray) -> None:
        out.ravel()[self.keys] -= weights @ self.table

    def dots(self, other: np.ndarray) -> np.ndarray:
        """For each number of rows the sum of the products with the entries of a matrix."""
        return self.table @ other.ravel()[self.keys]


@dataclass
class Model:
    """What the driver needs of the data: cross-products by (section, pattern), and the layout of effects."""

    fixed: list[Effects]
    random: list[Effects]
    residual: Residual
    traits: list
    sections: list
    cells: dict  # (section, pattern) -> (units, {(t1, t2): Sums of size m + 1})
    p: int
    m: int
    n: int
    log_weights: float = 0.0
    source: DataFrame | None = None
    response: str = ""
    spec: dict = field(default_factory=dict)
    absorbed: Absorbed | None = None
    rows: DataFrame | None = None  # section, t, unit and coo of each row, for likelihoods from V
    design: DataFrame | None = None  # coo: the entries of each row of [W y], for models of one plain residual
    grids: dict = field(default_factory=dict)  # section -> cells in each direction, for residuals on a lattice
    coder: Callable[[DataFrame, str], DataFrame] | None = None  # adds a column with the entries of each row of W

    def structure(self, section) -> Residual:
        """The residual of a section."""
        if not self.residual.bodies:
            return self.residual
        return self.residual.bodies[self.residual.names().index(section)]


def _levels(rows: DataFrame, columns: list[str], most: int) -> tuple[float, dict[str, list], dict[str, int]]:
    """The response's mean, the levels of each column that has no more than about so many, and about how many they are: a
    job that counts, and one that gathers what is small."""
    first = rows.agg(F.avg("__y"), *[F.approx_count_distinct(c, 0.02) for c in columns]).first()
    counts = dict(zip(columns, first[1:]))
    few = [c for c in columns if counts[c] <= 1.1 * most + 10]
    sets = rows.agg(*[F.collect_set(c) for c in few]).first() if few else []
    return float(first[0] or 0.0), {c: sorted(s) for c, s in zip(few, sets)}, counts


def _distinct(df: DataFrame, columns: list[str], most: int, known: dict[str, list] | None = None) -> pd.DataFrame:
    """Levels of a factor; more than most is an error, since effects are held on the driver."""
    if known and len(columns) == 1 and columns[0] in known:
        if len(known[columns[0]]) > most:
            raise ValueError(f"{columns} has more than {most} levels")
        return pd.DataFrame({columns[0]: known[columns[0]]})
    out = df.select(*columns).na.drop().distinct().orderBy(*columns).limit(most + 1).toPandas()
    if len(out) > most:
        raise ValueError(f"{columns} has more than {most} levels")
    return out


def _lattice(values: pd.Series) -> list[int]:
    """All positions of the lattice that holds the values: whole numbers have the largest step that they allow, others the
    smallest of their gaps, of which all gaps have to be multiples."""
    v = np.unique(values.to_numpy(dtype=float))
    if (v == np.rint(v)).all():
        step = math.gcd(*np.diff(v).astype(int).tolist()) if len(v) > 1 else 1
        return list(range(int(v[0]), int(v[-1]) + 1, step))
    places = (v - v[0]) / np.diff(v).min()
    if (np.abs(places - np.rint(places)) > 1e-6).any():
        raise ValueError("positions are on no lattice: their gaps aren't multiples of the smallest one")
    out = v[0] + np.diff(v).min() * np.arange(int(round(places[-1])) + 1)
    out[np.rint(places).astype(int)] = v  # as they were observed
    return out.tolist()


def build(df: DataFrame, fixed: str, random: str | None = None, residual: str | None = None, trait: str | None = None, unit: str | None = None, weights: str | None = None, matrices: dict | None = None, max_levels: int = 5_000, absorb: str | None = "auto", keep: tuple[str, ...] = ()) -> Model:
    """Parse the formulas, drop incomplete rows, lay out effects, and run the cross-product pass.

    absorb: the factor to absorb, None, or "auto" for the first plain factor with more than max_levels levels, if any. It
    takes one trait, one section and no weights. keep: columns that the coded rows have beside their entries, none of them null.
    """
    matrices = matrices or {}
    response, intercept, fixed_terms = parse_fixed(fixed)
    terms, res = parse_random(random), parse_residual(residual)
    if res.axes and (trait or unit or weights):
        raise ValueError("a residual on a lattice takes one trait and no weights")
    if trait and any("parts" in t.options for t in terms):
        raise ValueError("mm() and str() take one trait")
    used = sorted({c for t in fixed_terms for c in t} | {c.removeprefix("mm:") for t in terms for c in [*t.factors, *([t.options["at"]] if "at" in t.options else [])]} | {c for c in (trait, unit, weights, res.section, *(c for _, c in res.axes), *keep) if c})
    rows = df.select(F.expr(response).cast("double").alias("__y"), *used)
    rows = rows.na.drop().where(" and ".join(["true", *[f"`{c}` is not null" for c in used]]))
    surfaces, plain, made_for = {}, [], {}
    steps: list[Callable[[DataFrame], DataFrame]] = []  # what gives a row the codes of its levels
    for k, term in enumerate(terms):
        if term.level != "spl2d":
            plain.append(term)
            continue
        by = term.options.get("at")
        at_ = _distinct(rows, [*term.factors, *([by] if by else [])], max_levels)
        two = lambda text: (lambda v: (v * 2)[:2])([int(x) for x in str(text).strip("[]() ").split(",")])
        deg, pord = (int(term.options.get(o, d)) for o, d in (("deg", 3), ("pord", 2)))
        table = at_.set_axis([f"__s{k}_{i}" for i in range(at_.shape[1])], axis=1)
        for n, (level, part) in enumerate(at_.groupby(by, sort=True) if by else [(None, at_)]):
            x, y = part[term.factors[0]].to_numpy(float), part[term.factors[1]].to_numpy(float)
            made = splines.Surface(x, y, two(term.options.get("nseg", 5)), deg, pord, two(term.options.get("nest", 1)))
            lines, blocks = made.at(x, y)
            tag = f"{k}" if by is None else f"{k}_{n}"
            names = [f"spl{tag}_{c}" for c in (*term.factors, "both")]
            own = f"{term.name}" if by is None else f"{term.name}[{level}]"
            for c, v in zip(names, lines.T):
                table[c] = 0.0
                table.loc[part.index, c] = v
            for b, z in blocks.items():
                column = f"__s{tag}_{b}"
                table[column] = [[]] * len(table)
                for i, v in zip(part.index, z.tolist()):
                    table.at[i, column] = v
                plain.append(Term(f"{own}.{b}", [f"arr:{column}"], options={"parts": 1, "size": z.shape[1]}))
            fixed_terms += [(c,) for c in names]
            surfaces[own] = (term.factors, part[term.factors], lines, blocks, names)
            made_for[own] = made
        kinds_of = {c: "double" if not c.startswith("__s") else None for c in table.columns}
        schema = ", ".join(f"`{c}` " + (dict(rows.dtypes)[at_.columns[i]] if i < at_.shape[1] else "array<double>" if kinds_of[c] is None else "double") for i, c in enumerate(table.columns))
        joined = df.sparkSession.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in table.itertuples(index=False)], schema)
        same = [F.col(c) == F.col(f"__s{k}_{i}") for i, c in enumerate(at_.columns)]
        steps.append(lambda r, joined=joined, same=same: r.join(F.broadcast(joined), same, "left"))  # at most max_levels rows
        rows = steps[-1](rows)
    terms = plain
    types = dict(rows.dtypes)
    single = {c for t in fixed_terms for c in t if types.get(c) in ("string", "boolean")} | {c for t in terms if "parts" not in t.options and (len(t.factors) == 1 or t.level not in ("id", "fixed")) for c in t.factors}
    mean, known, counts = _levels(rows, sorted({c for c in single | {trait, res.section} if c in types}), max_levels)
    centre = 0.0
    if intercept:  # the likelihood is that of any y + c, and sums of squares of large numbers lose what is small beside them
        centre = mean
        rows = rows.withColumn("__y", F.col("__y") - F.lit(centre))
    kinds = dict(rows.dtypes)
    traits = _distinct(rows, [trait], 100, known)[trait].tolist() if trait else [None]
    if res.bodies:  # levels of the section column in groups, a residual for each
        known = [(v, n) for group, n in zip(res.groups, res.names()) for v in group]
        name = F.element_at(F.create_map(*[F.lit(x) for pair in known for x in pair]), F.col(res.section).cast("string"))
        rows = rows.withColumn("__section", name)
        if rows.where("__section is null").limit(1).count():
            raise ValueError(f"levels of {res.section} are in no group")
        res = Residual(section="__section", groups=res.groups, bodies=res.bodies)
    sections = _distinct(rows, [res.section], 1_000, known)[res.section].tolist() if res.section else [None]

    entries, many, at = [], [], 0
    one = lambda col, x: F.struct(col.cast("int").alias("c"), x.cast("double").alias("x"))

    def term_entry(columns: list[tuple[str, list]]) -> tuple[list[str], object]:
        """Labels of a fixed term's columns, and its one entry of a row: which column, and the product of its numbers."""
        labels, code, x = [""], F.lit(at), F.lit(1.0)
        for name, levels in columns:
            labels = [f"{label}:{name}{v}".lstrip(":") for label in labels for v in (levels or [""])]
            if levels:
                which = F.element_at(F.create_map(*[v for i, lv in enumerate(levels) for v in (F.lit(lv), F.lit(i))]), F.col(name))
                code = (code - at) * len(levels) + which + at
            else:
                x = x * F.col(name).cast("double")
        return labels, one(code, F.when(code.isNotNull(), x).otherwise(0.0))

    levels_of = {c: _distinct(rows, [c], 1_000, known)[c].tolist() for t in fixed_terms for c in t if kinds[c] in ("string", "boolean") or c == trait}
    fixed_effects = []
    if intercept:
        fixed_effects.append(Effects("(Intercept)", at, ["(Intercept)"]))
        entries.append(one(F.lit(at), F.lit(1.0)))
        at += 1
    names = {t for t in fixed_terms}
    for k, term in enumerate(fixed_terms):
        columns = []
        for c in term:
            # a factor loses its first level where the margin without it is in the model
            margin = tuple(x for x in term if x != c)
            dropped = (intercept or k > 0) if not margin else margin in names or all((x,) in names for x in margin)
            columns.append((c, levels_of[c][1:] if c in levels_of and dropped else levels_of.get(c, [])))
        labels, entry = term_entry(columns)
        fixed_effects.append(Effects(":".join(term), at, labels, columns=columns))
        entries.append(entry)
        at += len(labels)
    grids, empty = {}, None
    if res.axes:
        columns = [c for _, c in res.axes]
        by = [res.section] if res.section else []
        place = rows.select(*by, *columns).distinct()
        if rows.count() > place.count():
            raise ValueError("a cell of the lattice has two records")
        seen = _distinct(rows, [*by, *columns], 20 * max_levels)
        holes = []
        for key, part in seen.groupby(by[0]) if by else [(None, seen)]:
            g = [_lattice(part[c]) for c in columns]
            if any(isinstance(x, float) for line in g for x in line):
                raise ValueError("rows and columns of a residual are whole numbers")
            grids[key] = g
            have = set(zip(part[columns[0]], part[columns[1]]))
            holes += [(key, *cell) for cell in _product(g) if tuple(cell) not in have]
        if len(holes) > max_levels:
            raise ValueError(f"more than {max_levels} empty cells")
        if holes:
            empty = Effects("(empty cells)", at, holes)
            fixed_effects.append(empty)
            at += len(holes)
    p = at
    trait_code = F.lit(0)
    if trait:
        trait_code = F.element_at(F.create_map(*[v for i, x in enumerate(traits) for v in (F.lit(x), F.lit(i))]), F.col(trait))
    random_effects: list[Effects] = []
    absorbed: Effects | None = None
    for k, term in enumerate(terms):
        t = len(traits) if trait and term.struct != "iid" else 1
        axes = pos = kin = None
        if "parts" in term.options:
            t = int(term.options["parts"])
            if "size" in term.options:
                labels = [str(i) for i in range(int(term.options["size"]))]
            else:
                found = [rows.select((F.explode(F.transform(F.map_keys(c[3:]), lambda x: x.cast("string"))) if c.startswith("mm:") else F.col(c).cast("string")).alias("l")) for c in term.factors]
                union = found[0]
                for f in found[1:]:
                    union = union.unionByName(f)
                labels = _distinct(union, ["l"], max_levels)["l"].tolist()
            if term.level == "fixed":
                labels, kin = _relationship(term, labels, matrices)
            q = len(labels)
            if "size" not in term.options:
                codes = df.sparkSession.createDataFrame([({v: i for i, v in enumerate(labels)},)], f"__m{k} map<string,int>")
                steps.append(lambda r, codes=codes: r.join(F.broadcast(codes), how="cross"))  # one row, at most max_levels entries
                rows = steps[-1](rows)
            for j, c in enumerate(term.factors):
                base = F.lit(at + j * q)
                if c.startswith("arr:"):
                    many.append(_entries(F.transform(c[4:], lambda x, i: F.struct(i.alias("key"), x.alias("value"))), base))
                elif c.startswith("mm:"):
                    many.append(_entries(F.map_entries(c[3:]), base, F.col(f"__m{k}")))
                else:
                    entries.append(one(base + F.element_at(F.col(f"__m{k}"), F.col(c).cast("string")), F.lit(1.0)))
            random_effects.append(Effects(term.name, at, labels, term, t, k=kin))
            at += t * q
            continue
        if term.level == "id" and term.struct == "iid" and len(term.factors) == 1 and absorbed is None and not (trait or unit or weights or res.section or res.axes or any("parts" in x.options for x in terms)):
            count = len(known[term.factors[0]]) if term.factors[0] in known else counts[term.factors[0]]
            if absorb == term.factors[0] or absorb == "auto" and count > max_levels and rows.select(*term.factors).na.drop().distinct().limit(max_levels + 1).count() > max_levels:
                absorbed = Effects(term.name, -1, [], term, 1, absorbed=0)
                random_effects.append(absorbed)
                continue
        if term.level in ("id", "fixed"):
            table = _distinct(rows, term.factors, max_levels, known)
            labels = [v[0] if len(v) == 1 else tuple(v) for v in table.values.tolist()]
            if term.level == "fixed":
                labels, kin = _relationship(term, labels, matrices)
        elif term.level in ("exp", "gau", "iexp", "igau", "ieuc", "aexp", "agau", "lvr", "sph", "cir", "mtrn", "own"):
            table = _distinct(rows, term.factors, max_levels, known)
            labels, pos = [tuple(v) if len(v) > 1 else v[0] for v in table.values.tolist()], table.to_numpy(dtype=float)
            kin = term.options.get("expr") or term.options.get("matern")
        else:
            lines = [_lattice(_distinct(rows, [c], max_levels, known)[c]) for c in term.factors]
            labels = [x if len(lines) > 1 else x[0] for x in _product(lines)]
            axes, pos = [len(g) for g in lines], lines
        q = len(labels)
        lookup = pd.DataFrame([list(x) if isinstance(x, tuple) else [x] for x in labels], columns=[f"__f{k}_{i}" for i in range(len(term.factors))])
        lookup[f"__i{k}"] = range(q)
        table = df.sparkSession.createDataFrame(lookup)
        match = [F.col(c).cast(table.schema[f"__f{k}_{i}"].dataType) == F.col(f"__f{k}_{i}") for i, c in enumerate(term.factors)]
        steps.append(lambda r, table=table, match=match: r.join(F.broadcast(table), match, "left"))  # at most max_levels rows
        rows = steps[-1](rows)
        comp = trait_code if t > 1 else F.lit(0)
        entries.append(one(F.lit(at) + comp * q + F.col(f"__i{k}"), F.lit(1.0)))
        random_effects.append(Effects(term.name, at, labels, term, t, pos=pos, axes=axes, k=kin))
        at += t * q
    m = at
    plain_entries = F.filter(F.concat(F.array(*entries), *many), lambda e: e["x"] != 0)

    def coder(data: DataFrame, name: str) -> DataFrame:
        for step in steps:
            data = step(data)
        whole = F.lit(True)
        for c in used:
            whole = whole & F.col(c).isNotNull()
        return data.withColumn(name, F.when(whole, plain_entries))

    entries.append(one(F.lit(m), F.col("__y")))
    scale = F.sqrt(F.col(weights)) if weights else F.lit(1.0)
    coo = F.transform(F.filter(F.concat(F.array(*entries), *many), lambda e: e["x"] != 0), lambda e: F.struct(e["c"].alias("c"), (e["x"] * scale).alias("x")))
    section = F.col(res.section) if res.section else F.lit(None).cast("string")
    trait_text = F.col("t").cast("string")
    coded = rows.select(section.alias("section"), trait_code.alias("t"), *([F.col(unit).alias("unit")] if unit else []), coo.alias("coo"), (F.log(F.col(weights)) if weights else F.lit(0.0)).alias("lw"), *([scale.alias("scale")] if keep else []), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    info = {"centre": centre, "fixed": fixed_terms, "intercept": intercept, "levels": levels_of, "surfaces": surfaces, "made": made_for}
    if res.axes:
        cells, n = _lattice_sums(rows, res, grids, empty, coo, m)
        return _checked(Model(fixed_effects, random_effects, res, traits, sections, cells, p, m, n, 0.0, df, response, info, None, grids={k: (len(g[0]), len(g[1])) for k, g in grids.items()}, coder=coder))
    if unit and not many and len(traits) * len(entries) <= 60:
        cells, n, lw = _unit_sums(rows, section, trait_code, unit, scale, F.log(F.col(weights)) if weights else F.lit(0.0), entries, len(traits), m)
        model = Model(fixed_effects, random_effects, res, traits, sections, cells, p, m, n, lw, df, response, info)
        model.rows, model.coder = coded.drop("lw"), coder
        return _checked(model)
    if unit:
        twice = coded.groupBy("section", "unit", "t").count().where("count > 1").limit(1).count()
        if twice:
            raise ValueError("a unit has two records of one trait")
        units = coded.groupBy("section", "unit").agg(F.array_sort(F.collect_list(F.struct("t", "coo"))).alias("recs"), F.sum("lw").alias("lw"))  # as many as there are traits
        pattern = F.array_join(F.transform("recs", lambda r: r["t"].cast("string")), ",")
        flat = F.flatten(F.transform("recs", lambda r: F.transform(r["coo"], lambda e: F.struct(r["t"].alias("t"), e["c"].alias("c"), e["x"].alias("x")))))
        units = units.select("section", pattern.alias("pattern"), flat.alias("e"), F.size("recs").alias("k"), "lw")
    elif many:
        tagged = F.transform("coo", lambda e: F.struct(F.col("t").alias("t"), e["c"].alias("c"), e["x"].alias("x")))
        units = coded.select("section", trait_text.alias("pattern"), tagged.alias("e"), F.lit(1).alias("k"), "lw")
    if unit or many:
        pairs = F.explode(F.flatten(F.transform("e", lambda a: F.transform(F.filter("e", lambda b: (b["t"] > a["t"]) | ((b["t"] == a["t"]) & (b["c"] >= a["c"]))), lambda b: F.struct(a["t"].alias("t1"), b["t"].alias("t2"), a["c"].alias("i"), b["c"].alias("j"), (a["x"] * b["x"]).alias("x"))))))
        sums = units.select("section", "pattern", pairs.alias("s")).where("s.x <> 0")
    else:
        # every row is a unit of its own: its pairs are written out, one for each two terms, and stay in generated code
        units = coded.select("section", trait_text.alias("pattern"), F.lit(1).alias("k"), "lw")
        flat = rows.select(section.alias("section"), trait_code.alias("t"), *[v for k, e in enumerate(entries) for v in (e["c"].alias(f"__c{k}"), (e["x"] * scale).alias(f"__x{k}"))])
        products = F.array(*[F.struct(F.col(f"__c{a}").alias("i"), F.col(f"__c{b}").alias("j"), (F.col(f"__x{a}") * F.col(f"__x{b}")).alias("x")) for a in range(len(entries)) for b in range(a, len(entries))])
        sums = flat.select("section", F.col("t").cast("string").alias("pattern"), "t", F.inline(products)).where("x <> 0").select("section", "pattern", F.struct(F.col("t").alias("t1"), F.col("t").alias("t2"), "i", "j", "x").alias("s"))
    sums = sums.groupBy("section", "pattern", "s.t1", "s.t2", "s.i", "s.j").agg(F.sum("s.x").alias("x"))
    counts = units.groupBy("section", "pattern").agg(F.count("*").alias("units"), F.sum("k").alias("n"), F.sum("lw").alias("lw")).collect()
    cells = {(r["section"], r["pattern"]): (r["units"], {}) for r in counts}
    for (s, pattern, t1, t2), (i, j, x) in _blocks(sums, ["section", "pattern", "t1", "t2"]):  # at most the square of the number of effects, for each pair of traits
        cells[(s, pattern)][1][(t1, t2)] = Sums(i, j, x, m + 1, mirror=t1 == t2)
    n = sum(r["n"] for r in counts)
    if not n:
        raise ValueError("no complete rows")
    model = Model(fixed_effects, random_effects, res, traits, sections, cells, p, m, n, sum(r["lw"] for r in counts), df, response, info)
    model.rows, model.coder = coded.drop("lw"), coder
    if not (trait or unit or weights):
        model.design = coded.select("coo")
    if absorbed:
        model.absorbed = _absorb(rows, absorbed, entries, m)
        absorbed.absorbed = sum(q for q, _ in model.absorbed.by_n.values())
    return _checked(model)


def _blocks(sums: DataFrame, by: list[str]):
    """Keys and triplets of each group of a table with columns i, j and x."""
    table = sums.select(*by, F.col("i").cast("long"), F.col("j").cast("long"), "x").toPandas()
    for key, part in table.groupby(by, dropna=False, sort=True):
        key = tuple(None if v is None or isinstance(v, float) and math.isnan(v) else v.item() if hasattr(v, "item") else v for v in key)
        yield key, (part["i"].to_numpy(), part["j"].to_numpy(), part["x"].to_numpy())


def _unit_sums(rows: DataFrame, section: Column, trait: Column, unit: str, scale: Column, lw: Column, entries: list[Column], traits: int, m: int) -> tuple[dict, int, float]:
    """Cross-products by section and pattern, the number of records and the sum of the logarithms of weights, in one job: a unit's
    records become one row, whose pairs of entries, with those of its counts, are written out and stay in generated code."""
    flat = rows.select(section.alias("section"), F.col(unit).alias("unit"), trait.alias("t"), lw.alias("lw"), *[v for k, e in enumerate(entries) for v in (e["c"].alias(f"c{k}"), (e["x"] * scale).alias(f"x{k}"))])
    own = lambda v, c: F.max(F.when(F.col("t") == v, F.col(c)))
    units = flat.groupBy("section", "unit").agg(F.sum("lw").alias("lw"), *[F.count(F.when(F.col("t") == v, 1)).alias(f"n{v}") for v in range(traits)], *[own(v, f"{c}{k}").alias(f"{c}{v}_{k}") for v in range(traits) for k in range(len(entries)) for c in "cx"])
    pattern = sum((F.when(F.col(f"n{v}") > 0, F.lit(2**v)).otherwise(F.lit(0)).cast("long") for v in range(1, traits)), F.when(F.col("n0") > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    column = [(v, k) for v in range(traits) for k in range(len(entries))]
    cell = lambda t1, t2, i, j, x: F.struct(F.lit(t1).alias("t1"), F.lit(t2).alias("t2"), i.cast("int").alias("i"), j.cast("int").alias("j"), x.cast("double").alias("x"))
    col = lambda c, at: F.col(f"{c}{at[0]}_{at[1]}")
    pairs = [cell(a[0], b[0], col("c", a), col("c", b), col("x", a) * col("x", b)) for n, a in enumerate(column) for b in column[n:]]
    none, twice = F.lit(-1), F.greatest(F.lit(0), *[F.col(f"n{v}") - 1 for v in range(traits)])
    pairs += [cell(-1, k, none, none, x) for k, x in enumerate((F.lit(1.0), twice, F.col("lw")))]
    sums = units.select("section", pattern.alias("pattern"), F.inline(F.array(*pairs))).where("x <> 0 and i is not null and j is not null")
    sums = sums.groupBy("section", "pattern", "t1", "t2", "i", "j").agg(F.sum("x").alias("x"))
    name = lambda bits: ",".join(str(v) for v in range(traits) if bits >> v & 1)
    cells, n, weight, found = {}, 0, 0.0, []
    for (s, bits, t1, t2), (i, j, x) in _blocks(sums, ["section", "pattern", "t1", "t2"]):  # at most the square of the number of effects, for each pair of traits
        if t1 >= 0:
            found.append(((s, name(bits)), (t1, t2), Sums(i, j, x, m + 1, mirror=t1 == t2)))
        elif t2 == 0:
            cells[s, name(bits)] = (int(round(x[0])), {})
            n += int(round(x[0])) * int(bits).bit_count()
        elif t2 == 1:
            raise ValueError("a unit has two records of one trait")
        else:
            weight += float(x[0])
    if not n:
        raise ValueError("no complete rows")
    for key, pair, g in found:
        cells[key][1][pair] = g
    return dict(sorted(cells.items(), key=repr)), n, weight


def _absorb(rows: DataFrame, effects: Effects, entries: list[Column], m: int) -> Absorbed:
    """Sums of each level's columns, and of their outer products over the levels with equal numbers of rows."""
    ship(rows.sparkSession)
    codes, sums = [f"c{k}" for k in range(len(entries))], [f"x{k}" for k in range(len(entries))]
    flat = rows.select(F.col(effects.term.factors[0]).alias("level"), *[v for k, e in enumerate(entries) for v in (e["c"].alias(f"c{k}"), e["x"].alias(f"x{k}"))])
    wide = flat.groupBy("level", *codes).agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in sums])
    listed = wide.groupBy("level").agg(F.sum("n").alias("n"), *[F.collect_list(F.coalesce(F.col(c), F.lit(d))).alias(c) for cs, d in ((codes, -1), (sums, 0.0)) for c in cs])  # a level's different codes

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not len(t):
                continue
            row = np.concatenate([np.repeat(np.arange(len(t)), pa.compute.list_value_length(t.column(c)).to_numpy()) for c in codes])
            c = np.concatenate([t.column(c).flatten().to_numpy().astype(np.int64) for c in codes])
            x = np.concatenate([t.column(c).flatten().to_numpy() for c in sums])
            row, c, x = row[c >= 0], c[c >= 0], x[c >= 0]
            key, where = np.unique(row * (m + 1) + c, return_inverse=True)
            x = np.bincount(where, weights=x, minlength=len(key))
            row, c, x = key[x != 0] // (m + 1), key[x != 0] % (m + 1), x[x != 0]
            cell = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)), pa.array(x)], names=["c", "x"])
            bounds = np.searchsorted(row, np.arange(len(t) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([t.column("level"), t.column("n"), pa.ListArray.from_arrays(pa.array(bounds), cell)], names=["level", "n", "e"])

    def products_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            lists, n = t.column("e"), t.column("n").to_numpy()
            size, flat_ = pa.compute.list_value_length(lists).to_numpy(), lists.flatten()
            c, x, first = flat_.field("c").to_numpy().astype(np.int64), flat_.field("x").to_numpy(), np.concatenate([[0], np.cumsum(size)])[:-1]
            for length in np.unique(size[size > 0]).tolist():  # levels with equally many entries at once
                every, step = np.nonzero(size == length)[0], max(1, 2_000_000 // length**2)
                for lo in range(0, len(every), step):
                    mine = every[lo : lo + step]
                    at = first[mine][:, None] + np.arange(length)
                    key = ((n[mine][:, None, None] * (m + 1) + c[at][:, :, None]) * (m + 1) + c[at][:, None, :]).ravel()
                    key, where = np.unique(key, return_inverse=True)
                    total = np.bincount(where.ravel(), weights=(x[at][:, :, None] * x[at][:, None, :]).ravel(), minlength=len(key))
                    yield pa.RecordBatch.from_arrays([pa.array(key // (m + 1) ** 2), pa.array((key // (m + 1) % (m + 1)).astype(np.int32)), pa.array((key % (m + 1)).astype(np.int32)), pa.array(total)], names=["n", "i", "j", "x"])

    kind = listed.schema["level"].dataType.simpleString()
    levels = checkpointed(listed.mapInArrow(folded, f"level {kind}, n long, e array<struct<c:int,x:double>>"))  # read for the numbers of rows, the products and the predictions
    products = levels.select("n", "e").mapInArrow(products_of, "n long, i int, j int, x double").groupBy("n", "i", "j").agg(F.sum("x").alias("x"))
    counts = {r["n"]: r["q"] for r in levels.groupBy("n").agg(F.count("*").alias("q")).collect()}  # numbers of rows add up to their total, so they are at most the root of twice that
    if len(counts) * (m + 1) ** 2 > 500_000_000:
        raise ValueError(f"{len(counts)} different numbers of rows by {m} other effects are too many sums: absorb another factor")
    return Absorbed({n: (counts[n], Sums(i, j, x, m + 1)) for (n,), (i, j, x) in _blocks(products, ["n"])}, levels)


def _checked(model: Model) -> Model:
    """Refuses random terms without an entry and fixed effects that depend on each other."""
    own = [g for _, sums in model.cells.values() for k, g in sums.items() if k == "II" or k[0] == k[1] and not isinstance(k, str)]
    size = sum((g.diagonal() for g in own), np.zeros(model.m + 1))
    if not np.isfinite(size).all():
        raise ValueError("the response or a fixed effect has values that aren't finite")
    for e in model.random:
        if e.absorbed is None and not size[e.offset : e.offset + e.t * e.q].any():
            raise ValueError(f"{e.name}: its incidence is zero everywhere")
    cut = sum(e.q for e in model.fixed if e.name != "(empty cells)")
    if cut:
        x = np.zeros((model.m + 1, model.m + 1))
        for g in own:
            g.add_to(x, 1.0)
        x, scale = x[:cut, :cut], np.sqrt(np.maximum(size[:cut], 1e-300))
        rank = int((np.linalg.eigvalsh(x / np.outer(scale, scale)) > 1e-10).sum())
        if rank < cut:
            raise ValueError(f"the fixed effects have rank {rank} for {cut} columns")
    return model


def _entries(pairs: Column, base: Column, codes: Column | None = None) -> Column:
    """Entries of the design from an array of keys and values, the keys coded by a map if one is given."""
    place = lambda e: e["key"] if codes is None else F.element_at(codes, e["key"].cast("string"))
    return F.transform(pairs, lambda e: F.struct((base + place(e)).cast("int").alias("c"), e["value"].cast("double").alias("x")))


def _relationship(term: Term, labels: list, matrices: dict) -> tuple[list, np.ndarray]:
    """Levels and their relationship: those of the data for K, all of the matrix for an inverse."""
    given = matrices[term.options.get("K") or term.options["Kinv"]]
    missing = set(labels) - set(given.index)
    if missing:
        raise ValueError(f"{term.name}: no relationship for {sorted(missing)[:5]}")
    if "Kinv" in term.options:
        return list(given.index), _positive(np.linalg.inv(given.to_numpy(dtype=float)))
    return labels, _positive(given.loc[labels, labels].to_numpy(dtype=float))


def _lattice_sums(rows: DataFrame, res: Residual, grids: dict, empty: Effects | None, coo, m: int) -> tuple[dict, int]:
    """Cross-products of the cells of complete lattices: with themselves, within the inner rows and columns, and with the
    neighbours in each direction. The inverse of a separable autoregression is a sum of these with coefficients that
    depend on its parameters only. An empty cell is a cell with a fixed effect of its own."""
    spark = rows.sparkSession
    section = F.col(res.section).cast("string") if res.section else F.lit("")
    steps = {k: [(g[0], g[1] - g[0] if len(g) > 1 else 1, len(g)) for g in v] for k, v in grids.items()}
    lay = spark.createDataFrame([(str(k) if res.section else "", *[x for s in v for x in s]) for k, v in steps.items()], "s string, r0 long, dr long, nr long, c0 long, dc long, nc long")
    cells = rows.select(section.alias("s"), F.col(res.axes[0][1]).cast("long").alias("r"), F.col(res.axes[1][1]).cast("long").alias("c"), coo.alias("coo"))
    n = cells.count()
    if not n:
        raise ValueError("no complete rows")
    if empty:
        holes = [(str(key) if res.section else "", int(r), int(c), [(empty.offset + k, 1.0)]) for k, (key, r, c) in enumerate(empty.labels)]
        cells = cells.unionByName(spark.createDataFrame(holes, "s string, r long, c long, coo array<struct<c:int,x:double>>"))
    cells = cells.join(F.broadcast(lay), "s").select("s", ((F.col("r") - F.col("r0")) / F.col("dr")).cast("long").alias("r"), ((F.col("c") - F.col("c0")) / F.col("dc")).cast("long").alias("c"), "nr", "nc", "coo")
    inner = [(F.col("r") > 0) & (F.col("r") < F.col("nr") - 1), (F.col("c") > 0) & (F.col("c") < F.col("nc") - 1)]
    cells = cells.select("s", "r", "c", inner[0].alias("ir"), inner[1].alias("ic"), "coo")
    kinds = lambda *pairs: F.filter(F.array(*[F.when(cond, F.lit(k)) for k, cond in pairs]), lambda x: x.isNotNull())
    yes = F.lit(True)
    own = cells.select("s", kinds(("II", yes), ("DI", F.col("ir")), ("ID", F.col("ic")), ("DD", F.col("ir") & F.col("ic"))).alias("h"), F.col("coo").alias("a"), F.col("coo").alias("b"))
    offsets = F.array(*[F.struct(F.lit(x).alias("dr"), F.lit(y).alias("dc")) for x, y in ((1, 0), (0, 1), (1, 1), (1, -1))])
    left = cells.select("s", F.inline(offsets), "r", "c", F.col("coo").alias("a"), "ir", "ic").select("s", "dr", "dc", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "a", "ir", "ic")
    near = left.join(cells.select("s", "r", "c", F.col("coo").alias("b")), ["s", "r", "c"])
    one_way = lambda x, y: (F.col("dr") == x) & (F.col("dc") == y)
    near = near.select("s", kinds(("TI", one_way(1, 0)), ("TD", one_way(1, 0) & F.col("ic")), ("IT", one_way(0, 1)), ("DT", one_way(0, 1) & F.col("ir")), ("TT", (F.col("dr") == 1) & (F.col("dc") != 0))).alias("h"), "a", "b")
    pairs = F.flatten(F.transform("a", lambda a: F.transform("b", lambda b: F.struct(a["c"].alias("i"), b["c"].alias("j"), (a["x"] * b["x"]).alias("x")))))
    sums = own.unionByName(near).select("s", "h", F.inline(pairs)).select("s", F.explode("h").alias("h"), "i", "j", "x").groupBy("s", "h", "i", "j").agg(F.sum("x").alias("x"))
    names = {str(k) if res.section else "": k for k in grids}
    out = {(k, "0"): (len(g[0]) * len(g[1]), {}) for k, g in grids.items()}
    for (s, h), (i, j, x) in _blocks(sums, ["s", "h"]):  # at most nine squares of the number of effects
        both = "T" in h
        out[(names[s], "0")][1][h] = Sums(np.concatenate([i, j]) if both else i, np.concatenate([j, i]) if both else j, np.concatenate([x, x]) if both else x, m + 1)
    return out, n


def _lattice_weights(theta: np.ndarray, axes: list[tuple[str, str]], size: tuple[int, int]) -> tuple[dict[str, float], float]:
    """Coefficients of a separable residual's inverse over its cross-products, and its log determinant."""
    var, at, parts, logdet = math.exp(2 * theta[0]), 1, [], 0.0
    for k, (kind, _) in enumerate(axes):
        rho = 0.0
        if kind == "ar1":
            rho, at = math.tanh(theta[at]), at + 1
        keep = 1 - rho * rho if size[k] > 1 else 1.0
        parts.append({"I": 1 / keep, "D": rho * rho / keep, "T": -rho / keep})
        logdet += size[1 - k] * (size[k] - 1) * math.log(keep)
    return {a + b: x * y / var for a, x in parts[0].items() for b, y in parts[1].items()}, logdet + size[0] * size[1] * 2 * theta[0]


def _product(grids: list[list]) -> list[tuple]:
    out = [()]
    for g in grids:
        out = [(*x, v) for x in out for v in g]
    return out


def _positive(k: np.ndarray) -> np.ndarray:
    """A relationship matrix, its diagonal raised bit by bit until it is positive definite."""
    bend = 0.0
    for step in range(9):
        try:
            np.linalg.cholesky(k + bend * np.eye(len(k)))
            return k + bend * np.eye(len(k))
        except np.linalg.LinAlgError:
            bend = 1e-8 * 10**step * float(np.diag(k).mean())
    raise ValueError("the relationship matrix is not positive definite")


class Likelihood:
    """The restricted likelihood of a model as a function of its parameters."""

    @property
    def result(self) -> type:
        """What a fit with it returns."""
        return Fit

    def __init__(self, model: Model, ml: bool = False):
        self.model, self.ml, self.slices, at = model, ml, [], 0
        for e in model.random:
            ns = structures.n_sigma(e.term.struct, e.t, e.term.rank)
            nl = self._n_level(e)
            self.slices.append((slice(at, at + ns), slice(at + ns, at + ns + nl)))
            at += ns + nl
        t = len(model.traits)
        self.residual = []
        for s in model.sections:
            ns = 1 + sum(k == "ar1" for k, _ in model.residual.axes) if model.residual.axes else structures.n_sigma(model.structure(s).struct, t, model.structure(s).rank)
            self.residual.append(slice(at, at + ns))
            at += ns
        self.size = at
        self._split: bordered.Split | None | bool = False
        self._last: tuple | None = None

    def split(self) -> "bordered.Split | None":
        """How the equations fall into blocks, from the pattern of their sums; found once."""
        if self._split is False:
            m = self.model
            i, j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            every = [g for _, sums in m.cells.values() for g in sums.values()] + ([g for _, g in m.absorbed.by_n.values()] if m.absorbed else [])
            for g in every:
                inner = (g.i < m.m) & (g.j < m.m) & (g.i != g.j)
                i.append(g.i[inner])
                j.append(g.j[inner])
            groups = [np.arange(m.p)] if m.p else []
            for e in m.random:
                if e.absorbed is not None:
                    continue
                own = np.arange(e.offset, e.offset + e.t * e.q)
                groups.append(own)
                if e.term.level == "id":  # columns of one level are linked, else all are
                    if e.t > 1:
                        for k in range(1, e.t):
                            i.append(own[: e.q])
                            j.append(own[k * e.q : (k + 1) * e.q])
                else:
                    i.append(own[:-1])
                    j.append(own[1:])
            links = np.unique(np.concatenate(i) * (m.m + 1) + np.concatenate(j))
            self._split = bordered.search(m.m, groups, links // (m.m + 1), links % (m.m + 1)) if m.m > 60 else None
        return self._split

    def inverted(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, np.ndarray, float]:
        """equations(), their inverse and its log determinant; the last ones asked for are kept."""
        key = np.asarray(theta, dtype=float).tobytes()
        if self._last is None or self._last[0] != key:
            c, b, yy, logdet = self.equations(theta)
            self._last = (key, (c, b, yy, logdet, *bordered.inverse(c, self.split())))
        return self._last[1]

    def refined(self, theta: np.ndarray) -> tuple[np.ndarray, float]:
        """The solution of the equations and the quadratic form y'P y, refined: where the residual is far below the other
        variances the product with the inverse alone loses the digits that descents need."""
        c, b, yy, _, inv, _ = self.inverted(theta)
        x = inv @ b
        for _ in range(2):
            left = b - c @ x
            x = x + inv @ left
        return x, yy - float(b @ x) - float(x @ (b - c @ x))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_last": None}

    @staticmethod
    def _n_level(e: Effects) -> int:
        if e.absorbed is not None:
            return 0
        if e.axes:
            return sum(structures.n_level(e.term.level, q, int(e.term.options.get("order", 1))) for q in e.axes)
        return structures.n_level(e.term.level, e.q, int(e.term.options.get("order", 1)))

    def start(self) -> np.ndarray:
        m = self.model
        y, n = m.m, m.n
        own = [g for _, sums in m.cells.values() for k, g in sums.items() if k == "II" or k[0] == k[1] and not isinstance(k, str)]
        yy = sum(g.at(y, y) for g in own)
        first = sum(g.at(0, y) for g in own) if m.fixed else 0.0
        var = max(1e-8, (yy - first**2 / n) / n)
        parts = len(m.random) + 1
        out = []
        for e in m.random:
            out.append(structures.sigma_start(e.term.struct, e.t, e.term.rank, var / parts))
            out += [structures.level_start(e.term.level, q, np.arange(q), int(e.term.options.get("order", 1))) for q in e.axes] if e.axes else [structures.level_start(e.term.level, e.q, e.pos if e.pos is not None else np.zeros(1), int(e.term.options.get("order", 1)), e.term.options.get("matern"))]
        out += [np.array([0.5 * math.log(var / parts)] + [0.3] * (s.stop - s.start - 1)) if m.residual.axes else structures.sigma_start(m.structure(k).struct, len(m.traits), m.structure(k).rank, var / parts) for k, s in zip(m.sections, self.residual)]
        return np.concatenate(out)

    def level(self, e: Effects, theta: np.ndarray) -> np.ndarray:
        order = int(e.term.options.get("order", 1))
        if e.axes:
            parts, at = [], 0
            for q, grid in zip(e.axes, e.pos):
                n = structures.n_level(e.term.level, q, order)
                parts.append(structures.correlation(theta[at : at + n], e.term.level, np.arange(q), order))
                at += n
            return structures.separable(parts)
        return structures.correlation(theta, e.term.level, e.pos if e.pos is not None else np.zeros((e.q, 1)), order, e.k)

    def weighted(self, theta: np.ndarray) -> tuple[np.ndarray, float]:
        """[W y]'R^-1 [W y] and log |R|, where W = [X Z]."""
        m = self.model
        c, logdet = np.zeros((m.m + 1, m.m + 1)), -m.log_weights
        for s, sl in zip(m.sections, self.residual):
            if m.residual.axes:
                weights, ld = _lattice_weights(theta[sl], m.residual.axes, m.grids[s])
                for h, g in m.cells[(s, "0")][1].items():
                    g.add_to(c, weights[h])
                logdet += ld
                continue
            full = structures.sigma(theta[sl], m.structure(s).struct, len(m.traits), m.structure(s).rank)
            for (section, pattern), (units, sums) in m.cells.items():
                if section != s:
                    continue
                ts = [int(x) for x in pattern.split(",")]
                r = full[np.ix_(ts, ts)]
                inv = np.linalg.inv(r)
                logdet += units * np.linalg.slogdet(r)[1]
                for (a, b), g in sums.items():
                    g.add_to(c, inv[ts.index(a), ts.index(b)], both=a != b)
        return c, logdet

    def absorbed_at(self, theta: np.ndarray) -> tuple[float, float]:
        """Variances of the absorbed factor and of the residual."""
        at = next(ss for e, (ss, _) in zip(self.model.random, self.slices) if e.absorbed is not None)
        return math.exp(2 * theta[at][0]), math.exp(2 * theta[self.residual[0]][0])

    @staticmethod
    def _level_weights(n: np.ndarray, su: float, se: float) -> tuple[np.ndarray, np.ndarray]:
        """By number of rows: what outer products of a level's sums are subtracted with, and what it adds to log |C| and log |G|."""
        d = n / se + 1 / su
        return 1 / (se * se * d), np.log(d * su)

    def equations(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Coefficients and right side of the mixed-model equations, y'R^-1 y, and log determinants of R and G (and of the
        absorbed part of the coefficients)."""
        m = self.model
        c, logdet = self.reduced(theta)
        for e, (ss, sl) in zip(m.random, self.slices):
            if e.absorbed is not None:
                continue
            sig, kin = structures.sigma(theta[ss], e.term.struct, e.t, e.term.rank), self.level(e, theta[sl])
            jitter = 0.0 if e.term.level in ("id", "fixed") else 1e-10
            ls, lk = np.linalg.cholesky(sig), np.linalg.cholesky(kin + jitter * np.eye(e.q)) if e.term.level != "id" else np.eye(e.q)
            logdet += 2 * (e.q * np.log(np.diag(ls)).sum() + e.t * np.log(np.diag(lk)).sum())
            sl = slice(e.offset, e.offset + e.t * e.q)
            c[sl, sl] += np.kron(np.linalg.inv(sig), np.eye(e.q) if e.term.level == "id" else np.linalg.inv(kin + jitter * np.eye(e.q)))
        return c[: m.m, : m.m], c[: m.m, m.m], float(c[m.m, m.m]), logdet

    def reduced(self, theta: np.ndarray) -> tuple[np.ndarray, float]:
        """weighted() without what the absorbed factor explains, so with its covariance as a part of R."""
        m = self.model
        c, logdet = self.weighted(theta)
        if m.absorbed:
            n = np.array(list(m.absorbed.by_n), dtype=float)
            weights, logs = self._level_weights(n, *self.absorbed_at(theta))
            m.absorbed.subtract(c, weights)
            logdet += float(sum(q * log for (q, _), log in zip(m.absorbed.by_n.values(), logs.tolist())))
        return c, logdet

    def average_information(self, theta: np.ndarray) -> np.ndarray:
        """The mean of observed and expected second derivatives, from working columns q_j = dV_j P y: q_i'P q_j.

        A random term's working column is its design times (dG G^-1) u, and the residual's R^-1 dR of the residuals, so that
        all products are those of the sums with changed weights. Takes models without a lattice or an absorbed factor.
        """
        m, h = self.model, 1e-5
        if m.residual.axes or m.absorbed or self.ml:
            raise ValueError("takes restricted likelihoods without a lattice or an absorbed factor")
        full, _ = self.weighted(theta)
        cinv, (x, _) = self.inverted(theta)[4], self.refined(theta)
        z = np.append(-x, 1.0)
        step = lambda j: np.eye(self.size)[j] * h
        effects = np.zeros((m.m, self.size))  # working columns of random terms, as combinations of the design's
        for e, (ss, sl) in zip(m.random, self.slices):
            u = x[e.offset : e.offset + e.t * e.q].reshape(e.t, e.q)
            sig = lambda th, e=e, ss=ss: structures.sigma(th[ss], e.term.struct, e.t, e.term.rank)
            back = np.linalg.solve(sig(theta), u)
            for j in range(ss.start, ss.stop):
                effects[e.offset : e.offset + e.t * e.q, j] = ((sig(theta + step(j)) - sig(theta - step(j))) / (2 * h) @ back).ravel()
            if sl.stop > sl.start:
                kin = self.level(e, theta[sl]) + 1e-10 * np.eye(e.q)
                back = np.linalg.solve(kin, u.T)
                for j in range(sl.start, sl.stop):
                    d = (self.level(e, (theta + step(j))[sl]) - self.level(e, (theta - step(j))[sl])) / (2 * h)
                    effects[e.offset : e.offset + e.t * e.q, j] = (d @ back).T.ravel()
        design = full[: m.m, : m.m] @ effects  # W'R^-1 q
        products = effects.T @ design
        for s, sl in zip(m.sections, self.residual):
            matrix = lambda th, sl=sl, s=s: structures.sigma(th[sl], m.structure(s).struct, len(m.traits), m.structure(s).rank)
            change = [(matrix(theta + step(j)) - matrix(theta - step(j))) / (2 * h) for j in range(sl.start, sl.stop)]
            whole = matrix(theta)
            first = [np.zeros(m.m + 1) for _ in change]
            second = np.zeros((len(change), len(change)))
            for (section, pattern), (_, sums) in m.cells.items():
                if section != s:
                    continue
                ts = [int(v) for v in pattern.split(",")]
                inv = np.linalg.inv(whole[np.ix_(ts, ts)])
                parts = [d[np.ix_(ts, ts)] for d in change]
                for (p1, p2), g in sums.items():
                    a, b_ = ts.index(p1), ts.index(p2)
                    left = np.bincount(g.j, weights=g.x * z[g.i], minlength=m.m + 1)  # z'G
                    right = np.bincount(g.i, weights=g.x * z[g.j], minlength=m.m + 1) if p1 != p2 else left
                    quad = float(left @ z)
                    for i, di in enumerate(parts):
                        w = inv @ di @ inv
                        first[i] += w[a, b_] * left + (w[b_, a] * right if p1 != p2 else 0.0)
                        for j, dj in enumerate(parts):
                            v = inv @ di @ inv @ dj @ inv
                            second[i, j] += quad * (v[a, b_] + (v[b_, a] if p1 != p2 else 0.0))
            for i, row in enumerate(first):
                j = sl.start + i
                design[:, j] = row[: m.m]
                products[j, : self.residual[0].start] = products[: self.residual[0].start, j] = row[: m.m] @ effects[:, : self.residual[0].start]
            products[sl, sl] = second
        out = products - design.T @ (cinv @ design)
        return (out + out.T) / 2

    def __call__(self, theta: np.ndarray) -> float:
        """-2 log restricted likelihood without its constant."""
        c, _, _, logdet, _, log_c = self.inverted(theta)
        return logdet + self._log_c(c, log_c) + self.refined(theta)[1]

    def _log_c(self, c: np.ndarray, whole: float) -> float:
        """Log determinant of the equations; that of the random effects' part for maximum likelihood."""
        p = self.model.p
        return 2 * float(np.log(np.diag(np.linalg.cholesky(c[p:, p:]))).sum()) if self.ml else whole


    def value_and_gradient(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """The value and its gradient from one inverse of the equations.

        Derivatives of the small matrices (between traits, between levels) are central differences of their
        closed forms; what they meet are traces with the inverse and the solution.
        """
        m, h, grad = self.model, 1e-6, np.zeros(self.size)
        c, _, _, logdet, inv, log_c = self.inverted(theta)
        x, quad = self.refined(theta)
        value = logdet + self._log_c(c, log_c) + quad
        z = np.append(-x, 1.0)
        meet = np.outer(z, z)
        if self.ml:
            meet[m.p : m.m, m.p : m.m] += np.linalg.inv(c[m.p :, m.p :])
        else:
            meet[: m.m, : m.m] += inv  # tr(C^-1 dC) + z'dMz is the sum of this times dM
        step = lambda j: np.eye(self.size)[j] * h
        for s, sl in zip(m.sections, self.residual):
            if m.residual.axes:
                dots = {h: g.dot(meet) for h, g in m.cells[(s, "0")][1].items()}

                def lattice(th: np.ndarray) -> float:
                    weights, ld = _lattice_weights(th[sl], m.residual.axes, m.grids[s])
                    return ld + sum(weights[k] * d for k, d in dots.items())

                for j in range(sl.start, sl.stop):
                    grad[j] = (lattice(theta + step(j)) - lattice(theta - step(j))) / (2 * h)
                continue
            parts = [(units, [int(v) for v in pattern.split(",")], {k: g.dot(meet) for k, g in sums.items()}) for (section, pattern), (units, sums) in m.cells.items() if section == s]

            def own(th: np.ndarray) -> float:
                full, out = structures.sigma(th[sl], m.structure(s).struct, len(m.traits), m.structure(s).rank), 0.0
                for units, ts, dots in parts:
                    r = full[np.ix_(ts, ts)]
                    ri = np.linalg.inv(r)
                    out += units * np.linalg.slogdet(r)[1] + sum(ri[ts.index(i), ts.index(j)] * d * (1 if i == j else 2) for (i, j), d in dots.items())
                return out

            for j in range(sl.start, sl.stop):
                grad[j] = (own(theta + step(j)) - own(theta - step(j))) / (2 * h)
        if m.absorbed:
            rows = np.array(list(m.absorbed.by_n), dtype=float)
            many, dots_n = np.array([q for q, _ in m.absorbed.by_n.values()], dtype=float), m.absorbed.dots(meet)

            def levels_of(th: np.ndarray) -> float:
                weights, logs = self._level_weights(rows, *self.absorbed_at(th))
                return float(many @ logs - weights @ dots_n)

            for j in range(self.size):
                if any(s.start <= j < s.stop for s in (self.residual[0], *(ss for e, (ss, _) in zip(m.random, self.slices) if e.absorbed is not None))):
                    grad[j] += (levels_of(theta + step(j)) - levels_of(theta - step(j))) / (2 * h)
        self._random_gradient(theta, meet, grad, h)
        return value, grad

    def _random_gradient(self, theta: np.ndarray, meet: np.ndarray, grad: np.ndarray, h: float) -> None:
        """The entries of the random terms that the equations hold; meet: the inverse and the outer product of the solution."""
        step = lambda j: np.eye(self.size)[j] * h
        for e, (ss, sl) in zip(self.model.random, self.slices):
            if e.absorbed is not None:
                continue
            k = slice(e.offset, e.offset + e.t * e.q)
            block = meet[k, k].reshape(e.t, e.q, e.t, e.q)
            kin = None if e.term.level == "id" else self.level(e, theta[sl])
            traces = np.einsum("aibi->ab", block) if kin is None else np.einsum("aibj,ij->ab", block, np.linalg.inv(kin))

            grad[ss] = between_gradient(theta[ss], e.term, e.t, e.q, traces)
            if sl.stop > sl.start:
                folded = np.einsum("aibj,ab->ij", block, np.linalg.inv(structures.sigma(theta[ss], e.term.struct, e.t, e.term.rank)))

                def levels(th: np.ndarray) -> float:
                    kk = self.level(e, th[sl]) + 1e-10 * np.eye(e.q)
                    return e.t * np.linalg.slogdet(kk)[1] + float((np.linalg.inv(kk) * folded).sum())

                for j in range(sl.start, sl.stop):
                    grad[j] = (levels(theta + step(j)) - levels(theta - step(j))) / (2 * h)


def between_gradient(own: np.ndarray, term: Term, t: int, q: int, traces: np.ndarray) -> np.ndarray:
    """Derivatives of q log |S| + tr(S^-1 T) over the parameters of S, a covariance between traits.

    The matrix's derivative is taken first, as q S^-1 - S^-1 T S^-1, so that nearly singular ones keep their digits.
    """
    s = lambda th: structures.sigma(th, term.struct, t, term.rank)
    inv = np.linalg.inv(s(own))
    meet = q * inv - inv @ ((traces + traces.T) / 2) @ inv
    out = np.zeros(len(own))
    for j in range(len(own)):
        e = np.eye(len(own))[j] * 1e-5
        out[j] = float((meet * (s(own + e) - s(own - e))).sum()) / 2e-5
    return out


@dataclass
class Fit:
    model: Model
    likelihood: Likelihood
    theta: np.ndarray
    neg2: float
    converged: bool
    cinv: np.ndarray
    solution: np.ndarray
    hessian: np.ndarray
    free: np.ndarray
    box: tuple = (-12.0, 12.0)
    diagnostics: dict = field(default_factory=dict)
    timings: dict = field(default_factory=dict)
    faces: dict = field(default_factory=dict)  # ranks of the terms' covariances that are singular

    @property
    def spark(self) -> SparkSession:
        return self.model.source.sparkSession

    @property
    def estimates(self) -> np.ndarray:
        """The solution, its intercept with what was taken off the response."""
        out = self.solution.copy()
        if self.model.fixed and self.model.fixed[0].name == "(Intercept)":
            out[0] += self.model.spec.get("centre", 0.0)
        return out

    @property
    def loglik(self) -> float:
        """With the constant (n - p) / 2 log 2 pi, or n / 2 log 2 pi for maximum likelihood; empty cells don't count."""
        return -0.5 * (self.neg2 + (self.model.n - (0 if self.likelihood.ml else self.rank)) * math.log(2 * math.pi))

    @property
    def rank(self) -> int:
        """Number of fixed effects without those of empty cells."""
        return sum(e.q for e in self.model.fixed if e.name != "(empty cells)")

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * int(self.free.sum())

    @property
    def bic(self) -> float:
        return -2 * self.loglik + int(self.free.sum()) * math.log(self.model.n - self.rank)

    @property
    def at_bound(self) -> np.ndarray:
        return (self.theta <= np.asarray(self.box[0]) + 1e-7) | (self.theta >= np.asarray(self.box[1]) - 1e-7)

    def curvature(self) -> tuple[np.ndarray, np.ndarray]:
        """Covariance of theta over the directions of positive curvature of the free parameters off the box's faces, and
        the flat directions, as columns."""
        out, k = np.zeros_like(self.hessian), np.nonzero(self.free & ~self.at_bound)[0]
        flat = np.zeros((len(self.theta), 0))
        if len(k):
            values, vectors = np.linalg.eigh(self.hessian[np.ix_(k, k)])
            keep = values > 1e-8 * max(1.0, float(np.abs(values).max()))
            out[np.ix_(k, k)] = 2 * (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
            flat = np.zeros((len(self.theta), int((~keep).sum())))
            flat[k] = vectors[:, ~keep]
        return out, flat

    @property
    def theta_cov(self) -> np.ndarray:
        return self.curvature()[0]

    def components(self, theta: np.ndarray | None = None) -> dict[str, float]:
        """Variances and covariances on their natural scale, by name, in the order V1, V2, ..."""
        theta, out, m = self.theta if theta is None else theta, {}, self.model

        def add(name: str, s: np.ndarray) -> None:
            names = [str(t) for t in m.traits] if len(s) == len(m.traits) > 1 else [str(i + 1) for i in range(len(s))]
            for i in range(len(s)):
                for j in range(i + 1):
                    if i == j or s[i, j] != 0:
                        out[name + (f"[{names[i]},{names[j]}]" if len(s) > 1 else "")] = float(s[i, j])

        for e, (ss, sl) in zip(m.random, self.likelihood.slices):
            add(e.name, structures.sigma(theta[ss], e.term.struct, e.t, e.term.rank))
            at = sl.start
            for axis, q in enumerate(e.axes or [e.q]):
                n = structures.n_level(e.term.level, q, int(e.term.options.get("order", 1))) if e.axes else sl.stop - sl.start
                for k, v in structures.reported(theta[at : at + n], e.term.level, q, int(e.term.options.get("order", 1)), e.term.options.get("matern")).items():
                    out[f"{e.name}.{k}" + (f"({e.term.factors[axis]})" if e.axes and len(e.axes) > 1 else "")] = v
                at += n
        for s, sl in zip(m.sections, self.likelihood.residual):
            if m.residual.axes:
                name = "residual" + (f"({s})" if s is not None else "")
                out[name] = math.exp(2 * theta[sl][0])
                out |= {f"{name}.{c}": math.tanh(v) for (_, c), v in zip([a for a in m.residual.axes if a[0] == "ar1"], theta[sl][1:])}
                continue
            if m.structure(s).struct == "none":
                continue
            add("residual" + (f"({s})" if s is not None else ""), structures.sigma(theta[sl], m.structure(s).struct, len(m.traits), m.structure(s).rank))
        return out

    def vpredict(self, expression: str) -> tuple[float, float]:
        """A function of the components V1, V2, ... and its standard error by the delta method."""
        import ast

        tree = ast.parse(expression, mode="eval")
        allowed = {"sqrt": math.sqrt, "log": math.log, "exp": math.exp, "abs": abs}
        for node in ast.walk(tree):
            if not isinstance(node, (ast.Expression, ast.BinOp, ast.UnaryOp, ast.operator, ast.unaryop, ast.Constant, ast.Name, ast.Load, ast.Call)):
                raise ValueError(f"not allowed in {expression!r}: {type(node).__name__}")
            if isinstance(node, ast.Call) and not (isinstance(node.func, ast.Name) and node.func.id in allowed):
                raise ValueError(f"only {', '.join(allowed)} may be called")
            if isinstance(node, ast.Name) and node.id not in allowed and not (node.id[0] == "V" and node.id[1:].isdigit()):
                raise ValueError(f"unknown name {node.id}")

        def value(node, v: list[float]) -> float:
            if isinstance(node, ast.Expression):
                return value(node.body, v)
            if isinstance(node, ast.Constant):
                return float(node.value)
            if isinstance(node, ast.Name):
                return v[int(node.id[1:]) - 1]
            if isinstance(node, ast.Call):
                return allowed[node.func.id](*[value(a, v) for a in node.args])
            if isinstance(node, ast.UnaryOp):
                return -value(node.operand, v) if isinstance(node.op, ast.USub) else value(node.operand, v)
            a, b = value(node.left, v), value(node.right, v)
            return {ast.Add: a + b, ast.Sub: a - b, ast.Mult: a * b}[type(node.op)] if not isinstance(node.op, (ast.Div, ast.Pow)) else (a / b if isinstance(node.op, ast.Div) else a**b)

        f = lambda theta: value(tree, list(self.components(theta).values()))
        g = optimise.gradient(f, self.theta)
        return f(self.theta), math.sqrt(max(0.0, float(g @ self.theta_cov @ g)))

    def varcomp(self) -> DataFrame:
        """name, component, se."""
        names = list(self.components())
        rows = [(n, *self.vpredict(f"V{k + 1}")) for k, n in enumerate(names)]
        return self.spark.createDataFrame(rows, "name string, component double, se double")

    def fixed(self) -> DataFrame:
        b = self.estimates
        rows = [(e.name, str(label), float(b[e.offset + k]), math.sqrt(max(0.0, self.cinv[e.offset + k, e.offset + k]))) for e in self.model.fixed if e.name != "(empty cells)" for k, label in enumerate(e.labels)]
        return self.spark.createDataFrame(rows, "term string, effect string, estimate double, se double")

    def blups(self) -> DataFrame:
        """term, trait, level, blup, pev."""
        rows = []
        for e in self.model.random:
            if e.absorbed is not None:
                continue
            for c in range(e.t):
                for k, label in enumerate(e.labels):
                    j = e.offset + c * e.q + k
                    rows.append((e.name, (str(self.model.traits[c]) if e.t == len(self.model.traits) else str(c + 1)) if e.t > 1 else None, str(label), float(self.solution[j]), float(self.cinv[j, j])))
        schema = "term string, trait string, level string, blup double, pev double"
        out = self.spark.createDataFrame(rows, schema)
        if self.model.absorbed:
            name = next(e.name for e in self.model.random if e.absorbed is not None)
            out = out.unionByName(self.absorbed_blups().select(F.lit(name).alias("term"), F.lit(None).cast("string").alias("trait"), F.col("level").cast("string"), "blup", "pev"))
        return out

    def absorbed_blups(self) -> DataFrame:
        """level, n, blup and pev of each level of the absorbed factor, computed where its sums lie."""
        m = self.model
        su, se = self.likelihood.absorbed_at(self.theta)
        ship(self.spark)
        known, size = self.spark.sparkContext.broadcast((self.solution, self.cinv)), m.m  # as large as the equations

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            solution, cinv = known.value
            for pdf in frames:
                blup, pev = np.zeros(len(pdf)), np.zeros(len(pdf))
                for k, (n, e) in enumerate(zip(pdf["n"], pdf["e"])):
                    c, x = np.array([v["c"] for v in e], dtype=int), np.array([v["x"] for v in e])
                    own, d = c < size, n / se + 1 / su
                    blup[k] = (x[~own].sum() - x[own] @ solution[c[own]]) / se / d
                    pev[k] = 1 / d + x[own] @ cinv[np.ix_(c[own], c[own])] @ x[own] / (se * d) ** 2
                yield pd.DataFrame({"level": pdf["level"], "n": pdf["n"], "blup": blup, "pev": pev})

        kind = m.absorbed.levels.schema["level"].dataType.simpleString()
        return m.absorbed.levels.mapInPandas(run, f"level {kind}, n long, blup double, pev double")

    def wald(self) -> DataFrame:
        """Conditional Wald test of each fixed term: term, df, chi2, p."""
        rows = []
        for e in self.model.fixed:
            if e.name == "(empty cells)":
                continue
            k = slice(e.offset, e.offset + e.q)
            v, b = self.cinv[k, k], self.estimates[k]
            chi2, df = float(b @ np.linalg.pinv(v) @ b), int(np.linalg.matrix_rank(v))
            rows.append((e.name, df, chi2, chi2_sf(chi2, df)))
        return self.spark.createDataFrame(rows, "term string, df int, chi2 double, p double")

    def dimensions(self) -> DataFrame:
        """Effective dimension of each one-component term: term, q, ed, h2 = ed / (q - 1)."""
        rows, parts = [], self.components()
        for e, (_, sl) in zip(self.model.random, self.likelihood.slices):
            if e.t > 1:
                continue
            if e.absorbed is not None:
                trace = self.absorbed_blups().agg(F.sum("pev")).first()[0]
                ed = e.q - trace / parts[e.name]
                rows.append((e.name, e.q, ed, ed / max(1, e.q - 1)))
                continue
            kin = self.likelihood.level(e, self.theta[sl])
            k = slice(e.offset, e.offset + e.q)
            ed = e.q - float(np.trace(np.linalg.solve(kin, self.cinv[k, k]))) / parts[e.name]
            rows.append((e.name, e.q, ed, ed / max(1, e.q - 1)))
        return self.spark.createDataFrame(rows, "term string, q int, ed double, h2 double")

    def predict(self, classify: str, weights: str = "equal") -> DataFrame:
        """Marginal predictions of a fixed factor's levels: level, predicted, se; other factors are averaged equally or by frequency."""
        m, spec = self.model, self.model.spec
        others = [c for c in spec["levels"] if c != classify]
        numeric = sorted({c for t in spec["fixed"] for c in t if c not in spec["levels"]})
        data = m.source.na.drop(subset=[*spec["levels"], *numeric])
        means = data.agg(*[F.avg(c).alias(c) for c in numeric]).first() if numeric else {}
        freq = {c: {r[0]: r[1] for r in data.groupBy(c).count().collect()} for c in others} if weights != "equal" else {}
        rows = []
        for level in spec["levels"][classify]:
            row = np.zeros(m.m)
            for e in m.fixed:
                for k, label in enumerate(e.labels):
                    x = 1.0
                    for part in label.split(":") if e.name != "(Intercept)" else []:
                        name = next(c for c in [*spec["levels"], *numeric] if part.startswith(c) and (c in numeric and part == c or any(part == f"{c}{v}" for v in spec["levels"].get(c, []))))
                        if name in numeric:
                            x *= means[name]
                        elif name == classify:
                            x *= float(part == f"{classify}{level}")
                        else:
                            x *= freq[name][next(v for v in spec["levels"][name] if part == f"{name}{v}")] / sum(freq[name].values()) if freq else 1.0 / len(spec["levels"][name])
                    row[e.offset + k] = x
            rows.append((str(level), float(row @ self.estimates), math.sqrt(max(0.0, float(row @ self.cinv @ row)))))
        return self.spark.createDataFrame(rows, "level string, predicted double, se double")

    def interval(self, expression: str, level: float = 0.95) -> tuple[float, float]:
        v, se = self.vpredict(expression)
        z = normal_ppf(0.5 + level / 2)
        return v - z * se, v + z * se


def fit(model: Model, theta: np.ndarray | None = None, fixed_theta: np.ndarray | None = None, ml: bool = False, restarts: int = 0, seed: int = 1, optimizer: str = "auto", engine: str = "auto", low: float | np.ndarray = -12.0, high: float | np.ndarray = 12.0, like: Likelihood | None = None) -> Fit:
    """Maximise the restricted likelihood, or with ml the likelihood; entries of fixed_theta that are not NaN stay as given.

    optimizer: "ai" for average information steps and then quasi-Newton ones, "bfgs" for the latter alone, "cone" for steps on
    the scale of variances, over the cone of semidefinite matrices, "auto" for ai where it is defined, and then cone if a
    covariance between traits comes out singular. The point found is polished with Newton steps; a variance at its floor is moved up and the descent
    taken again if the likelihood rises there, and so is a point with a direction of negative curvature. engine: "mme" for
    mixed-model equations, "dense" for the covariance matrix of all rows, "auto" for the latter where the former is not
    defined. Ranges of correlations by distance begin where short descents from several of them come out best. low and
    high: the parameters' box. restarts: so many further descents from starts moved by normal noise of 0.5; the best is kept. like: the likelihood itself, if it
    isn't one of these.
    """
    began, timings = time.perf_counter(), {}
    from varispark.operators import dense

    if engine not in ("auto", "mme", "dense"):
        raise ValueError(f"unknown engine {engine!r}")
    reason = dense.out_of_scope(model) if like is None else None
    if engine == "mme" and reason:
        raise ValueError(f"the equations don't take {reason}")
    like = like or (dense.DenseLikelihood(model, ml) if engine == "dense" or reason else Likelihood(model, ml))
    start = like.start() if theta is None else np.where(np.isnan(theta), like.start(), theta)
    free = np.ones(like.size, dtype=bool)
    if fixed_theta is not None:
        free = np.isnan(fixed_theta)
        start = np.where(free, start, fixed_theta)
    if optimizer not in ("auto", "ai", "bfgs", "cone"):
        raise ValueError(f"unknown optimizer {optimizer!r}")
    informed = optimizer in ("ai", "cone") or optimizer == "auto" and not (model.residual.axes or model.absorbed or ml)
    f = like.value_and_gradient
    slope = lambda th: f(th)[1] if free.any() else np.zeros(like.size)
    parts = [(e.term.struct, ss, e.t) for e, (ss, _) in zip(model.random, like.slices)] + [(model.structure(s).struct, sl, len(model.traits)) for s, sl in zip(model.sections, like.residual) if not model.residual.axes]
    ranks: list = []

    def descend(at: np.ndarray) -> tuple[np.ndarray, float, bool]:
        if optimizer == "cone":
            at, found, ended, ranks[:] = cone.minimise(f, like.average_information, at, parts, free, low, high)
            if ended:
                return at, found, True
        if informed:
            try:
                at, _, _ = optimise.newton(f, like.average_information, at, free, low, high)
            except np.linalg.LinAlgError:
                pass
        return optimise.minimise(f, at, free, low, high)

    if theta is None and free.any():
        start = _range_sweep(like, start, free, low, high)
    if free.any():
        best, value, done = descend(start)
    else:  # nothing to descend along: the value alone, without derivatives
        best, done = np.clip(start, low, high), True
        value = float(like(best))
    timings["descent"] = time.perf_counter() - began
    rng = np.random.default_rng(seed)
    for _ in range(restarts):
        other = descend(start + np.where(free, rng.normal(0, 0.5, like.size), 0.0))
        if other[1] < value - 1e-9:
            best, value, done = other
    timings["restarts"] = time.perf_counter() - began - timings["descent"]
    singular = [ss for struct, ss, t in parts if struct == "us" and t > 1 and free[ss].all() and np.linalg.cond(structures.sigma(best[ss], "us", t)) > 1e5]
    if optimizer == "auto" and informed and singular:  # the descent on logarithms doesn't end where a matrix is singular
        try:
            at, found, ended, got = cone.minimise(f, like.average_information, start, parts, free, low, high)
            if found <= value + 1e-6:
                best, value, done, ranks[:] = at, found, ended, got
        except np.linalg.LinAlgError:
            pass
    hess = optimise.hessian(slope, best, low=low, high=high, free=free)
    for _ in range(3 if not any(r < c.t for c, r in ranks) else 0):
        away = _escape(like, best, value, free, low, high, slope, hess)
        if away is None:
            break
        other = descend(away)
        if other[1] >= value - 1e-9:
            break
        best, value, done = other
        hess = optimise.hessian(slope, best, low=low, high=high, free=free)
    if not done and not any(r < c.t for c, r in ranks):
        best, value, done = optimise.newton(f, lambda th: optimise.hessian(slope, th, low=low, high=high, free=free), best, free, low, high, rounds=5)
        hess = optimise.hessian(slope, best, low=low, high=high, free=free)
    if free.any() and not any(r < c.t for c, r in ranks):
        at, hess, ended = optimise.polish(slope, best, hess, free, low, high)
        if (at != best).any():
            best, value = at, f(at)[0]
        done = done or ended
    timings["hessian"] = time.perf_counter() - began - sum(timings.values())
    if isinstance(like, dense.DenseLikelihood):
        cinv, solution = like.solved(best)
    else:
        cinv, solution = like.inverted(best)[4], like.refined(best)[0]
    checks = optimise.diagnostics(best, value, slope(best), hess, free, low, high)
    timings["total"] = time.perf_counter() - began
    names = [*[e.name for e in model.random], *["residual" + (f"({s})" if s is not None else "") for s in model.sections]]
    faces = {name: r for c, r in ranks if r < c.t > 1 for name, (_, ss, _) in zip(names, parts) if ss.start == c.places[0]}
    return like.result(model, like, best, value, bool(done or checks["converged"]), cinv, solution, hess, free, (low, high), checks, timings, faces)


def _range_sweep(like: Likelihood, start: np.ndarray, free: np.ndarray, low, high) -> np.ndarray:
    """The best of the starts with a range of each correlation by distance at the deciles of its positions' distances,
    after three steps of descent each."""
    starts = [start]
    for e, (_, sl) in zip(like.model.random, like.slices):
        if e.term.level not in ("exp", "gau", "iexp", "igau", "ieuc", "aexp", "agau", "lvr", "sph", "cir", "mtrn") or not free[sl].any() or e.pos is None:
            continue
        pos = np.asarray(e.pos, dtype=float).reshape(e.q, -1)[:: max(1, e.q // 200)]
        d = np.sqrt(((pos[:, None] - pos[None, :]) ** 2).sum(axis=2))
        d = d[d > 0]
        if not len(d):
            continue
        for share in (0.1, 0.5, 0.9):
            reach = float(np.quantile(d, share))
            new = start.copy()
            for k in range(sl.start, sl.stop):
                if e.term.level in ("lvr", "sph", "cir") or e.term.level == "mtrn" and k == sl.start and (e.k or {"phi": (1.0, True, False)})["phi"][1]:
                    new[k] = math.log(reach)
                elif e.term.level != "mtrn":  # a correlation of one half at that distance
                    power = 2 if e.term.level in ("gau", "igau", "agau") else 1
                    new[k] = math.atanh(min(0.999999, 0.5 ** (1 / reach**power)))
            starts.append(np.where(free, new, start))
    if len(starts) == 1:
        return start
    tried = [optimise.minimise(like.value_and_gradient, x, free, low, high, rounds=3) for x in starts]
    return min(tried, key=lambda r: r[1])[0]


def _escape(like: Likelihood, theta: np.ndarray, value: float, free: np.ndarray, low, high, slope, hess: np.ndarray) -> np.ndarray | None:
    """A better point than a stationary one: with a variance off its floor, or along a direction of negative curvature."""
    floor = np.broadcast_to(low, len(theta))
    for k in np.nonzero(free & (theta <= floor + 6.0))[0]:
        top = float(np.max(theta[free]))
        for raised in (top - 1.0, top - 2.5, top - 4.0):
            new = theta.copy()
            new[k] = raised
            try:
                if raised > theta[k] and like(new) < value - 1e-6:
                    return new
            except np.linalg.LinAlgError:
                continue
    k = np.nonzero(optimise.live(theta, slope(theta), free, low, high))[0]
    if len(k):
        values, vectors = np.linalg.eigh(hess[np.ix_(k, k)])
        if values[0] < -1e-4 * max(1.0, float(np.abs(values).max())):
            for length in (0.5, -0.5, 0.1, -0.1):
                new = theta.copy()
                new[k] = new[k] + length * vectors[:, 0]
                new = np.clip(new, low, high)
                try:
                    if like(new) < value - 1e-6:
                        return new
                except np.linalg.LinAlgError:
                    continue
    return None


def reml(df: DataFrame, fixed: str, random: str | None = None, residual: str | None = None, **options) -> Fit:
    """Formulas to fit in one call; options are those of build() and of fit()."""
    rest = {k: options.pop(k) for k in ("theta", "fixed_theta", "ml", "restarts", "seed", "optimizer", "engine", "low", "high") if k in options}
    return fit(build(df, fixed, random, residual, **options), **rest)


def fitted(result: Fit, df: DataFrame) -> DataFrame:
    """df with fitted values (fixed effects and predictions of random ones) and residuals, null where a column that the model
    uses is. Levels that the model doesn't know add nothing. The rows are coded as those of the model were, and their entries
    weighed with the solution; so any terms will do, of any number of traits."""
    m = result.model
    if m.coder is None:
        raise ValueError("fitted values take a model built in this session")
    if m.residual.section == "__section":
        df = df.withColumn("__section", F.lit(0))  # groups of sections have no part in fitted values
    kept = [F.col(f"`{c}`") for c in df.columns if c != "__section"]
    solution = result.spark.createDataFrame([(result.estimates.tolist(),)], "__solution array<double>")  # as large as the equations
    out = m.coder(df, "__coo").join(F.broadcast(solution), how="cross")
    value = F.aggregate("__coo", F.lit(0.0), lambda a, e: a + e["x"] * F.coalesce(F.get("__solution", e["c"]), F.lit(0.0)))
    for e in m.random:
        if e.absorbed is not None:
            table = result.absorbed_blups().select(F.col("level").alias("__level"), F.col("blup").alias("__own"))
            out = out.join(table, F.col(e.term.factors[0]) == F.col("__level"), "left")
            value = value + F.coalesce("__own", F.lit(0.0))
    return out.withColumn("__value", value).select(*kept, F.col("__value").alias("fitted"), (F.expr(m.response) - F.col("__value")).alias("resid"))


def spatial_trend(result: Fit, name: str, grid: tuple[int, int] | None = None) -> DataFrame:
    """The fitted surface of a spl2d term (with at: "term[level]") at its positions, or on a grid of so many rows and columns
    over its domain: its two columns and trend (fixed and random parts)."""
    factors, at, lines, blocks, names = result.model.spec["surfaces"][name]
    if grid:
        made = result.model.spec["made"][name]
        line = [np.linspace(a.low, a.high, n) for a, n in zip(made.axes, grid)]
        x, y = (v.ravel() for v in np.meshgrid(*line, indexing="ij"))
        at, (lines, blocks) = pd.DataFrame({factors[0]: x, factors[1]: y}), made.at(x, y)
    place = {e.name: e for e in [*result.model.fixed, *result.model.random]}
    trend = sum(v * result.solution[place[c].offset] for c, v in zip(names, lines.T))
    for b, z in blocks.items():
        e = place[f"{name}.{b}"]
        trend = trend + z @ result.solution[e.offset : e.offset + e.q]
    return result.spark.createDataFrame(at.assign(trend=trend))


def dense_neg2(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> float:
    """The same likelihood from a dense covariance matrix, for small data."""
    low = np.linalg.cholesky(v)
    ys, xs = np.linalg.solve(low, y), np.linalg.solve(low, x)
    lx = np.linalg.cholesky(xs.T @ xs)
    half = np.linalg.solve(lx, xs.T @ ys)
    return 2 * float(np.log(np.diag(low)).sum() + np.log(np.diag(lx)).sum()) + float(ys @ ys - half @ half)


