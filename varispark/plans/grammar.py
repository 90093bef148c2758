"""Formulas: fixed effects, random terms and residuals, as plain descriptions.

    fixed:    "y ~ 1 + trt + x + trt:x"        the response may be any SQL expression
    random:   "~ gid + us(gid) + ar1(col) + vm(gid, K) + fa(gid, rank=2) + mm(weights) + str(~ gid + mm(weights), us, K=K)
               + own(x, 'exp(-p1 * d)', n_par=1) + spl2d(row, col, nseg=5)"
    residual: "~ units", "~ diag(trait):units", "~ us(trait):units", "~ ar1(row):ar1(col)", "~ dsum(~ units | section)"

mm() takes a column of maps from levels to numbers; str() has one effect per level for each of its parts, and a
covariance between them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from varispark.functions.structures import MATERN, matern_options

SIGMA = ("iid", "diag", "us", "fa", "rr", "chol", "ante", "corh")
LEVELS = ("cor", "ar1", "ar2", "ar3", "sar", "ma1", "ma2", "arma", "corb", "corg", "exp", "gau", "iexp", "igau", "ieuc", "aexp", "agau", "lvr", "sph", "cir", "mtrn")


#: Named arguments of single kinds of terms, beside those that all take.
ARGUMENTS = {"corb": {"order"}, "own": {"n_par", "normalise"}, "spl2d": {"nseg", "deg", "pord", "nest", "at"}, "mtrn": {"phi", "nu", "delta", "alpha", "lambda"}}


@dataclass
class Term:
    """One random term: a factor (or the positions that make up its levels), its structures and options."""

    name: str
    factors: list[str]
    struct: str = "iid"
    level: str = "id"
    rank: int = 1
    options: dict = field(default_factory=dict)


@dataclass
class Residual:
    struct: str = "iid"
    rank: int = 1
    section: str | None = None
    axes: list[tuple[str, str]] = field(default_factory=list)  # kind (id, ar1) and column of each direction of a lattice
    groups: list[list[str]] = field(default_factory=list)  # levels of the section column that share a residual
    bodies: list["Residual"] = field(default_factory=list)  # a residual for each group

    def names(self) -> list[str]:
        return ["_".join(g) for g in self.groups]


def split(text: str, sep: str) -> list[str]:
    """Parts of a text between separators that stand outside parentheses."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == sep and not depth:
            out.append(text[at:k].strip())
            at = k + 1
    if depth:
        raise ValueError(f"unbalanced parentheses in {text!r}")
    return [*out, text[at:].strip()]


def parse_fixed(formula: str) -> tuple[str, bool, list[tuple[str, ...]]]:
    """Response, whether there is an intercept, and the terms as tuples of columns; a*b stands for a + b + a:b."""
    left, right = split(formula, "~")
    intercept, terms = True, []
    for part in split(right.replace("-", "+-"), "+"):
        part = part.replace(" ", "")
        if part in ("", "1"):
            continue
        if part in ("0", "-1"):
            intercept = False
        elif "*" in part:
            names = part.split("*")
            terms += [(n,) for n in names] + [tuple(names)]
        else:
            terms.append(tuple(part.split(":")))
    return left, intercept, list(dict.fromkeys(terms))


def parse_random(formula: str | None) -> list[Term]:
    if not formula:
        return []
    out = []
    for part in split(formula.split("~", 1)[1], "+"):
        m = re.fullmatch(r"(\w+)\((.*)\)", part, re.S)
        if not m:
            if not re.fullmatch(r"\w+", part):
                raise ValueError(f"random term not understood: {part!r}")
            out.append(Term(part, [part]))
            continue
        kind, inside = m[1], split(m[2], ",")
        options = dict(re.split(r"\s*=\s*", x, maxsplit=1) for x in inside if "=" in x)
        factors = [x for x in inside if "=" not in x]
        most = {"vm": 2, "str": 2, "own": 3, "spl2d": 2, "mm": 1, "sep": 2}.get(kind, 2 if kind in LEVELS else 1)
        if len(factors) > most or not all(factors):
            raise ValueError(f"{part!r}: takes 1 to {most} arguments without a name")
        allowed = {"rank", "K", "Kinv", "struct"} | ARGUMENTS.get(kind, set())
        unknown = set(options) - allowed
        if unknown:
            raise ValueError(f"{part!r}: unknown argument {', '.join(sorted(unknown))}")
        rank = int(options.pop("rank", 1))
        if kind == "str":
            parts = [re.sub(r"^mm\((\w+)\)$", r"mm:\1", x) for x in split(factors[0].lstrip("~ "), "+")]
            out.append(Term(part, parts, factors[1] if len(factors) > 1 else "us", "fixed" if options.keys() & {"K", "Kinv"} else "id", rank, {"parts": len(parts), **options}))
        elif kind == "mm":
            out.append(Term(part, [f"mm:{factors[0]}"], options.get("struct", "iid"), "fixed" if options.keys() & {"K", "Kinv"} else "id", rank, {"parts": 1, **options}))
        elif kind == "own":
            out.append(Term(part, factors[:-1], options.get("struct", "iid"), "own", rank, {"expr": factors[-1].strip("'\""), "order": options.get("n_par", 1), "normalise": options.get("normalise", "1")}))
        elif kind == "spl2d":
            out.append(Term(part, factors, "iid", "spl2d", rank, options))
        elif kind == "vm":
            out.append(Term(part, factors[:1], options.get("struct", "iid"), "fixed", rank, {"K": factors[1], **options}))
        elif kind in SIGMA:
            out.append(Term(part, factors, kind, "fixed" if options.keys() & {"K", "Kinv"} else "id", rank, options))
        elif kind == "mtrn":
            values = matern_options(options)
            out.append(Term(part, factors, options.get("struct", "iid"), kind, rank, {"matern": values, "order": sum(values[n][1] for n in MATERN)}))
        elif kind in LEVELS:
            out.append(Term(part, factors, options.get("struct", "iid"), kind, rank, options))
        else:
            raise ValueError(f"unknown random structure {kind!r}")
    return out


def parse_residual(formula: str | None) -> Residual:
    if not formula:
        return Residual()
    body = formula.split("~", 1)[1].strip()
    m = re.fullmatch(r"dsum\(\s*~(.*)\|\s*(\w+)\s*(?:,\s*levels\s*=\s*\[(.*)\]\s*)?\)", body, re.S)
    if m:
        parts = split(m[1], "+")
        if len(parts) > 1 or m[3] is not None:
            groups = [[v.strip().strip("'\"") for v in g.split(",")] for g in re.findall(r"\[([^\]]*)\]", m[3] or "")]
            if len(groups) != len(parts):
                raise ValueError(f"{len(parts)} residuals and {len(groups)} groups of levels in {body!r}")
            listed = [v for g in groups for v in g]
            if len(set(listed)) < len(listed):
                raise ValueError("a level is in two groups")
            bodies = [parse_residual("~" + x) for x in parts]
            if any(b.axes or b.section for b in bodies):
                raise ValueError("residuals of groups of levels are of units")
            return Residual(section=m[2], groups=groups, bodies=bodies)
        inner = parse_residual("~" + m[1])
        return Residual(inner.struct, inner.rank, m[2], inner.axes)
    axes = [re.fullmatch(r"(ar1|id)\(\s*(\w+)\s*\)", x) for x in split(body, ":")]
    if len(axes) == 2 and all(axes):
        return Residual(axes=[(a[1], a[2]) for a in axes])
    m = re.match(r"(\w+)\(\s*\w+\s*(?:,\s*rank\s*=\s*(\d+))?\s*\)\s*:", body)
    if m and m[1] in ("iid", "diag", "us", "fa"):
        return Residual(m[1], int(m[2] or 1))
    if body == "none":
        return Residual("none")
    if m or not re.fullmatch(r"\w+", body):
        raise ValueError(f"residual not understood: {body!r}")
    return Residual()
