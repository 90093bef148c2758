"""Hypotheses of scans: "family[traits] + family@common + family@het | conditioning".

Each family that is named brings columns to a locus's model: one for each trait, or with @common their sum alone. In terms of
effects by family and trait these columns are a basis, the family's unit vector times a basis of traits, and what is tested is
a matrix of contrasts over the columns: single effects, or with @het differences from the first trait. Families after the
bar are in the model and not tested.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import takewhile

import numpy as np

#: Fixed names of the query language: doses of the row itself, of its neighbours, and the products of the two.
FAMILIES = ("dir", "ind", "sim")


@dataclass(frozen=True)
class Part:
    """One summand of a test."""

    family: str
    traits: tuple[str, ...] | None = None
    mode: str = ""

    @property
    def block(self) -> tuple[str, bool]:
        """The columns that it speaks of."""
        return self.family, self.mode == "common"


def parts(text: str, spec: str) -> list[Part]:
    """The summands of one side of a test."""

    def refuse(why: str):
        raise ValueError(f"{spec!r}: {why}")

    found, rest = [], text.strip()
    while rest:
        family = "".join(takewhile(str.isalpha, rest))
        rest = rest[len(family) :].lstrip()
        if family not in FAMILIES:
            refuse(f"no family of {', '.join(FAMILIES)} before {rest!r}" if not family else f"{family!r} is no family")
        traits, mode = None, ""
        if rest[:1] == "[":
            inside, end, rest = rest[1:].partition("]")
            traits, rest = tuple(t for t in map(str.strip, inside.split(",")) if t), rest.lstrip()
            if not end or not traits:
                refuse("traits stand between brackets")
        if rest[:1] == "@":
            mode = "".join(takewhile(str.isalpha, rest[1:].lstrip()))
            rest = rest[1:].lstrip()[len(mode) :].lstrip()
            if mode not in ("common", "het") or traits:
                refuse(f"@{mode} isn't common or het" if mode not in ("common", "het") else "traits and @ exclude each other")
        found.append(Part(family, traits, mode))
        if rest[:1] not in ("", "+"):
            refuse(f"cannot read {rest!r}")
        rest = rest[1:].strip()
    return found


def contrasts(part: Part, traits: list[str], spec: str) -> np.ndarray:
    """The contrasts of a summand over its family's columns."""
    every = np.eye(len(traits))
    if part.mode == "common":
        return np.ones((1, 1))
    if part.mode == "het":
        if len(traits) < 2:
            raise ValueError(f"{spec!r}: one trait has no differences")
        return every[1:] - every[0]
    if part.traits is None:
        return every
    numbers = {str(k + 1): k for k in range(len(traits))} | {t: k for k, t in enumerate(traits)}
    unknown = [t for t in part.traits if t not in numbers]
    if unknown:
        raise ValueError(f"{spec!r}: no trait {unknown[0]!r}")
    return every[[numbers[t] for t in part.traits]]


def label(part: Part, contrast: np.ndarray, traits: list[str]) -> str:
    """family, family@common, family[trait] or family[trait-trait]."""
    if part.mode == "common":
        return f"{part.family}@common"
    if len(traits) == 1:
        return part.family
    return f"{part.family}[{'-'.join(traits[k] for k in np.argsort(-contrast, kind='stable') if contrast[k])}]"


def parse_test(spec: str, traits: list[str]) -> tuple[list[dict], np.ndarray, list[str]]:
    """The model's columns as weights of (family, place of the trait), the tested contrasts over these columns, each once, and their labels."""
    tested, given = (parts(side, spec) for side in (spec.partition("|")[0], spec.partition("|")[2]))
    if not tested:
        raise ValueError(f"{spec!r}: nothing is tested")
    blocks = list(dict.fromkeys(p.block for p in tested + given))
    twice = {f for f, common in blocks if (f, not common) in blocks}
    if twice:
        raise ValueError(f"{spec!r}: {min(twice)} has columns by trait and a common one")
    bases = [np.ones((1, len(traits))) if common else np.eye(len(traits)) for _, common in blocks]
    columns = [{(family, int(k)): float(line[k]) for k in np.nonzero(line)[0]} for (family, _), basis in zip(blocks, bases) for line in basis]
    sizes = [len(b) for b in bases]
    rows: dict[tuple, str] = {}
    for part in tested:
        at = blocks.index(part.block)
        for contrast in contrasts(part, traits, spec):
            whole = np.concatenate([contrast if k == at else np.zeros(size) for k, size in enumerate(sizes)])
            rows.setdefault(tuple(whole), label(part, contrast, traits))
    return columns, np.array(list(rows)), list(rows.values())
