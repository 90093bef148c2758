"""Whitening of embeddings by an exact scatter in residue numbers.

Components become integers. Their sums per dimension are taken first; then each row is centred without rounding,
as n * x - S, and reduced modulo several primes below 2^20. Products of two residues (taken between -p/2 and p/2) are
below 2^38, so a product of matrices of up to 2^14 rows is exact in doubles: each partition multiplies its residues
once for each prime and keeps the remainders. Remainders are summed by Spark, and the Chinese remainder theorem gives
the scatter, exact, from as many primes as its bound needs. It is then divided once, correctly rounded, and a
double-precision eigendecomposition gives the components.

What the driver holds are d x d numbers for each prime, whatever the number of rows. Of a partition, only d x d
sums leave a task.

Vectors that are null or hold null or non-finite entries take no part; shorter ones count as padded with zeros (an
empty one is all zeros). Entries whose integer would not fit are held at +-2^62. Null and repeated ids are rows like any
others. Components without variance can't be scaled to one and are left out: one vector, or equal ones, give no rows,
and so does an empty table. A deviation that doesn't fit in a long is null there and exact in deviation_text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.llm.shared import materialize, ship, unused

SCALE, SHIFT, TOP = 1024, 100_000, 8
#: Integers beyond are held here.
_MOST = 1 << 62
_HALF = 31
#: Rows of one matrix product: 2^14 products below 2^38 stay below 2^53.
ROWS = 1 << 14


def usable(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """The rows whose vector takes part."""
    v = F.col(vec_col)
    return vectors.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))


def integers(column: pa.Array, width: int, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """floor(scale * c) + shift of each row's entries, padded to the width as if by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    limit = float(_MOST)
    with np.errstate(over="ignore"):
        flat = np.floor(scale * flat)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = np.clip(flat, -limit, limit).astype(np.int64)
    return out + shift


def primes(bound: int) -> list[int]:
    """Primes below 2^20, largest first, whose product exceeds twice the bound: numbers up to it in size have residues of their own."""
    found, product, p = [], 1, (1 << 20) - 1
    while product <= 2 * bound:
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def restored(residues: list[int], moduli: list[int]) -> int:
    """The number nearest to zero with these residues."""
    x, product = 0, 1
    for r, p in zip(residues, moduli):
        x += product * ((r - x) * pow(product, -1, p) % p)
        product *= p
    return x - product if 2 * x > product else x


@dataclass
class Whitening:
    n: int
    #: Exact sums of each dimension, and n squared times the scatter's entries divided by n: both whole numbers.
    sums: list[int]
    scatter: list[list[int]]
    trace: float
    #: The largest size of an entry of n * x - S.
    most: int
    values: np.ndarray
    vectors: np.ndarray


def sums(rows: DataFrame, width: int) -> tuple[int, list[int], list[int], list[int]]:
    """n, and per dimension the exact sum, least and largest integer. A task gives one row per dimension."""

    def add(batches):
        n, high, low = 0, np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
        least, most = np.full(width, np.iinfo(np.int64).max), np.full(width, np.iinfo(np.int64).min)
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column(0), width)
                n += len(x)
                high += (x >> _HALF).sum(0)
                low += (x & ((1 << _HALF) - 1)).sum(0)
                least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (np.arange(width), np.full(width, n), high, low, least, most)], ["d", "n", "high", "low", "least", "most"])

    parts = rows.mapInArrow(add, "d long, n long, high long, low long, least long, most long")
    # Halves are summed as decimals: no number of rows overflows them.
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    got = parts.groupBy("d").agg(F.sum("n").alias("n"), total("high"), total("low"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("d").collect()
    return got[0]["n"], [(int(r["high"]) << _HALF) + int(r["low"]) for r in got], [r["least"] for r in got], [r["most"] for r in got]


def centred(x: np.ndarray, n: int, s: list[int], most: int) -> np.ndarray:
    """n * x - S, exact: in 64 bits where the largest of all rows fits, else as Python's integers."""
    if max(most, n * _largest(x), max(map(abs, s))) < _MOST:
        return n * x - np.array(s, dtype=np.int64)
    return n * x.astype(object) - np.array(s, dtype=object)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def scatter(rows: DataFrame, width: int, n: int, s: list[int], most: int) -> list[list[int]]:
    """The exact sums over rows of products of two entries of n * x - S."""
    moduli = primes(n * most * most)

    def multiply(batches):
        got = np.zeros((len(moduli), width, width), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = integers(batch.column(0).slice(at, ROWS), width)
                for k, p in enumerate(moduli):
                    # The residue of each factor first: nothing here exceeds 2^41.
                    r = ((n % p) * (x % p) - np.array([v % p for v in s], dtype=np.int64)) % p
                    r = np.where(2 * r > p, r - p, r).astype(np.float64)
                    got[k] = (got[k] + (r.T @ r).astype(np.int64)) % p
        if got.any():
            i, j = np.triu_indices(width)
            for k in range(len(moduli)):
                for part in np.array_split(np.arange(len(i)), max(1, len(i) >> 16)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k)), pa.array(i[part]), pa.array(j[part]), pa.array(got[k][i[part], j[part]])], ["k", "i", "j", "r"])

    parts = rows.mapInArrow(multiply, "k long, i long, j long, r long").groupBy("k", "i", "j").agg(F.sum("r").alias("r"))
    table = np.zeros((len(moduli), width, width), dtype=np.int64)
    for batch in [parts.toArrow()]:
        k, i, j, r = [batch.column(c).to_numpy() for c in ("k", "i", "j", "r")]
        table[k, i, j] = r % np.array(moduli)[k]
    out = [[0] * width for _ in range(width)]
    for i in range(width):
        for j in range(i, width):
            out[i][j] = out[j][i] = restored([int(v) for v in table[:, i, j]], moduli)
    return out


def fit(vectors: DataFrame, vec_col: str = "embedding", top: int = TOP) -> Whitening | None:
    """The components of all usable vectors, at most top of them; None if there are no vectors."""
    ship(vectors.sparkSession)
    rows = usable(vectors, vec_col).select(F.col(vec_col).alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return None
    n, s, least, largest = sums(rows, width)
    most = max(max(abs(n * a - t), abs(n * b - t)) for a, b, t in zip(least, largest, s))
    q = scatter(rows, width, n, s, most) if most else [[0] * width for _ in range(width)]
    cube = n**3  # q is n^2 times the scatter, and the covariance's divisor is n
    v = np.array([[x / cube for x in row] for row in q])  # quotients of Python's integers are correctly rounded
    trace = sum(q[d][d] for d in range(width)) / cube
    values, parts = np.linalg.eigh(v)
    values, parts = values[::-1], parts[:, ::-1]
    # A sign that doesn't depend on the library: the largest entry is positive.
    parts = parts * np.where(parts[np.abs(parts).argmax(0), np.arange(width)] < 0, -1.0, 1.0)
    good = int((values > width * np.finfo(float).eps * max(values[0], 0.0)).sum())
    good = min(good, top)
    return Whitening(n, s, q, trace, most, values[:good].copy(), parts[:, :good].copy())


def transform(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per usable row its id, deviation (of n * x - S, exact, as text and as a long where it fits) and w, its whitened components."""
    ship(vectors.sparkSession)
    n, s, most, width = model.n, model.sums, model.most, len(model.sums)
    load = model.vectors / np.sqrt(model.values)
    fits = width * most * most < (1 << 63)

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c = centred(integers(batch.column(1), width), n, s, most)
            if fits:
                c = c.astype(np.int64)
                deviation = (c * c).sum(1)
                text = [str(v) for v in deviation.tolist()]
                deviation = pa.array(deviation)
            else:
                exact = [sum(v * v for v in row) for row in c.astype(object).tolist()]
                text, deviation = [str(v) for v in exact], pa.array([v if v < (1 << 63) else None for v in exact], pa.int64())
            w = (c / n).astype(np.float64) @ load
            w = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.array(text), w], ["id", "deviation", "deviation_text", "w"])

    rows = usable(vectors, vec_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return rows.mapInArrow(project, "id long, deviation long, deviation_text string, w array<double>").withColumnRenamed("id", id_col)


def identity_error(white: DataFrame, size: int) -> float:
    """The largest entry, in size, of the whitened components' covariance minus the identity; centred before multiplying."""
    w = [F.get("w", F.lit(k)) for k in range(size)]
    means = white.agg(*[F.avg(x).alias(f"m{k}") for k, x in enumerate(w)]).first()
    at = [x - F.lit(float(means[k])) for k, x in enumerate(w)]
    pairs = [(a, b) for a in range(size) for b in range(a, size)]
    cov = white.agg(*[F.avg(at[a] * at[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(cov[k] - (a == b)) for k, (a, b) in enumerate(pairs))


def digest(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """What op11 returns: one row for each usable vector and component."""
    spark, schema = vectors.sparkSession, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
    model = fit(vectors, top=top)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    white = materialize(transform(vectors, model), "whitened")
    error = identity_error(white, len(model.values))
    p = unused("c", white)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    out = white.select("vec_id", "deviation", "deviation_text", F.posexplode("w").alias(p, "whitened"))
    return out.select("vec_id", (F.col(p) + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col(p)).alias("explained"), F.lit(error).alias("identity_error"), "deviation_text")
