"""Packing documents into sequences: patterns by non-negative least squares, best fit for the rest.

Only the histogram of piece lengths, with at most ``capacity`` entries, comes to the driver. There,
patterns of two or three lengths that fill a sequence exactly are enumerated, and counts of how
often to repeat each are fitted to the histogram by non-negative least squares (coordinate descent
that starts with the patterns that gain most), where misses count more the longer the length, since
short pieces are easy to place later. Of the counts a share is taken, rounded down and cut to what the
histogram has; all that is left is packed best fit, longest first, over whole groups of equal
sequences. The share is that of SHARES that needs fewest sequences. The plan's size depends on the
capacity and not on the number of documents.

Pieces of one length are numbered: each task numbers its own while it encodes, and sums over tasks
give each task's first number. A piece finds its sequence and offset from its length and number by
binary search in the plan.

Null text counts as empty and has the end id alone. Longer documents are cut so that all pieces but
the first are full. Repeated rows are packed like others. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varispark.llm.shared import materialize, ship, slices
from varispark.llm.tokens import encoder

CAPACITY = 1024
ROUNDS = 300
#: Shares of the fitted counts that are tried.
SHARES = (1.0, 0.75, 0.5, 0.25)
#: Least weight of a length in the fit; a length weighs its part of the capacity.
LEAST_WEIGHT = 0.01


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Triples of lengths (the first may be 0) in ascending order that sum to the capacity."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    have[0] = True
    out = []
    values = np.nonzero(have)[0]
    for a in values:
        b = values[(values >= max(a, 1)) & (values <= (capacity - a) // 2)]
        c = capacity - a - b
        ok = have[c] & (c < capacity)
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def fit(histogram: np.ndarray, triples: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares of the patterns' counts against the histogram.

    Each round takes steps along patterns that share no length, largest gain first, each to its minimum.
    """
    x = np.zeros(len(triples))
    if not len(triples):
        return x
    capacity = int(triples[0].sum())
    weight = np.maximum(np.arange(capacity + 1) / capacity, LEAST_WEIGHT)
    weight[0] = 0.0
    r = histogram.astype(float)
    a, b, c = triples.T
    # a length that a pattern has twice or three times counts squared
    norm = weight[a] + weight[b] + weight[c] + 2 * (weight[a] * ((a == b) + (a == c)) + weight[b] * (b == c))
    for _ in range(rounds):
        wr = weight * r
        step = np.maximum((wr[a] + wr[b] + wr[c]) / norm, -x)
        gain = step * step * norm
        best = np.argsort(-gain)[:4096]
        if gain[best[0]] < 0.05:
            break
        taken = np.zeros(len(r), dtype=bool)
        picked = []
        for j, (u, v, w) in zip(best.tolist(), triples[best].tolist()):
            if not (taken[u] or taken[v] or taken[w]):
                taken[v] = taken[w] = True
                taken[u] = u > 0
                picked.append(j)
        picked = np.array(picked)
        x[picked] += step[picked]
        for k in range(3):
            np.subtract.at(r, triples[picked, k], step[picked])
    return x


def best_plan(histogram: np.ndarray, capacity: int = CAPACITY) -> "Plan":
    """The plan with fewest sequences among the shares of the fitted counts."""
    left = histogram.astype(np.int64)
    triples = patterns(np.nonzero(left[:capacity])[0], capacity)
    counts = fit(left, triples)
    return min((Plan(left, capacity, triples, share * counts) for share in SHARES), key=lambda p: p.sequences)


class Plan:
    """Ranges of numbers of each length, and the sequences and offsets that they go to."""

    def __init__(self, histogram: np.ndarray, capacity: int, triples: np.ndarray, counts: np.ndarray):
        self.capacity, self.left = capacity, histogram.astype(np.int64).copy()
        self.next = np.zeros(capacity + 1, dtype=np.int64)
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first number, count, first sequence, offset
        self.sequences = 0
        self._open(int(self.left[capacity]), [capacity])
        counts = np.floor(counts + 1e-6).astype(np.int64)
        for j in np.argsort(-counts, kind="stable"):
            if counts[j] < 1:
                break
            members = [int(v) for v in triples[j] if v]
            most = min(int(self.left[v]) // members.count(v) for v in members)
            self._open(min(int(counts[j]), most), members)
        self.fitted = self.sequences
        self._best_fit()
        rows = np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 5)
        self.length, self.first, self.count, self.sequence, self.offset = rows.T

    def _put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, int(self.next[length]), count, sequence, offset))
        self.next[length] += count
        self.left[length] -= count

    def _open(self, count: int, members: list[int]) -> int:
        """So many new sequences with these members; the first one's number."""
        at, first = 0, self.sequences
        if count > 0:
            for v in members:
                self._put(v, count, first, at)
                at += v
            self.sequences += count
        return first

    def _best_fit(self) -> None:
        room: list[list[tuple[int, int]]] = [[] for _ in range(self.capacity + 1)]  # by space: first sequence, count
        space = 0
        for length in range(self.capacity - 1, 0, -1):
            space = length
            while self.left[length]:
                while space <= self.capacity and not room[space]:
                    space += 1
                n = int(self.left[length])
                if space <= self.capacity:
                    sequence, count = room[space].pop()
                    m = min(n, count)
                    if m < count:
                        room[space].append((sequence + m, count - m))
                    self._put(length, m, sequence, self.capacity - space)
                    room[space - length].append((sequence, m))
                    space = length
                else:
                    each = min(n, self.capacity // length)
                    m = n // each
                    room[self.capacity - each * length].append((self._open(m, [length] * each), m))
                    space = length

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by their length and number."""
        big = int(self.next.max()) + 1
        k = np.searchsorted(self.length * big + self.first, length * big + number, side="right") - 1
        return self.sequence[k] + number - self.first[k], self.offset[k]


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and task and number within the task and length."""
    ship(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        own, task = encoder(path), TaskContext.get().partitionId()
        end = int(end_id).to_bytes(4, "little")
        seen = [0] * (capacity + 1)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), own.ids([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    n, at, k = len(ids) // 4, 0, 0
                    while at < n:
                        size = (n - at) % capacity or capacity
                        rows.append((doc_id, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), task, seen[size]))
                        seen[size] += 1
                        at += size
                        k += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, number long")


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = materialize(pieces(docs, path, end_id, capacity), "pieces")
    counts = rows.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        histogram[r["length"]] = r["n"]
    plan = best_plan(histogram, capacity)
    numbered = rows.join(firsts.select(F.col("length").alias("l"), F.col("task").alias("t"), "base"), (F.col("length") == F.col("l")) & (F.col("task") == F.col("t")))
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("number")).alias("number"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            sequence, offset = plan.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names)

    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
