"""Exact top-k search by inner product, with a bit-sliced index.

Components are quantised to integers. A block of rows, ordered by id, keeps each component as
slices: bitmap j of a component has bit j of every row's value above the block's least. A query's
score is the sum of its components times these numbers: for each set bit of a component's size the
component's slices, shifted by the bit's place, are added into the sum; for a negative component
the slices' complements. Carry-save adders with AND, OR and XOR on whole bitmaps leave one bitmap for
each bit of the sum. From the most significant one downward, rows that have a bit are taken
together while no more than k are, else they alone stay in play. Rows still in play at the end
have equal scores, and those with the smallest ids are taken: the boundary is exact. Scores are
read off the bitmaps.

Blocks are made of rows dealt out by hash and written as a table, and several blocks make a group.
The queries, which are fewer and smaller, are copied to every group; a task reads its blocks' indexes
once and then its queries as they come, and returns k rows per query at most.

Vectors that are null or hold null or non-finite components take no part; shorter ones count as
padded with zeros. Rows are told apart by a number of their own: a query's candidates are all rows but itself, those
that share its id or its vector too, and each query row is answered. Ties go to the smaller id, a null id last, and among
equal ids to the row that was read first. Components are held at 2^62 in size; scores are exact before they are held at
the limits of a long. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varispark.llm.shared import materialize, ship

SCALE = 256
TOP = 5
#: Rows of a block.
BLOCK = 1 << 15
#: Blocks of a group at most; a group's indexes are held by one task.
GROUP = 32
_MOST = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v, the quantised components, and row, a number of its own, of all vectors that take part. To be written before it is used twice."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(vec_col).isNotNull() & ~bad)
    limit = float(1 << 62)
    held = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(limit)), F.lit(-limit))).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), held.alias("v"), F.monotonically_increasing_id().alias("row"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = max(width or 0, int(size.max()) if len(size) else 0)
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = values
    return out


class Block:
    """The bit-sliced index of some rows, in ascending order of id, null ones last, and of row."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, known: int, least: np.ndarray, bits: np.ndarray, slices: np.ndarray):
        self.ids, self.rows, self.known, self.least, self.bits, self.slices = ids, rows, known, least, bits, slices
        self.first = np.concatenate([[0], np.cumsum(bits)])
        self.flipped = ~slices
        every = np.zeros(slices.shape[1] * 64, dtype=np.uint8)
        every[: len(ids)] = 1
        self.exist = np.packbits(every, bitorder="little").view("<u8")
        self.by_row = np.argsort(rows)

    @classmethod
    def build(cls, ids: pa.Array, rows: np.ndarray, values: np.ndarray) -> "Block":
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        order = np.lexsort((rows, ids, null))
        ids, rows, values = ids[order], rows[order], values[order]
        least = values.min(axis=0)
        above = (values - least).view(np.uint64)
        bits = np.array([int(m).bit_length() for m in above.max(axis=0)], dtype=np.int64)
        words = -(-len(ids) // 64)
        out = np.zeros((int(bits.sum()), words * 64), dtype=np.uint8)
        k = 0
        for d, n in enumerate(bits):
            for j in range(n):
                out[k, : len(ids)] = (above[:, d] >> np.uint64(j)) & np.uint64(1)
                k += 1
        return cls(ids, rows, int((~null).sum()), least, bits, np.packbits(out, axis=1, bitorder="little").view("<u8"))

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the bits of every row's sum, lowest first, and what to add for the score."""
        at: list[list[np.ndarray]] = [[]]
        rest = 0
        for d, x in enumerate(q.tolist()):
            if d >= len(self.bits) or not x:
                continue
            lo, n = int(self.first[d]), int(self.bits[d])
            rest += x * int(self.least[d])
            rows = self.slices if x > 0 else self.flipped
            if x < 0:
                rest += x * ((1 << n) - 1)
            x, i = abs(x), 0
            while x:
                if x & 1:
                    while len(at) < i + n:
                        at.append([])
                    for j in range(n):
                        at[i + j].append(rows[lo + j])
                x >>= 1
                i += 1
        out, w = [], 0
        while w < len(at):
            have = at[w]
            if len(have) > 1 and w + 1 == len(at):
                at.append([])
            while len(have) > 2:
                a, b, c = have.pop(), have.pop(), have.pop()
                x = a ^ b
                carry = a & b
                carry |= x & c
                x ^= c
                have.insert(0, x) if len(have) > 2 else have.append(x)
                at[w + 1].append(carry)
            if len(have) == 2:
                a, b = have
                at[w + 1].append(a & b)
                have = [a ^ b]
            out.append(have[0] if have else np.zeros_like(self.exist))
            w += 1
        return out, rest

    def top(self, row: int, q: np.ndarray, k: int) -> list[tuple[int, bool, int, int]]:
        """Score, whether the id is null, id and row of the k best rows but the query's own; ties at the end go to the smaller id."""
        bits, rest = self.sums(q)
        live = self.exist
        at = np.searchsorted(self.rows, row, sorter=self.by_row)
        if at < len(self.rows) and self.rows[self.by_row[at]] == row:
            own, live = int(self.by_row[at]), live.copy()
            live[own >> 6] &= ~np.uint64(1 << (own & 63))
        got, n = np.zeros_like(live), 0
        for s in reversed(bits):
            have = live & s
            m = int(np.bitwise_count(have).sum())
            if n + m > k:
                live = have
            else:
                got |= have
                n += m
                live = live & ~s
                if n == k:
                    break
        rows = _positions(got).tolist()
        if n < k:
            rows += _positions(live, k - n).tolist()
        score = lambda r: rest + sum((int(s[r >> 6]) >> (r & 63) & 1) << w for w, s in enumerate(bits))
        return [(score(r), r >= self.known, int(self.ids[r]), int(self.rows[r])) for r in rows]

    def pack(self) -> tuple:
        return self.ids.tobytes(), self.rows.tobytes(), np.array([self.known]).tobytes(), self.least.tobytes(), self.bits.tobytes(), self.slices.tobytes()

    @classmethod
    def unpack(cls, ids: bytes, rows: bytes, known: bytes, least: bytes, bits: bytes, slices: bytes) -> "Block":
        ids = np.frombuffer(ids, "<i8")
        return cls(ids, np.frombuffer(rows, "<i8"), int(np.frombuffer(known, "<i8")[0]), np.frombuffer(least, "<i8"), np.frombuffer(bits, "<i8"), np.frombuffer(slices, "<u8").reshape(-1, -(-len(ids) // 64)))


def _positions(bitmap: np.ndarray, most: int | None = None) -> np.ndarray:
    (words,) = np.nonzero(bitmap)
    if most is not None:
        words = words[:most]
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, b = np.nonzero(bits)
    return (words[w] * 64 + b)[:most]


_PARTS = ["ids", "rows", "known", "least", "bits", "slices"]


def index(rows: DataFrame, blocks: int) -> DataFrame:
    """One row per block: block and the parts of its bit-sliced index."""
    ship(rows.sparkSession)

    def build(table: pa.Table) -> pa.Table:
        own = Block.build(table.column("vec_id").combine_chunks(), table.column("row").to_numpy(), _matrix(table.column("v")))
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int64()), *[pa.array([p], pa.binary()) for p in own.pack()]], names=["block", *_PARTS])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(build, ", ".join(["block long", *[f"{c} binary" for c in _PARTS]]))


def search(vectors: DataFrame, queries: str, k: int = TOP, block: int = BLOCK) -> DataFrame:
    """The k best rows of each query row: query_id, rank, vec_id, score. queries: an SQL condition on vec_id that picks query rows."""
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors), "vectors")
    blocks = max(1, -(-rows.count() // block))
    groups = max(-(-blocks // GROUP), min(blocks, 2 * spark.sparkContext.defaultParallelism))
    built = materialize(index(rows, blocks), "slices")
    asked = rows.where(F.expr(queries)).select(F.col("vec_id").alias("query_id"), F.col("row").alias("q"), "v")
    # A group's indexes come first in its task, then a copy of each query.
    names = ["group", "asks", *_PARTS, "query_id", "q", "v"]
    left = built.withColumns({"group": F.pmod("block", F.lit(groups)), "asks": F.lit(0), "query_id": F.lit(None).cast("long"), "q": F.lit(None).cast("long"), "v": F.lit(None).cast("array<bigint>")})
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    right = asked.withColumns({"group": every, "asks": F.lit(1), **{c: F.lit(None).cast("binary") for c in _PARTS}})

    def meet(batches):
        own, group = [], None
        for batch in batches:
            asks, at = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for x in np.nonzero(asks == 0)[0].tolist():
                if at[x] != group:
                    yield from answers(batch, asks, at, group, own)
                    own, group = [], at[x]
                own.append(Block.unpack(*[batch.column(c)[x].as_py() for c in _PARTS]))
            yield from answers(batch, asks, at, group, own)

    def answers(batch, asks, at, group, own):
        asking = batch.filter(pa.array((asks == 1) & (at == group))) if group is not None else batch.slice(0, 0)
        out = [], [], [], [], []
        for query_id, q, v in zip(asking.column("query_id").to_pylist(), asking.column("q").to_pylist(), _matrix(asking.column("v"))):
            found = [x for b in own for x in b.top(q, v, k)]
            found.sort(key=lambda x: (-x[0], *x[1:]))
            for score, null, vec_id, row in found[:k]:
                for store, y in zip(out, (query_id, q, None if null else vec_id, row, max(-_MOST - 1, min(_MOST, score)))):
                    store.append(y)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()) for y in out], ["query_id", "q", "vec_id", "row", "score"])

    placed = left.select(*names).unionByName(right.select(*names)).repartition("group").sortWithinPartitions("group", "asks")
    met = placed.mapInArrow(meet, "query_id long, q long, vec_id long, row long, score long")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"))
    return met.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
