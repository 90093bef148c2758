"""Near copies by several SimHash fingerprints of a text's shingles, verified by their Jaccard similarity.

A text is the set of its runs of WORDS words; ASCII letters are lower-cased, a shorter text is one
run. Two texts are near copies if their sets' Jaccard similarity is SIMILAR or more, and near copies
of near copies are of one component.

Sets with a similarity of 0.8 differ in 15 % of their SimHash bits, 10 of 64, and a ball of that radius
has too many variants to emit. So a set has TABLES independent fingerprints of WIDTH bits: two sets
are candidates if any of them differ in 2 * RADIUS bits or fewer, which at 0.8 one of them does with
probability 0.25, and some of 24 with 0.9991. Candidates come from meet-in-the-middle ball hashing as
in simhash.py: all variants within RADIUS bits are made and those of one value linked, here only if
GUARD further bits of the two differ in GUARD_BITS or fewer (0.99999 of pairs at 0.8; 1 in 170 of unlike
ones). Where there are many sets, those meet that agree in some whole segments of a fingerprint, as
all pairs within reach do for some choice of segments, and the variants are of the other segments.
Within a cell all pairs with a common variant are held against the guard, so unlike sets don't hide
near copies from each other however dense it is; a cell that far more fingerprints share than foreseen
is taken apart by further segments. Each cell gives back its components, and these are verified on the
shingles: first each set against the smallest one that it met in any component, then, where these links
leave it apart from another component's smallest, against that, and then, in components that are still
in several parts, all pairs by products of incidence matrices, in tiles of a bounded number of shingles.
A tile gives back at most one link for each of its members.

Equal sets are one from the start, so groups of copies are candidates once. Null texts and texts
without a word have the empty set.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.llm.shared import distinct_rows, first_row, grouped, materialize, rows_at, ship, slices, small
from varispark.llm.simhash import SEED, _roots, components, joined

WORDS = 5
#: Similarity from which texts are near copies, in hundredths.
SIMILAR = 80
#: Fingerprints of a set, bits of each, and half the number of bits in which linked ones may differ.
TABLES, WIDTH, RADIUS = 24, 40, 2
#: Further bits of a set, and in how many of them linked sets may differ.
GUARD, GUARD_BITS = 64, 22
#: Sets of one fingerprint that meet in a cell, about.
GROUP = 1 << 20
#: Cells with over so many times that are taken apart, and how often.
HEAVY, DEEPER = 4, 3
#: Shingles of a part of a component, about; two parts make a tile.
TILE = 1 << 21
#: Sets of a tile whose pairs are counted at once, and shingles of them.
BLOCK = 1_024
COLUMNS = 2_048
LONGS = (TABLES * WIDTH + GUARD) // 64
FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, LONGS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A byte's bits as bytes of a long, so that up to 255 of them are counted by one addition.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the text's shingles, each once and in order."""
    import xxhash

    parts = (text or "").encode("utf-8").lower().split()  # on bytes: ASCII letters and white space only
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(parts[i : i + words]), SEED) for i in range(max(1, len(parts) - words + 1))], dtype=np.uint64))


def signature(h: np.ndarray) -> np.ndarray:
    """All fingerprints of a set, one after the other: a bit is 1 if more than half of the shingles' mixed hashes have it."""
    total = np.zeros(LONGS * 64, dtype=np.int64)
    for at in range(0, len(h), 255):
        x = h[at : at + 255, None] * FACTORS[None, :]
        x ^= x >> np.uint64(32)
        x *= FACTORS[::-1][None, :]
        x ^= x >> np.uint64(29)
        total += SPREAD[x.view(np.uint8)].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * total > len(h), bitorder="little")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key, set (a hash of the shingles), n (their number) and signature."""
    import xxhash

    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 128):
                sets = [shingles(t) for t in part.column(2).to_pylist()]
                name = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], dtype=np.uint64).view(np.int64)
                columns = [part.column(0), part.column(1), pa.array(name), pa.array([len(h) for h in sets], pa.int64()), pa.array([signature(h).tobytes() for h in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "set", "n", "signature"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, set long, n long, signature binary")


def cells(count: int, group: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Segments of a fingerprint (first bit and length), and the choices of segments that sets meet by.

    Fingerprints that differ in 2 * RADIUS bits agree in c whole segments of 2 * RADIUS + c, so they meet if each goes to a
    cell for each choice of c segments, by its bits there. c is the smallest with no more than about group fingerprints to
    a cell: none for few, and a fingerprint goes to 1, 5, 15, 35, ... cells.
    """
    c = 0
    while count >> (WIDTH * c // (2 * RADIUS + c)) > group and c < 6:
        c += 1
    n = 2 * RADIUS + c
    cut = [WIDTH * k // n for k in range(n + 1)]
    return [(x, y - x) for x, y in zip(cut, cut[1:])], list(itertools.combinations(range(n), c))


def _bits(fp: np.ndarray, segments: list[tuple[int, int]]) -> np.ndarray:
    """The bits of these segments, side by side."""
    out, at = np.zeros(len(fp), dtype=np.uint64), 0
    for first, size in segments:
        out |= ((fp >> np.uint64(first)) & np.uint64((1 << size) - 1)) << np.uint64(at)
        at += size
    return out


class Plan:
    """The cells that fingerprints go to: segments and choices of them at first, and then, for cells that are too heavy, each of
    2 * RADIUS + 1 parts of the bits that are left, in one of which at least any two within reach agree."""

    def __init__(self, count: int, group: int):
        self.segments, self.choices = cells(count, group)
        self.heavy: list[np.ndarray] = []  # names of the heavy cells of each depth

    def left(self, k: int) -> list[tuple[int, int]]:
        """The segments in which members of the k-th choice's cells can differ."""
        return [s for i, s in enumerate(self.segments) if i not in self.choices[k]]

    @staticmethod
    def parts(free: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        """The bits of these segments, dealt to 2 * RADIUS + 1 parts."""
        bits = [b for first, size in free for b in range(first, first + size)]
        n = 2 * RADIUS + 1
        return [[(b, 1) for b in bits[len(bits) * i // n : len(bits) * (i + 1) // n]] for i in range(n)]

    def places(self, fp: np.ndarray, table: int):
        """Name of the cell (a hash of which table, choice and bits), bits that its members can differ in, and who goes there."""
        for k, chosen in enumerate(self.choices):
            where = _bits(fp, [self.segments[i] for i in chosen])
            yield from self._deeper(fp, np.arange(len(fp)), _mixed(where, table * len(self.choices) + k), self.left(k), 0)

    def _deeper(self, fp: np.ndarray, who: np.ndarray, name: np.ndarray, free: list[tuple[int, int]], depth: int):
        heavy = np.isin(name, self.heavy[depth]) if depth < len(self.heavy) else np.zeros(len(name), dtype=bool)
        if (~heavy).any():
            yield name[~heavy], free, who[~heavy]
        if heavy.any():
            who, name = who[heavy], name[heavy]
            for i, part in enumerate(self.parts(free)):
                rest = [s for other in self.parts(free)[:i] + self.parts(free)[i + 1 :] for s in other]
                yield from self._deeper(fp, who, _mixed(_bits(fp[who], part) ^ name, i + 1), rest, depth + 1)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A hash of 64 bits of each number and of the salt."""
    x = (x.astype(np.uint64) + np.uint64(salt * int(FACTORS[1]) & (1 << 64) - 1)) * FACTORS[2]
    x ^= x >> np.uint64(31)
    x *= FACTORS[3]
    return x ^ (x >> np.uint64(29))


def _tables(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """All fingerprints of signatures, table by table, and their guards."""
    size = WIDTH // 8
    every = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
    out = []
    for t in range(TABLES):
        fp = np.zeros((len(column), 8), dtype=np.uint8)
        fp[:, :size] = every[:, t * size : (t + 1) * size]
        out.append(fp.view("<u8")[:, 0])
    return out, np.ascontiguousarray(every[:, TABLES * size :]).view("<i8")[:, 0]


def planned(sets: DataFrame, count: int, group: int) -> Plan:
    """Cells for so many sets. The driver holds the names of heavy cells, each of over HEAVY * group fingerprints."""
    plan = Plan(count, group)
    for _ in range(DEEPER):
        if count <= HEAVY * group:
            break

        def name(batches, plan=plan):
            for batch in batches:
                for part in slices(batch, 4096):
                    for t, fp in enumerate(_tables(part.column(0))[0]):
                        for names, _, _ in plan.places(fp, t):
                            cell, n = np.unique(names, return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(n)], ["cell", "n"])

        counted = sets.select("signature").mapInArrow(name, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        heavy = np.array([r["cell"] for r in counted.where(F.col("n") > HEAVY * group).collect()], dtype=np.int64).view(np.uint64)
        if not len(heavy):
            break
        deeper = Plan(count, group)
        deeper.heavy = [*plan.heavy, heavy]
        plan = deeper
    return plan


def candidates(sets: DataFrame, count: int, group: int | None = None) -> DataFrame:
    """Components of two sets or more under candidate links within one cell.

    sets: set, n and signature of each non-empty set. A row per member: set, n, cell, and low and low_n, the component's
    smallest set and that one's n. A cell holds about 32 * GROUP bytes.
    """
    plan = planned(sets, count, group or GROUP)

    def send(batches):
        for batch in batches:
            for part in slices(batch, 4096):
                name, n = (part.column(i) for i in (0, 1))
                fps, guard = _tables(part.column(2))
                for t, fp in enumerate(fps):
                    for cell, free, who in plan.places(fp, t):
                        own = _bits(fp[who], free)  # all that members of the cell can differ in
                        at = pa.array(who)
                        width = pa.array(np.full(len(who), sum(s for _, s in free), dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), width, pa.array(own.view(np.int64)), pa.array(guard[who]), name.take(at), n.take(at)], ["cell", "width", "fp", "guard", "set", "n"])

    def meet(batches):
        for (cell, width), (fp, guard, name, n) in grouped(batches, 2):
            if len(fp) < 2:
                continue
            order = np.argsort(name)
            fp, guard, name, n = fp[order].view(np.uint64), guard[order].view(np.uint64), name[order], n[order]
            root = joined(fp, 0, 0, RADIUS, lambda a, b: np.bitwise_count(guard[a] ^ guard[b]) <= GUARD_BITS, width, every=True)
            (k,) = np.nonzero(np.bincount(root, minlength=len(root))[root] > 1)
            low = root[k]
            for at in range(0, len(k), 65_536):
                i, j = k[at : at + 65_536], low[at : at + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (name[i], n[i], np.full(len(i), cell), name[j], n[j])], ["set", "n", "cell", "low", "low_n"])

    sent = sets.select("set", "n", "signature").mapInArrow(send, "cell long, width long, fp long, guard long, set long, n long")
    return sent.repartition("cell").sortWithinPartitions("cell", "width").mapInArrow(meet, "set long, n long, cell long, low long, low_n long")


def contents(docs: DataFrame, sets: DataFrame, need: DataFrame) -> DataFrame:
    """set and h, the bytes of its shingles' hashes, of the sets in need's column set."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 128):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["set", "h"])

    at = materialize(sets.join(need.distinct(), "set", "left_semi").select(F.col("set").alias("name"), "row.doc_id", "row.text_key", "row.copies"), "needed")
    return materialize(rows_at(docs.select("doc_id", "text"), at).select("name", "text").mapInArrow(run, "set long, h binary"), "contents")


def verified(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of sets that are similar, by the contents held."""

    def run(batches):
        for batch in batches:
            same = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    both = small(pairs).join(held.select(F.col("set").alias("a"), F.col("h").alias("x")), "a").join(held.select(F.col("set").alias("b"), F.col("h").alias("y")), "b")
    return both.mapInArrow(run, "a long, b long")


def bucket_links(names: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the similar ones of all pairs of these sets."""
    n = np.array([len(h) for h in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)[count[column] > 1]
    column = column[count[column] > 1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cut = np.searchsorted(column, np.arange(0, len(count) + COLUMNS, COLUMNS))
    left, right = [], []
    for at in range(0, len(sets), BLOCK):
        both = np.zeros((min(BLOCK, len(sets) - at), len(sets)), dtype=np.float32)  # counts below 2^24 are exact
        for x, y in zip(cut, cut[1:]):
            if y > x:
                used, where = np.unique(column[x:y], return_inverse=True)
                has = np.zeros((len(sets), len(used)), dtype=np.float32)
                has[row[x:y], where] = 1
                both += has[at : at + BLOCK] @ has.T
        both = both.astype(np.int64)
        i, j = np.nonzero(100 * both >= SIMILAR * (n[at : at + BLOCK, None] + n[None, :] - both))
        root = _roots(len(sets), np.concatenate([i + at, *left]), np.concatenate([j, *right]))
        left, right = [np.arange(len(sets))], [root]
    (k,) = np.nonzero(root != np.arange(len(sets)))
    return names[root[k]], names[k]


def bucketed(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links of all components of candidates: members has key, set, n and h, sizes the shingles of each key's sets (key, total).

    A component's sets are dealt to parts of about TILE shingles by a hash, and each two parts are a tile, for a task of its own.
    """

    def run(batches):
        key, names, held = None, [], []

        def end():
            a, b = bucket_links(np.array(names), held)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for *k, name, h in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if names:
                        yield end()
                    key, names, held = k, [], []
                names.append(name)
                held.append(np.frombuffer(h, "<u8"))
        if names:
            yield end()

    parts = members.join(small(sizes), "key").withColumn("parts", F.ceil(F.col("total") / TILE).cast("int"))
    own = F.pmod(F.xxhash64("set"), F.col("parts")).cast("int")
    parts = parts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Of three parts or more no tile is of one part alone: each part meets itself in its tile with the next one.
    tiles = parts.where((F.col("own") != F.col("other")) | (F.col("parts") == 1)).select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "set", "h")
    return tiles.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and root of every row: rows of one root are one component."""
    rows = materialize(sketches(docs), "sketches")
    kept = distinct_rows(rows, "set", "n", "signature")
    sets = materialize(kept.groupBy("set").agg(first_row().alias("row"), F.first("n").alias("n"), F.first("signature").alias("signature")), "sets")
    met = materialize(candidates(sets.where("n > 0"), sets.count()), "candidates")

    def near(n, m):
        return F.least(n, m) * 100 >= F.greatest(n, m) * SIMILAR  # sets of other sizes can't be similar

    held = contents(docs, sets, met.select("set"))
    star = met.where((F.col("set") != F.col("low")) & near(F.col("n"), F.col("low_n"))).select(F.col("low").alias("a"), F.col("set").alias("b"))
    links = materialize(verified(held, materialize(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")), "verified")
    found = components(links)
    x, y = found.select(F.col("node").alias("a"), F.col("root").alias("x")), found.select(F.col("node").alias("b"), F.col("root").alias("y"))
    apart = star.distinct().join(x, "a", "left").join(y, "b", "left").where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")
    # Those verified already were found unlike, or they would not be apart.
    apart = apart.join(star.groupBy("b").agg(F.min("a").alias("first")), "b").where("a <> first").select("a", "b")
    links = links.unionByName(materialize(verified(held, materialize(apart, "pairs")), "verified"))
    placed = met.join(components(links), F.col("set") == F.col("node"), "left").select("set", F.xxhash64("cell", "low").alias("key"), F.coalesce("root", "set").alias("root"))
    # A component of two sets has been compared already; those with the same members are compared once.
    split = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("members"), F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("names"))
    split = split.where("x < y and members > 2").groupBy("members", "names").agg(F.min("key").alias("key")).select("key")
    placed = materialize(placed.join(split, "key", "left_semi").select("set", "key"), "split")
    sizes = materialize(placed.join(sets.select("set", "n"), "set").groupBy("key").agg(F.sum("n").alias("total")), "sizes")
    links = links.unionByName(bucketed(held.join(small(placed), "set"), sizes))
    joined_up = components(links)
    known = sets.join(joined_up, F.col("set") == F.col("node"), "left").select(F.col("set").alias("s"), F.coalesce("root", "set").alias("root"))
    return rows.join(known, F.col("set") == F.col("s")).select("doc_id", "text_key", "root")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest doc_id and then text hash, null ids last, with the columns of docs."""
    first = distinct_rows(groups(docs), "root").groupBy("root").agg(first_row().alias("row"))
    return rows_at(docs, materialize(first.select("row.doc_id", "row.text_key", "row.copies"), "first"))
