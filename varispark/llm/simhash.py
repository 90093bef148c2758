"""Near-duplicate groups by SimHash, with meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a variant within r bits of both. So every
distinct fingerprint emits its variants with up to r flipped bits, and fingerprints that emit the
same variant are linked: all of them lie within 2r bits of each other, and a chain of links from
one of them to the rest says as much as all pairs.

The shuffle on variants is by their leading bits: a fingerprint is sent once to each leading part
that one of its variants has (its own, and those with up to r of these bits flipped), and the
variants' other bits are flipped where they arrive. The number of leading bits follows the number
of fingerprints, so that a group holds about GROUP of their variants' sources, and a leading part that
far more fingerprints have is told apart by further bits; within a group the variants are sorted as
plain arrays, block by block. Each group gives back links that join what it
joined, at most one for each fingerprint that reached it, each verified by its bits.

Links are joined to components by rounds of taking the smallest neighbour, as tables in the shared
folder; each round's work is in proportion to the links.

Null text and texts without a word have fingerprint zero and are linked like any other. Copies have
one fingerprint and are joined by it, so groups of copies emit one ball. component_id is the
smallest doc_id reachable; null ids are not counted, and a component of null ids alone has null.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.llm.shared import distinct_rows, first_row, grouped, materialize, rows_at, ship, slices

BITS = 64
SEED = 42
WORDS = 4
DISTANCE = 4
#: Fingerprints of one group, about, by their own leading bits.
GROUP = 2_000
#: A leading part with more than HEAVY groups' fingerprints is told apart by DEEPER more bits.
HEAVY, DEEPER = 4, 4
#: Shingles whose bits are counted at once.
STEP = 16_384
#: Rows of variants that are sorted at once, about.
SORTED = 1_000_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of one text: a bit is 1 if more than half of the shingles' hashes have it."""
    import xxhash

    parts = (text or "").encode("utf-8").lower().split()  # on bytes: ASCII letters and white space only
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(b" ".join(parts), SEED)
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    end = np.cumsum(size)
    begin, end = (end - size)[: len(parts) - words + 1].tolist(), (end - 1)[words - 1 :].tolist()
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(begin), STEP):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(begin[at : at + STEP], end[at : at + STEP])], dtype=np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(begin), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, keyed: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; text_key, a hash of the text, where it is asked for."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fp = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], dtype=np.uint64)
                keys = [part.column(2)] if keyed else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64)), *keys], ["doc_id", "fp", "text_key"][: 2 + keyed])

    rows = docs.select(F.col("doc_id").cast("long"), "text", *[F.xxhash64("text")] * keyed)
    return rows.mapInArrow(run, "doc_id long, fp long" + ", text_key long" * keyed)


@functools.cache
def flips(bits: int, most: int, shift: int = 0) -> np.ndarray:
    """Masks of up to so many flipped bits, by their number and then in order."""
    out = [0]
    for k in range(1, most + 1):
        out += [sum(1 << (b + shift) for b in c) for c in itertools.combinations(range(bits), k)]
    return np.array(out, dtype=np.uint64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n nodes' components under the links a-b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = a[x != y], b[x != y]


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The components of root with the links a-b added; root has the smallest member of each node's component."""
    a, b = root[a], root[b]
    a, b = a[a != b], b[a != b]
    if not len(a):
        return root
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = root.copy()
    root[nodes] = nodes[_roots(len(nodes), place[: len(a)], place[len(a) :])]
    return root[root]


def _runs(key: np.ndarray, owner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners of the keys, of so many bits, that two or more of them have, key by key; and how many have each."""
    places = int(owner.max()).bit_length()
    if bits + places <= 64:
        shift = np.uint64(places)
        both = np.sort((key << shift) | owner.astype(np.uint64))
        key, owner = both >> shift, (both & np.uint64((1 << places) - 1)).astype(np.int64)
    else:
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
    start = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
    length = np.diff(np.append(start, len(key)))
    del key  # runs are few bytes a variant, as they are held for longer
    return owner.astype(np.int32)[np.repeat(length > 1, length)], length[length > 1]


def joined(fps: np.ndarray, lead: int, bits: int, radius: int, near, width: int = BITS, every: bool = False) -> np.ndarray:
    """Smallest index of each fingerprint's component, where those with a common variant are linked if near(i, j).

    If near holds for all that have a common variant, neighbours in order link them all. Else every is to be asked for: all
    pairs with a common variant, but for those that are one component already.

    The variants are those whose first so many bits are lead. They are made and sorted by parts of their values, a
    part at a time.
    """
    low = width - bits
    used = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(lead)) if bits else np.zeros(len(fps), dtype=np.uint8)
    rest = fps & np.uint64((1 << low) - 1)
    masks = [flips(low, radius - u) for u in range(radius + 1)]
    total = sum(int((used == u).sum()) * len(masks[u]) for u in range(radius + 1))
    split = min(low, max(0, (total // SORTED).bit_length()))
    shift = np.uint64(low - split)
    kinds = []  # fingerprints in order, where each part of their values begins, and masks by their leading part
    for u, mask in enumerate(masks):
        (who,) = np.nonzero(used == u)
        if len(who):
            who = who[np.argsort(rest[who])]
            begin = np.searchsorted(rest[who] >> shift, np.arange((1 << split) + 1).astype(np.uint64)) if split else np.array([0, len(who)])
            top = mask >> shift if split else np.zeros(len(mask), dtype=np.uint64)
            kinds.append((who, begin, [(int(t), mask[top == t]) for t in np.unique(top)]))
    root = np.arange(len(fps))
    for part in range(1 << split):
        keys, owners = [], []
        for who, begin, by_top in kinds:
            for t, mask in by_top:
                mine = who[begin[part ^ t] : begin[(part ^ t) + 1]]
                if len(mine):
                    keys.append((rest[mine][:, None] ^ mask[None, :]).ravel())
                    owners.append(np.repeat(mine, len(mask)))
        if not keys:
            continue
        key = np.concatenate(keys)
        if split:
            key &= np.uint64((1 << (low - split)) - 1)  # all keys of a part agree in the rest
        owner, length = _runs(key, np.concatenate(owners), low - split)
        del keys, owners, key
        step = 1
        while len(length):
            end = np.cumsum(length)
            start, inside = end - length, np.ones(len(owner), dtype=bool)
            for k in range(1, step + 1):
                inside[end - k] = False
            a, b = owner[inside], owner[step:][inside[:-step]]
            apart = root[a] != root[b]
            a, b = a[apart].astype(np.int64), b[apart].astype(np.int64)
            if len(a):
                pair = np.unique(np.minimum(a, b) * len(fps) + np.maximum(a, b))
                a, b = pair // len(fps), pair % len(fps)
                linked = near(a, b)
                root = merge(root, a[linked], b[linked])
            if not every:
                break
            step += 1  # what is one component already, as groups of copies are, needs no further pairs
            own = root[owner]
            more = (np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)) & (length > step)
            owner, length = owner[np.repeat(more, length)], length[more]
    return root


def group_links(lead: int, fps: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints with a common variant whose leading bits are lead.

    fps: the distinct fingerprints sent here; bits: the number of leading bits.
    """
    root = joined(fps, lead, bits, radius, lambda a, b: np.bitwise_count(fps[a] ^ fps[b]) <= 2 * radius)
    (k,) = np.nonzero(root != np.arange(len(fps)))
    return fps[root[k]], fps[k]


def heavy_leads(distinct: DataFrame, count: int, group: int) -> tuple[int, list[np.ndarray]]:
    """Number of leading bits, and for each further step of DEEPER bits the leads that are still too heavy.

    A lead is heavy if more than HEAVY * group fingerprints begin with it; it is then taken DEEPER bits longer. The
    driver holds heavy leads only, at most count / (HEAVY * group) for each step.
    """
    bits = max(0, (max(1, count) // group).bit_length())
    found: list[np.ndarray] = []
    at = bits
    while at <= BITS - DEEPER and count > HEAVY * group:
        lead = F.shiftrightunsigned("fp", BITS - at) if at else F.lit(0).cast("long")
        rows = distinct.select(lead.alias("lead")).groupBy("lead").count().where(F.col("count") > HEAVY * group).collect()
        if not rows:
            break
        found.append(np.array(sorted(r["lead"] for r in rows), dtype=np.uint64))
        at += DEEPER
    return bits, found


def leads(fp: np.ndarray, bits: int, heavy: list[np.ndarray], radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Number of leading bits, lead, and the fingerprint's place, for each part of the variants that has one of its variants."""
    start = flips(bits, radius)
    top = (fp >> np.uint64(BITS - bits)) if bits else np.zeros(len(fp), dtype=np.uint64)
    who, lead = np.repeat(np.arange(len(fp)), len(start)), (top[:, None] ^ start[None, :]).ravel()
    used = np.tile(np.bitwise_count(start), len(fp))
    out = []
    for step, names in enumerate([*heavy, np.zeros(0, dtype=np.uint64)]):
        deeper = np.isin(lead, names)
        out.append((bits + step * DEEPER, lead[~deeper], who[~deeper]))
        if not deeper.any():
            break
        who, lead, used = who[deeper], lead[deeper], used[deeper]
        more = flips(DEEPER, radius)
        low = np.uint64(BITS - bits - (step + 1) * DEEPER)
        following = (fp[who] >> low) & np.uint64((1 << DEEPER) - 1)
        total = used[:, None] + np.bitwise_count(more)[None, :]
        fits = (total <= radius).ravel()
        lead = ((lead << np.uint64(DEEPER))[:, None] | (following[:, None] ^ more[None, :])).ravel()[fits]
        who, used = np.repeat(who, len(more))[fits], total.ravel()[fits]
    return out


def links(distinct: DataFrame, count: int, radius: int = DISTANCE // 2, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all within 2 * radius bits."""
    ship(distinct.sparkSession)
    bits, heavy = heavy_leads(distinct, count, group)

    def send(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for size, lead, who in leads(fp, bits, heavy, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), size, dtype=np.int32)), pa.array(lead.view(np.int64)), pa.array(fp[who].view(np.int64))], ["bits", "lead", "fp"])

    def meet(batches):
        for (size, lead), (fp,) in grouped(batches, 2):
            a, b = group_links(lead & (1 << 64) - 1, fp.view(np.uint64), size, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    sent = distinct.select("fp").mapInArrow(send, "bits int, lead long, fp long")
    met = sent.repartition("bits", "lead").sortWithinPartitions("bits", "lead").mapInArrow(meet, "a long, b long")
    return met.distinct()


def components(edges: DataFrame) -> DataFrame:
    """Component of every node of the links (a, b): node, root (the smallest node).

    Each round joins every node to the smallest of its neighbours' neighbourhoods, larger and then
    smaller ones, until each link leads from a node to its root.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # large star: the larger neighbours of a node go to the smallest of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: the smaller neighbours of a node, and it, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(low, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        new = materialize(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        # done when every node has one link and no node is both ends
        state = new.agg(F.count("*").alias("n"), F.count_distinct("a").alias("d")).first()
        inner = new.join(new.select(F.col("b").alias("r")).distinct(), F.col("a") == F.col("r"), "left_semi").limit(1).count() if state["n"] == state["d"] else 1
        edges = new
        if not inner:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def rooted(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """f, root and component_id of every fingerprint of the rows (doc_id, fp)."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(links(distinct, distinct.count(), distance // 2))
    known = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.select(F.col("fp").alias("f"), "root").join(least, "root").select("f", "root", "component_id")


def groups(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows = materialize(fingerprints(docs, words), "fingerprints")
    known = rooted(rows, distance).select("f", "component_id")
    return rows.join(known, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, that of the smallest doc_id and then text hash, null ids last, with the columns of docs."""
    rows = materialize(fingerprints(docs, words, keyed=True), "fingerprints")
    first = distinct_rows(rows, "fp").join(rooted(rows, distance), F.col("fp") == F.col("f")).groupBy("root").agg(first_row().alias("row"))
    return rows_at(docs, materialize(first.select("row.doc_id", "row.text_key", "row.copies"), "first"))
