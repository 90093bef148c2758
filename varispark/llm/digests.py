"""Document fingerprints from statistically improbable features.

Every window of WINDOW bytes of a text has a Shannon entropy, taken from the one before by the
counts of the byte that leaves and the byte that enters. How often each entropy occurs over all
documents gives its rarity: rare entropies rank first, windows of little entropy last. Over each run
of SPAN windows the leftmost window of the best rank scores a point; windows of at least POINTS
points are the text's features. A feature is hashed to five bits of a Bloom filter of FILTER_BITS
bits; after FILTER_FEATURES features the next filter of the chain begins. Two filters' likeness is
their common bits above what chance gives, over the most they can have; two chains' likeness is the
mean, by bits, of each filter of the shorter chain against its best match in the other.

Null text counts as empty. A text shorter than a window is one feature, padded with zeros; an empty
text has none, and is like another empty text only. Equal texts have equal fingerprints within one
table of rarities. The rarity table has a fixed number of entries.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.llm.shared import ship, slices

WINDOW = 16
SPAN = 16
POINTS = 6
FILTER_BITS = 2048
FILTER_FEATURES = 160
#: Entropies in bits below this rank behind all others.
WEAK = 2.0
SCALE = 1024
#: Sums of count * log2(count) of one rarity entry.
STEP = 256
#: Bytes of text handled at once, about.
BYTES = 1 << 17
#: Documents of a bucket of ids, about, and most buckets.
BUCKET_ROWS, BUCKETS = 2_000, 20_000
#: Rows for each bucket in the sample that finds its bounds.
SAMPLE = 20

_SUMS = np.array([round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 2)], dtype=np.int64)
_UP = (_SUMS[1:] - _SUMS[:-1]).astype(np.int32)
ENTRIES = int(_SUMS[WINDOW]) // STEP + 1
_GAP = WINDOW + SPAN
_LEAST = -(1 << 63)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one buffer with gaps of zeros, where each begins, and how many windows it has."""
    size = np.array([max(len(t), WINDOW) if t else 0 for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size + _GAP)[:-1]]).astype(np.int64)
    buffer = bytearray(int((size + _GAP).sum()) + _GAP)
    for at, t in zip(begin.tolist(), texts):
        buffer[at : at + len(t)] = t
    return np.frombuffer(buffer, dtype=np.uint8), begin, np.where(size > 0, size - WINDOW + 1, 0)


def entropy_entries(b: np.ndarray) -> np.ndarray:
    """The rarity entry of the window at each place of a buffer."""
    n = len(b)
    before, after = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for s in range(1, WINDOW):
        same = (b[s:] == b[:-s]).view(np.uint8)
        before[s:] += same
        after[:-s] += same
    first = int(_SUMS[np.bincount(b[:WINDOW])].sum())
    move = _UP[before[WINDOW:]] - _UP[after[: n - WINDOW]]
    sums = np.empty(n, dtype=np.int32)
    sums[0] = first
    sums[1 : n - WINDOW + 1] = first + np.cumsum(move, dtype=np.int64)
    sums[n - WINDOW + 1 :] = _SUMS[WINDOW]
    return sums // STEP


def _valid(n: int, begin: np.ndarray, windows: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int8)
    has = windows > 0
    edge[begin[has]] = 1
    edge[(begin + windows)[has]] = -1
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


def histogram(texts: list[bytes]) -> np.ndarray:
    """How often each rarity entry occurs among the texts' windows."""
    b, begin, windows = laid_out(texts)
    return np.bincount(entropy_entries(b)[_valid(len(b), begin, windows)], minlength=ENTRIES)


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each rarity entry: rare ones first, those of little entropy last."""
    weak = np.arange(ENTRIES) * STEP > (math.log2(WINDOW) - WEAK) * WINDOW * SCALE
    order = np.lexsort((np.arange(ENTRIES), np.where(counts > 0, counts, np.iinfo(np.int64).max), weak))
    out = np.empty(ENTRIES, dtype=np.int64)
    out[order] = np.arange(ENTRIES)
    return out


def _mixed(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of WINDOW bytes."""
    h = np.full(len(rows), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for word in rows.view("<u8").T:
        h = (h ^ word) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def fingerprints(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The chain of filters of each text, as rows of 64-bit words."""
    b, begin, windows = laid_out(texts)
    n = len(b)
    place = np.arange(n, dtype=np.int64)
    worst = np.int64(ENTRIES) << np.int64(40)
    valid = _valid(n, begin, windows)
    key = np.where(valid, (rank[entropy_entries(b)] << np.int64(40)) | place, worst | place)
    least, width = key.copy(), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        least[: n - step] = np.minimum(least[: n - step], least[step:])
        width += step
    points = np.bincount(least[valid] & ((1 << 40) - 1), minlength=n)
    chosen = points >= POINTS
    # a text in which no window has so many points has the best one
    cum = np.concatenate([[0], np.cumsum(chosen)])
    for i in np.nonzero((windows > 0) & (cum[begin + windows] == cum[begin]))[0]:
        chosen[begin[i] + np.argmin(key[begin[i] : begin[i] + windows[i]])] = True
    (at,) = np.nonzero(chosen)
    hashes = _mixed(b[at[:, None] + np.arange(WINDOW)])
    bits = (hashes[:, None] >> (np.arange(5, dtype=np.uint64) * np.uint64(11))) & np.uint64(FILTER_BITS - 1)
    lo, hi = np.searchsorted(at, begin), np.searchsorted(at, begin + windows)
    out = []
    for a, z in zip(lo.tolist(), hi.tolist()):
        m = z - a
        chain = np.zeros((-(-m // FILTER_FEATURES), FILTER_BITS), dtype=np.uint8)
        if m:
            chain[(np.arange(m) // FILTER_FEATURES)[:, None], bits[a:z]] = 1
        out.append(np.packbits(chain, axis=1, bitorder="little").view("<u8"))
    return out


def likeness(f: np.ndarray, g: np.ndarray) -> float:
    """Normalised bit overlap of two chains, 0 to 1."""
    if not len(f) or not len(g):
        return float(len(f) == len(g))
    nf, ng = np.bitwise_count(f).sum(axis=1, dtype=np.int64), np.bitwise_count(g).sum(axis=1, dtype=np.int64)
    if (len(f), nf.sum()) > (len(g), ng.sum()):
        f, g, nf, ng = g, f, ng, nf
    total = 0.0
    for row, size in zip(f, nf.tolist()):
        common = np.bitwise_count(g & row).sum(axis=1, dtype=np.int64)
        most = np.minimum(ng, size)
        chance = ng * size / FILTER_BITS
        share = np.where(most > chance, (common - chance) / np.maximum(most - chance, 1e-9), (common == most).astype(float))
        total += size * float(np.clip(share, 0.0, 1.0).max())
    return min(1.0, total / float(nf.sum()))


def _blocks(texts: list[bytes]):
    """Ranges of texts of about BYTES bytes each."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + _GAP
        if held >= BYTES:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of entropies from the windows of all texts; a fixed number of counts comes to the driver."""
    ship(docs.sparkSession)

    def run(batches):
        total = np.zeros(ENTRIES, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                texts = [t.encode("utf-8") for t in part.column(0).to_pylist() if t]
                for a, z in _blocks(texts):
                    total += histogram(texts[a:z])
        (k,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k])], ["entry", "n"])

    counts = np.zeros(ENTRIES, dtype=np.int64)
    for r in docs.select(text_col).mapInArrow(run, "entry int, n long").groupBy("entry").agg(F.sum("n").alias("n")).collect():
        counts[r["entry"]] = r["n"]
    return ranks(counts)


def digest_docs(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row: the operator's general form, without a shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [(t or "").encode("utf-8") for t in part.column(1).to_pylist()]
                out = [c.tobytes().hex() for a, z in _blocks(texts) for c in fingerprints(texts[a:z], rank)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], [id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness and that to the next document's.

    Documents are dealt out to buckets of consecutive ids, and of their texts' hashes within an id that many
    rows share, about equal in number; the first document of each bucket goes to the bucket before as well, at
    its end, and that of the first to the last, so every document meets the next one in one shuffle of the
    texts. Only bucket bounds, a sample for them and first ids, of which there are SAMPLE * BUCKETS at most, are
    held on the driver. Equal ids stand in order of their texts' hashes; null ids come first.
    """
    ship(docs.sparkSession)
    id_, tie = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")
    count = docs.count()
    buckets = max(1, min(BUCKETS, -(-count // BUCKET_ROWS)))
    some = F.pmod(F.xxhash64("id", "tie"), F.lit(1 << 20)) < F.lit(min(1.0, SAMPLE * buckets / max(1, count)) * (1 << 20))
    sample = sorted((r["id"], r["tie"]) for r in docs.select(id_, tie).where(some).collect()) if buckets > 1 else []
    cuts = sorted({sample[k * len(sample) // buckets] for k in range(1, buckets)}) if sample else []
    ids, ties = (np.array(c, dtype=np.int64) for c in zip(*cuts)) if cuts else (np.zeros(0, dtype=np.int64),) * 2

    def bucket(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The number of cuts that are not above each pair of id and tie."""
        out, end = np.searchsorted(ids, x, side="left"), np.searchsorted(ids, x, side="right")
        for v in np.unique(x[end > out]):
            k = x == v
            lo, hi = np.searchsorted(ids, [v, v + 1])
            out[k] = lo + np.searchsorted(ties[lo:hi], t[k], side="right")
        return out.astype(np.int64)

    def bucket_of(batches):
        for batch in batches:
            x, t = (c.to_numpy() for c in batch.columns)
            k = bucket(x, t)
            order = np.lexsort((t, x, k))
            first = order[np.concatenate([[True], k[order][1:] != k[order][:-1]])[: len(k)]]
            yield pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(x[first]), pa.array(t[first])], ["bucket", "id", "tie"])

    firsts = docs.select(id_, tie).mapInArrow(bucket_of, "bucket long, id long, tie long").groupBy("bucket").agg(F.min(F.struct("id", "tie")).alias("first")).collect()
    firsts = sorted((r["bucket"], tuple(r["first"])) for r in firsts)
    follows = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    starts = np.array(sorted({x for x, _ in follows}), dtype=np.int64)

    def deal(batches):
        for batch in batches:
            x, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            table = pa.table([pa.array(bucket(x, t)), pa.array(np.zeros(len(x), dtype=np.int32)), *batch.columns], names=["bucket", "tail", "id", "tie", "text"])
            k = [i for i in np.nonzero(np.isin(x, starts))[0].tolist() if (int(x[i]), int(t[i])) in follows]
            if k:
                again = table.take(pa.array(k))
                again = again.set_column(0, "bucket", pa.array([follows[int(x[i]), int(t[i])] for i in k], pa.int64())).set_column(1, "tail", pa.array(np.ones(len(k), dtype=np.int32)))
                table = pa.concat_tables([table, again])
            yield from table.combine_chunks().to_batches()

    rows = docs.select(id_, tie, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(deal, "bucket long, tail int, id long, tie long, text string")
    rows = rows.repartition(max(1, len(firsts)), "bucket").sortWithinPartitions("bucket", "tail", "id", "tie").drop("tie")

    def work(batches):
        held: list[tuple[int, int, int, str]] = []

        def done(last: bool):
            """Results of the documents held whose next one is known; the last row stays unless it is a bucket's tail."""
            todo = [i for i in range(len(held) - 1) if not held[i][1]]
            if todo:
                texts = [h[3].encode("utf-8") for h in held]
                after = [edited(held[i][3], held[i + 1][3]).encode("utf-8") for i in todo]
                every = texts + after
                prints = [c for a, z in _blocks(every) for c in fingerprints(every[a:z], rank)]
                own, new = prints[: len(held)], prints[len(held) :]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if held[i][2] == _LEAST else held[i][2] for i in todo], pa.int64()),
                        pa.array([len(held[i][3]) for i in todo], pa.int64()),
                        pa.array([hashlib.sha256(a).hexdigest() for a in after], pa.string()),
                        pa.array([own[i].tobytes().hex() for i in todo], pa.string()),
                        pa.array([c.tobytes().hex() for c in new], pa.string()),
                        pa.array([likeness(own[i], c) for i, c in zip(todo, new)], pa.float64()),
                        pa.array([likeness(own[i], own[i + 1]) for i in todo], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
            del held[: len(held) if last else -1]

        size = 0
        for batch in batches:
            for part in slices(batch):
                for row in zip(*[c.to_pylist() for c in part.columns]):
                    if held and row[1] and held[-1][1]:
                        continue  # only the first of equal ids follows
                    held.append(row)
                    size += len(row[3])
                    if size >= 4 * BYTES:
                        yield from done(last=False)
                        size = 0
        yield from done(last=True)

    return rows.mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
