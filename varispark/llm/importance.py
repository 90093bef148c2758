"""Importance resampling towards a target distribution, over hashed features, by an external sort-count.

Each text's features (runs of one to ``runs`` words, repeats included) are hashed to buckets. Chunks of documents are
written to the shared folder as packed streams of 16-bit buckets with the documents' offsets in them. To count, a task
reads its streams a bounded part at a time, sorts the part and run-length encodes it: at most one number for each
bucket and part leaves the task, and Spark sums them. A bucket's gain, from the counts of the source and of
the target, is one of at most 65,536 numbers; later the streams are read again, gains are gathered by bucket and added
up document by document with np.add.reduceat. A text is hashed once.

Words are of bytes: letters and digits of ASCII, A-Z lower-cased, and every character outside it.

The draw is a top-k by weight plus Gumbel noise from a hash of the id: rows are sorted over ranges by score, and a row's
rank is its place in its range after the ranges before it. No task holds more than a range.

Null text has no words; a null id is hashed as an empty one and comes after the others of its score. Repeated rows are
ranked one after the other. A document without features weighs 0. An empty target (or source) gives smoothed counts
of zero; empty documents give an empty result.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varispark.llm.shared import materialize, ship, unused

RUNS, BUCKETS = 2, 10_000
SHARE, MIN_WORDS, SEED = 25, 20, 7
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Features of a chunk, and of a sorted part, about; a longer document is a chunk of its own.
CHUNK = 1 << 20
PART = 1 << 22


def hashed(text: str | None, runs: int = RUNS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words and the buckets of all features of a text."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return 0, np.zeros(0, dtype=np.uint16)
    # A longer run's checksum goes on from that of the run one word shorter: no strings are joined.
    sums, parts = list(map(zlib.crc32, words)), []
    for k in range(runs):
        if k:
            sums = list(map(zlib.crc32, words[k:], map(zlib.crc32, itertools.repeat(b" "), sums)))
        parts.append((np.array(sums, dtype=np.uint32) % np.uint32(buckets)).astype(np.uint16))
    return len(words), np.concatenate(parts)


def streams(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """Chunks of documents, written: their ids, numbers of words, offsets (one more than documents), and the packed stream."""
    if buckets > 1 << 16:
        raise ValueError("buckets have 16 bits")
    ship(docs.sparkSession)
    names = ["ids", "words", "offsets", "stream"]

    def pack(batches):
        ids, words, parts, offsets = [], [], [], [0]

        def chunk():
            stream = np.concatenate(parts).astype("<u2").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())), pa.array([stream], pa.binary())], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, own = hashed(text.as_py(), runs, buckets)
                ids.append(doc_id)
                words.append(n)
                parts.append(own)
                offsets.append(offsets[-1] + len(own))
                if offsets[-1] >= CHUNK or len(ids) >= 1 << 16:
                    yield chunk()
                    ids, words, parts, offsets = [], [], [], [0]
        if ids:
            yield chunk()

    found = F.col(id_col) if id_col else F.lit(None)
    rows = docs.select(found.cast("long").alias("id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(pack, "ids array<long>, words array<long>, offsets array<long>, stream binary"), "streams")


def counts(chunks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has: streams sorted and run-length encoded, the runs summed."""

    def encode(batches):
        held, size = [], 0

        def runs():
            x = np.sort(np.concatenate(held), kind="stable")  # radix sort of 16-bit numbers
            at = np.concatenate([[0], np.nonzero(x[1:] != x[:-1])[0] + 1])
            return pa.RecordBatch.from_arrays([pa.array(x[at].astype(np.int32)), pa.array(np.diff(np.append(at, len(x))))], ["bucket", "k"])

        for batch in batches:
            for stream in batch.column(0):
                whole = np.frombuffer(stream.as_buffer(), dtype="<u2")
                for at in range(0, len(whole), PART):
                    part = whole[at : at + PART]
                    held.append(part.copy())
                    size += len(part)
                    if size >= PART:
                        yield runs()
                        held, size = [], 0
        if size:
            yield runs()

    out = np.zeros(buckets, dtype=np.int64)
    got = chunks.select("stream").mapInArrow(encode, "bucket int, k long").groupBy("bucket").agg(F.sum("k").alias("k")).toArrow()
    out[got.column("bucket").to_numpy()] = got.column("k").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the smoothed target share over the smoothed source share) of each bucket."""
    s, t, size = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + size) / ((s + 1.0) * (t.sum() + size)))).astype(np.int64)


def weights(chunks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean of the gains of a document's features."""

    def gather(batches):
        for batch in batches:
            for ids, words, offsets, stream in zip(*[batch.column(c) for c in range(4)]):
                offsets = offsets.values.to_numpy()
                n = np.diff(offsets)
                total = np.zeros(len(n), dtype=np.int64)
                some = n > 0
                if some.any():  # reduceat wants no empty stretch
                    total[some] = np.add.reduceat(gain[np.frombuffer(stream.as_buffer(), dtype="<u2")], offsets[:-1][some])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return chunks.select("ids", "words", "offsets", "stream").mapInArrow(gather, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id, seed: int = SEED):
    """Gumbel noise in thousandths, floored, from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def drawn(scored: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds rank to the share (in hundredths) of the documents of min_words or more that score highest; null for all others."""
    p = unused("__draw", scored)
    fit = F.col("n_words") >= min_words
    order = [F.col(f"{p}_out"), F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = scored.withColumn(f"{p}_out", ~fit).repartitionByRange(*order).sortWithinPartitions(*order)
    # The number that Spark gives each row holds its range above bit 33 and its place below.
    placed = materialize(placed.withColumn(f"{p}_at", F.monotonically_increasing_id()), "drawn")
    ranges = placed.groupBy(F.shiftright(f"{p}_at", 33).alias(f"{p}_range")).agg(F.count("*").alias("n"), F.sum(F.when(~F.col(f"{p}_out"), 1).otherwise(0)).alias("fit"))
    before, total, rows = {}, 0, 0
    for r in sorted(ranges.collect()):  # a row for each range
        before[r[0]] = rows
        rows, total = rows + r["n"], total + r["fit"]
    base = scored.sparkSession.createDataFrame(list(before.items()), f"{p}_range long, {p}_base long")
    place = F.col(f"{p}_base") + F.col(f"{p}_at").bitwiseAND((1 << 33) - 1) + 1
    found = placed.withColumn(f"{p}_range", F.shiftright(f"{p}_at", 33)).join(F.broadcast(base), f"{p}_range")
    return found.select(*[F.col(f"`{c}`") for c in scored.columns], F.when(place <= share * total // 100, place).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document."""
    source, wanted = streams(docs), streams(target, id_col=None)
    gain = gains(counts(source), counts(wanted))
    scored = weights(source, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(scored, share, min_words)


def digest(found: DataFrame) -> DataFrame:
    """What op12 returns."""
    return found.select("doc_id", "n_features", "weight", "score", "rank")
