"""Token ids in files of shuffled bit planes.

A file holds the ids of consecutive documents. The ids are cut into chunks of a fixed number; each
chunk is transposed into planes (plane k has bit k, or byte k, of every id), planes above the
highest set bit are left out, and each plane is compressed with zstandard. A chunk index says
where each chunk's planes lie, so any range of ids is read by decoding the chunks it touches. A
document index holds ids and lengths, stored as planes too.

Layout, all numbers little-endian:
    magic "VSBP" | version u16 | plane bits u16 (1 or 8) | chunk ids u32 | n_docs u64 | n_ids u64
    planes of the chunks, then of doc_id (64-bit), then of the documents' lengths
    index: for each chunk u64 offset, u32 ids, u16 planes, and u32 size of each plane
    u64 offset of the index | crc32 u32 of the index | magic

Documents are written in ascending order of doc_id, null ids first, equal ids in order of their
texts' hashes. Null text counts as empty and has the end id alone. An empty table makes no file.
A task writes to a name of its own and then renames the file, so a lost or doubled task leaves no
half-written file in the list of files that is read back.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varispark.llm.shared import materialize, scratch, ship, slices
from varispark.llm.tokens import encoder

MAGIC, VERSION = b"VSBP", 1
CHUNK_IDS = 1 << 16
LEVEL = 3
#: A task closes a file and opens the next after so many ids.
FILE_IDS = 1 << 24
_HEAD = struct.Struct("<4sHHIQQ")
_TAIL = struct.Struct("<QI4s")
#: Null ids are written as the smallest number, which so is no id.
_NULL = -(1 << 63)


def planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of an array of unsigned integers, lowest first, up to the highest that is not empty."""
    raw = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), -1)
    wide = raw.T  # bytes, lowest first
    used = int(ids.max()).bit_length() if len(ids) else 0
    if bits == 8:
        return [np.ascontiguousarray(wide[k]).tobytes() for k in range(-(-used // 8))]
    return [np.packbits((wide[k // 8] >> (k % 8)) & 1, bitorder="little").tobytes() for k in range(used)]


def unplanes(parts: list[bytes], n: int, bits: int, dtype) -> np.ndarray:
    out = np.zeros((np.dtype(dtype).itemsize, n), dtype=np.uint8)
    for k, p in enumerate(parts):
        if bits == 8:
            out[k] = np.frombuffer(p, dtype=np.uint8)
        else:
            out[k // 8] |= np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") << (k % 8)
    return np.ascontiguousarray(out.T).view(dtype).ravel()


class Writer:
    """Writes one file; ids come as little-endian 32-bit bytes of whole documents."""

    def __init__(self, sink, bits: int = 1, chunk_ids: int = CHUNK_IDS, level: int = LEVEL):
        import zstandard

        self.sink, self.bits, self.chunk_ids = sink, bits, chunk_ids
        self.press = zstandard.ZstdCompressor(level=level)
        self.at = _HEAD.size
        self.body, self.index, self.buffer, self.held = [], [], [], 0
        self.docs, self.lengths, self.n = [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(_NULL if doc_id is None else doc_id)
        self.lengths.append(len(ids) // 4)
        self.buffer.append(ids)
        self.held += len(ids) // 4
        self.n += len(ids) // 4
        if self.held >= 4 * self.chunk_ids:
            self._flush(whole=False)

    def _put(self, ids: np.ndarray) -> None:
        sizes = []
        at = self.at
        for p in planes(ids, self.bits):
            z = self.press.compress(p)
            self.body.append(z)
            sizes.append(len(z))
            self.at += len(z)
        self.index.append(struct.pack(f"<QIH{len(sizes)}I", at, len(ids), len(sizes), *sizes))

    def _flush(self, whole: bool) -> None:
        ids = np.frombuffer(b"".join(self.buffer), dtype="<u4")
        end = len(ids) if whole else len(ids) // self.chunk_ids * self.chunk_ids
        for at in range(0, end, self.chunk_ids):
            self._put(ids[at : min(end, at + self.chunk_ids)])
        self.buffer, self.held = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> None:
        self._flush(whole=True)
        self._put(np.array(self.docs, dtype="<i8").view("<u8"))
        self._put(np.array(self.lengths, dtype="<u8"))
        index = b"".join(self.index)
        self.sink.write(_HEAD.pack(MAGIC, VERSION, self.bits, self.chunk_ids, len(self.docs), self.n))
        for z in self.body:
            self.sink.write(z)
        self.sink.write(index)
        self.sink.write(_TAIL.pack(self.at, zlib.crc32(index), MAGIC))


class Reader:
    """Reads a file by its chunk index; source is a seekable binary file."""

    def __init__(self, source):
        import zstandard

        self.source, self.open = source, zstandard.ZstdDecompressor()
        magic, version, self.bits, self.chunk_ids, self.n_docs, self.n_ids = _HEAD.unpack(source.read(_HEAD.size))
        size = source.seek(0, 2)
        source.seek(size - _TAIL.size)
        at, crc, end = _TAIL.unpack(source.read(_TAIL.size))
        source.seek(at)
        index = source.read(size - _TAIL.size - at)
        if (magic, version, end, crc) != (MAGIC, VERSION, MAGIC, zlib.crc32(index)):
            raise ValueError("not a whole file of bit planes")
        self.chunks, k = [], 0
        while k < len(index):
            offset, n, count = struct.unpack_from("<QIH", index, k)
            self.chunks.append((offset, n, struct.unpack_from(f"<{count}I", index, k + 14)))
            k += 14 + 4 * count
        self.lengths = self._chunk(len(self.chunks) - 1, "<u8").astype(np.int64)
        self.docs = self._chunk(len(self.chunks) - 2, "<u8").view("<i8")
        self.kept: dict[int, np.ndarray] = {}

    def _chunk(self, k: int, dtype: str = "<u4") -> np.ndarray:
        offset, n, sizes = self.chunks[k]
        self.source.seek(offset)
        return unplanes([self.open.decompress(self.source.read(s)) for s in sizes], n, self.bits, dtype)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop, counted over the file."""
        first, last = start // self.chunk_ids, max(start, stop - 1) // self.chunk_ids
        self.kept = {k: v for k, v in self.kept.items() if first <= k <= last}
        for k in range(first, last + 1):
            if k not in self.kept and stop > start:
                self.kept[k] = self._chunk(k)
        found = [self.kept[k] for k in range(first, last + 1) if k in self.kept]
        return np.concatenate(found or [np.empty(0, "<u4")])[start - first * self.chunk_ids :][: stop - start]

    def documents(self):
        """doc_id and ids of each document, in the file's order."""
        at = 0
        for d, n in zip(self.docs.tolist(), self.lengths.tolist()):
            yield (None if d == _NULL else d), self.ids(at, at + n)
            at += n


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, path: str, folder: str, end_id: int | None = None, bits: int = 1, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Encodes all documents into files in ascending doc_id order; the list of files, with the ids before each.

    The rows are dealt out over ranges of doc_id and then of their texts' hashes, so that a doc_id that many
    rows share goes to many tasks. The list has a row for each file.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches):
        from pyspark import TaskContext

        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        own = encoder(path)
        part, number, writer, sink, done = TaskContext.get().partitionId(), 0, None, None, []

        def close():
            nonlocal number
            writer.close()
            sink.close()
            store.move(f"{root}/{temporary}", f"{root}/{name}")
            done.append((part, number, name, writer.n, len(writer.docs)))
            number += 1

        for batch in batches:
            for rows in slices(batch):
                for doc_id, ids in zip(rows.column(0).to_pylist(), own.ids(rows.column(1).to_pylist())):
                    if writer is None:
                        name = f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.vsbp"  # of this attempt; the list has one attempt's files
                        temporary = f"{name}.writing"
                        sink = store.open_output_stream(f"{root}/{temporary}")
                        writer = Writer(sink, bits, chunk_ids)
                    writer.add(doc_id, ids + end)
                    if writer.n >= FILE_IDS:
                        close()
                        writer = None
        if writer is not None:
            close()
        if done:
            names = ["part", "number", "name", "n_ids", "n_docs"]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=names)

    found = ordered.select("doc_id", "text").mapInArrow(run, "part long, number long, name string, n_ids long, n_docs long")
    files = materialize(found, "plane-files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(files: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32; each file is read by one task."""
    ship(files.sparkSession)

    def run(batches):
        store, root = _open(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{name}") as source:
                    own = Reader(source)
                    n = own.lengths
                    crc = [zlib.crc32(ids.tobytes()) for _, ids in own.documents()]
                    docs = pa.array(own.docs, mask=own.docs == _NULL)
                    yield pa.RecordBatch.from_arrays([docs, pa.array(base + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.select("name", "base").repartition(max(1, files.count()))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int | None, bits: int = 1) -> DataFrame:
    """Encodes, writes and reads back all documents."""
    folder = scratch(docs.sparkSession, "planes")
    return read(write(docs, path, folder, end_id, bits), folder)
