"""WARC records in a content-addressed archive.

Two tables: ``payloads`` holds each payload's bytes once, under their SHA-256, and ``records`` holds the exact header
bytes of each record and the digest. The original records are joins of the two. A payload is stored once only if its
digest's rows also agree in length and in a second hash (else the job stops), and reading takes the digest anew.

Of the records with equal payloads of at least ``least`` bytes the one with the smallest id is the response and the
others are revisits that name it; smaller payloads are responses all, though stored once. Ties of ids go to the smaller
URL, then to one of the rows. A null id comes after all others and, as a response, leaves what refers to it null.

A digest that many rows share is never one task's: digests of more than 1/100,000 of the rows (and 1,000) are at
most 100,000 and joined by broadcast, and where payloads are joined to records, one that many records share is dealt
out in parts. Null payloads are empty; control characters and blanks in URLs are escaped; a null URL leaves
its field out. An empty table gives an empty archive.
"""

from __future__ import annotations

import gzip
import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varispark.llm.shared import BROADCAST_BYTES, scratch, ship

#: Payloads below are never referred to.
LEAST = 100
#: Records of a part, about, when a payload that many share is dealt out.
PART = 256
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_GROUP = "struct<none:boolean,id:bigint,nourl:boolean,url:string,record:bigint>"


@dataclass
class Archive:
    #: digest (32 bytes), size, spread (the parts over which its records are dealt), payload.
    payloads: DataFrame
    #: id, digest, size, spread, part, kind, refers_to, head (exact bytes of both headers).
    records: DataFrame


def _first() -> Column:
    """Orders the rows of a digest."""
    return F.struct(F.col("id").isNull().alias("none"), "id", F.col("url").isNull().alias("nourl"), "url", "record")


def _matched(rows: DataFrame, groups: DataFrame, total: int, how: str = "left") -> DataFrame:
    """rows with the groups of their digests, a written table of digest and copies; no digest that many rows share is shuffled."""
    limit = max(1000, total // 100_000)
    hot, rest = F.broadcast(groups.where(F.col("copies") > limit)), groups.where(F.col("copies") <= limit)
    if groups.count() * 100 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), "digest", how)
    cold = rows.join(hot.select("digest"), "digest", "left_anti").join(rest, "digest", how)
    return rows.join(hot, "digest").unionByName(cold)


def _uuid(first: Column, digest: Column) -> Column:
    """A record's name, from all that tells it from others."""
    parts = [F.coalesce(first[c].cast("string"), F.lit("")) for c in ("none", "id", "nourl", "url", "record")]
    h = F.sha2(F.concat_ws("\n", *parts, F.hex(digest)), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines of the fields that aren't null."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in fields])


def _escaped(url: Column) -> Column:
    """The URL without characters that would end a header field."""
    out = url
    for c in (*range(33), 127):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), out).otherwise(url)


def _heads(rows: DataFrame, date: str) -> Column:
    """Exact bytes of the WARC header and of the HTTP header, with the blank lines that end them."""
    digest, revisit = F.col("digest"), F.col("kind") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("size"))), F.lit("\r\n"))
    only = lambda c: F.when(revisit, c)
    fields = _lines(
        ("WARC-Type", F.col("kind")),
        ("WARC-Record-ID", _uuid(F.col("own"), digest)),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", _escaped(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex(digest)))),
        ("WARC-Profile", only(F.lit(PROFILE))),
        ("WARC-Refers-To", only(_uuid(F.col("first"), digest))),
        ("WARC-Refers-To-Target-URI", only(_escaped(F.col("first")["url"]))),
        ("Page-Id", F.col("id")),
        ("Refers-To-Page-Id", only(F.col("first")["id"])),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))),
    )
    return F.encode(F.concat(F.lit("WARC/1.1\r\n"), fields, F.lit("\r\n"), http), "UTF-8")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = DATE) -> Archive:
    """Writes the archive's two tables under the path and opens it. Payloads may be strings or bytes."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    # Numbers of rows, once they are written, stay the same.
    narrow = rows.select("id", "url", "digest", F.octet_length("payload").cast("long").alias("size"), F.xxhash64("payload").alias("check"), F.monotonically_increasing_id().alias("record"))
    narrow = kept(narrow, "rows")
    total = narrow.count()
    by = narrow.groupBy("digest").agg(F.count("*").alias("copies"), F.min(_first()).alias("first"), F.min(F.struct("size", "check")).alias("a"), F.max(F.struct("size", "check")).alias("b"))
    same = F.when(F.col("a") == F.col("b"), F.col("copies")).otherwise(F.raise_error(F.lit("different payloads have one digest")).cast("long"))
    groups = kept(by.where(F.col("copies") > 1).select("digest", same.alias("copies"), F.col("first").cast(_GROUP).alias("first")), "groups")

    spread = F.coalesce(F.floor(F.col("copies") / PART), F.lit(0)).cast("int") + 1
    found = _matched(rows, groups, total)
    single, chosen = F.col("copies").isNull(), F.col("id").eqNullSafe(F.col("first")["id"]) & F.col("url").eqNullSafe(F.col("first")["url"])
    size = F.octet_length("payload").cast("long").alias("size")
    lone = found.where(single).select("digest", size, F.lit(1).alias("spread"), "payload")
    # Equal rows are joined here; partial sums leave one for each task.
    shared = found.where(~single & chosen).groupBy("digest").agg(F.first("payload").alias("payload"), F.first(spread).alias("spread"))
    kept(lone.unionByName(shared.select("digest", size, "spread", "payload")), "payloads")

    own = _matched(narrow.withColumn("own", _first().cast(_GROUP)), groups, total).withColumn("first", F.coalesce("first", "own"))
    revisit = (F.col("size") >= least) & (F.col("first")["record"] != F.col("record"))
    own = own.withColumn("kind", F.when(revisit, "revisit").otherwise("response")).withColumn("spread", spread)
    part = F.pmod(F.xxhash64("record"), F.col("spread")).cast("int")
    kept(own.select("id", "digest", "size", "spread", part.alias("part"), "kind", F.when(revisit, F.col("first")["id"]).alias("refers_to"), _heads(own, date).alias("head")), "records")
    return open_archive(spark, path)


def open_archive(spark: SparkSession, path: str) -> Archive:
    return Archive(
        spark.read.schema("digest binary, size long, spread int, payload binary").parquet(f"{path}/payloads"),
        spark.read.schema("id long, digest binary, size long, spread int, part int, kind string, refers_to long, head binary").parquet(f"{path}/records"),
    )


def originals(archive: Archive) -> DataFrame:
    """Each record with its bytes as written in a WARC file (record) and its full payload, a revisit's too.

    A payload that many records share goes to each of its parts.
    """
    dealt = archive.payloads.select("digest", "payload", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("part"))
    both = archive.records.join(dealt, ["digest", "part"])
    body = F.when(F.col("kind") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return both.select("id", "digest", F.concat("head", body, F.lit(b"\r\n\r\n")).alias("record"), F.when(F.col("kind") == "revisit", F.col("payload")).alias("payload"))


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields, names in lower case, and the payload that a record holds; an HTTP length is http-length."""
    head, sep, rest = bytes(record).partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not sep or not version.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    fields = _fields(lines)
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's length is not what its header says")
    http, _, body = block.partition(b"\r\n\r\n")
    for name, value in _fields(http.partition(b"\r\n")[2]).items():
        fields[f"http-{name.removeprefix('content-')}"] = value
    return fields, body


def _fields(lines: bytes) -> dict[str, str]:
    return {name.lower(): value for name, _, value in (x.partition(": ") for x in lines.decode().split("\r\n") if x)}


def read(records: DataFrame) -> DataFrame:
    """Parses records: page_id, url, payload_bytes, payload_digest, record_type, refers_to. records: record, and payload for revisits.

    Stops if a payload's digest or length is not what the header says.
    """
    ship(records.sparkSession)

    def parse(batches):
        for batch in batches:
            out = ([], [], [], [], [], [])
            for record, payload in zip(batch.column(0), batch.column(1)):
                fields, body = parsed(record.as_buffer())
                if fields["warc-type"] == "revisit" and payload.is_valid:
                    body = payload.as_buffer()
                digest = hashlib.sha256(body).hexdigest()
                if payload.is_valid or fields["warc-type"] == "response":
                    if fields["warc-payload-digest"] != f"sha256:{digest}" or int(fields["http-length"]) != len(body):
                        raise ValueError(f"record {fields['warc-record-id']} doesn't have the payload that its header names")
                number = lambda name: int(fields[name]) if name in fields else None
                found = number("page-id"), fields.get("warc-target-uri"), int(fields["http-length"]), fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"], number("refers-to-page-id")
                for store, x in zip(out, found):
                    store.append(x)
            kinds = pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return records.select("record", "payload").mapInArrow(parse, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def files(records: DataFrame, file_bytes: int = 1 << 26) -> DataFrame:
    """WARC files of about file_bytes at most: name and content, each record a gzip member of its own, as tools expect it."""
    ship(records.sparkSession)

    def pack(batches):
        from pyspark import TaskContext

        n, held, size = 0, [], 0
        for batch in batches:
            for record in batch.column(0):
                held.append(gzip.compress(record.as_buffer(), 6, mtime=0))
                size += len(held[-1])
                if size >= file_bytes:
                    yield one(TaskContext.get().partitionId(), n, held)
                    n, held, size = n + 1, [], 0
        if held:
            yield one(TaskContext.get().partitionId(), n, held)

    def one(task, n, held):
        return pa.RecordBatch.from_arrays([pa.array([f"{task:06}-{n:06}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["name", "content"])

    return records.select("record").mapInArrow(pack, "name string, content binary")


def unpacked(found: DataFrame) -> DataFrame:
    """The records of WARC files, gzipped or not: name, record, payload (null). found: name and content, as of spark.read.format('binaryFile')."""
    ship(found.sparkSession)

    def split(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = bytes(content.as_buffer())
                data, at = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, 0
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    stop = end + int(_fields(data[at:end].partition(b"\r\n")[2])["content-length"]) + 4
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data[at:stop]], pa.binary()), pa.array([None], pa.binary())], ["name", "record", "payload"])
                    at = stop

    return found.select("name", "content").mapInArrow(split, "name string, record binary, payload binary")


def digest(pages: DataFrame) -> DataFrame:
    """What op13 returns: the pages' records, written to an archive and read back."""
    archive = write(pages, scratch(pages.sparkSession, "warc"))
    return read(originals(archive)).drop("url")
