"""Shared storage, sizes and small helpers of the operators in this folder.

Intermediate tables are written to the folder in ``spark.checkpoint.dir``, which driver and
executors share, and read back: this cuts the lineage and survives the loss of an executor.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varispark import shipping

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A table is broadcast only if its rows take no more than this many bytes.
BROADCAST_BYTES = 32 << 20

_scratch: list[tuple[SparkSession, str]] = []
_kept: set[str] = set()
_held: dict = {}
_local: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; in local mode one of its own where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "" not in _local:
        _local[""] = tempfile.TemporaryDirectory(prefix="varispark-")
        atexit.register(_local[""].cleanup)
    return f"file://{_local[''].name}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one intermediate table. The application's end deletes it, if its Scope doesn't before."""
    top = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if top not in _kept:
        where = spark._jvm.org.apache.hadoop.fs.Path(top)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
        _kept.add(top)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


class Scope:
    """The intermediate tables written while it is open (with), whose folders end() deletes once nothing reads them any
    more. Tables of others, written before or after, stay."""

    def __init__(self):
        self.own: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> "Scope":
        self.first = len(_scratch)
        return self

    def __exit__(self, *_) -> None:
        self.own += _scratch[self.first :]
        del _scratch[self.first :]

    def end(self) -> None:
        for spark, path in self.own:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        self.own = []


def unused(prefix: str, *tables: DataFrame) -> str:
    """The prefix, made longer until no column of the tables begins with it."""
    names = [c.lower() for t in tables for c in t.columns]
    while any(c.startswith(prefix.lower()) for c in names):
        prefix += "_"
    return prefix


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the table to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application, so that it need not be installed on them, and bound Arrow batches."""
    # Bounds of what a Python worker and the JVM's buffers for it hold at once, whatever the texts' lengths.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    shipping.ship(spark)


def held(key: tuple, make):
    """The one large object (a vocabulary with its cache, a model) that this Python process holds; another takes its place."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Words of a text as a column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch, rows: int = 512):
    """Sub-batches, so that Python holds the strings of a few documents only."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def grouped(batches, keys: int):
    """Keys and arrays of the other columns of each run of rows that agree in their first columns, whole numbers all."""
    import numpy as np

    now, parts = None, []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        new = np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)
        cut = [0, *(np.nonzero(new)[0] + 1).tolist(), batch.num_rows]
        for x, y in zip(cut, cut[1:]):
            key = tuple(int(c[x]) for c in columns[:keys])
            if key != now and parts:
                yield now, [np.concatenate(p) for p in zip(*parts)]
                parts = []
            now = key
            parts.append([c[x:y] for c in columns[keys:]])
    if parts:
        yield now, [np.concatenate(p) for p in zip(*parts)]


def small(df: DataFrame, row_bytes: int = 100) -> DataFrame:
    """A written table, to be broadcast if its rows take no more than BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def first_row():
    """Of grouped rows the one with the smallest doc_id, nulls last, and text_key; and copies, how many rows agree in both."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key", "copies"))


def distinct_rows(rows: DataFrame, *more: str) -> DataFrame:
    """doc_id, text_key and the other columns of rows, each once, and copies, their number."""
    return rows.groupBy("doc_id", "text_key", *more).agg(F.count("*").alias("copies"))


def rows_at(docs: DataFrame, at: DataFrame) -> DataFrame:
    """One row of docs for each of the doc_id and text_key of at, a written table, with at's other columns but copies,
    which says how many rows of docs agree in both: only rows with copies are shuffled to choose one, if at is small."""
    p = unused("__row", docs, at)
    keys = at.withColumnsRenamed({"doc_id": f"{p}_id", "text_key": f"{p}_key", "copies": f"{p}_copies"})

    def found(which: str) -> DataFrame:
        some = small(keys.where(f"{p}_copies {which} 1"))
        return docs.join(some, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{p}_id")) & (F.xxhash64("text") == F.col(f"{p}_key")))

    one = F.row_number().over(Window.partitionBy(f"{p}_id", f"{p}_key").orderBy(F.lit(0)))
    copies = found(">").withColumn(f"{p}_one", one).where(f"{p}_one = 1").drop(f"{p}_one")
    return found("=").unionByName(copies).drop(f"{p}_id", f"{p}_key", f"{p}_copies")
