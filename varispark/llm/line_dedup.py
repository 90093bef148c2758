"""Boilerplate lines of a site, by their relative frequency. Native.

Pages are grouped by host. A line's frequency is the number of the host's pages that contain it
over the number of all its pages; lines of at least MIN_PAGES pages whose frequency exceeds RATIO
are boilerplate and are dropped. Lines are compared without the white space around them; blank lines
and lines of fewer than MIN_CHARS characters are never dropped.

A page's distinct lines are reduced to two 64-bit hashes before they are counted, and counts are
summed before the shuffle, so a line on every page of a hot host is a row for each task. A page
of k lines raises at most k of its host's counts, so a host has at most (its mean number of lines
per page) / RATIO boilerplate lines: these are joined to the pages as one row per host. They are
broadcast if their size allows it; else each host's row is copied to several salts and its pages
spread over them.

Null text is kept as null and has no lines; a null host is a host of its own. Repeated rows are
pages like others. Line breaks are line feeds; all that is kept of a text is kept as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varispark.llm.shared import BROADCAST_BYTES, materialize, unused

RATIO = 0.1
MIN_PAGES = 5
MIN_CHARS = 3
SALTS = 64
_KEY = "struct<a:bigint,b:bigint>"


def _keys(text: Column) -> Column:
    """A pair of hashes for each line; null for lines that are never dropped."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(" \t\r\x0b\x0c")))
    return F.transform(lines, lambda x: F.when(F.length(x) >= MIN_CHARS, F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host that has any: host, and the hashes of its boilerplate lines."""
    rows = pages.select(host.alias("host"), text.alias("text"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    keys = F.filter(F.array_distinct(_keys(F.col("text"))), lambda k: k.isNotNull())
    counts = rows.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    found = counts.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    return found.where(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.array_sort(F.collect_list("key")).alias("drop"))


def clean(pages: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, text_col: str = "text", counts: tuple[str, str] = ("__line_n", "__line_dropped")) -> DataFrame:
    """The pages with the columns they had, their boilerplate lines dropped from the text, and the numbers of lines and of
    dropped ones under the names of counts, in place of any such columns of the pages."""
    p = unused("__line", pages)
    drop = materialize(boilerplate(pages, host, F.col(text_col), ratio, min_pages), "boilerplate")
    drop = drop.select(F.col("host").alias(f"{p}_host"), F.col("drop").alias(f"{p}_drop"))
    size = drop.agg(F.coalesce(F.sum(F.size(f"{p}_drop") * 32 + 200), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        found = pages.join(F.broadcast(drop), host.eqNullSafe(F.col(f"{p}_host")), "left")
    else:
        salted = drop.withColumn(f"{p}_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(F.col(text_col)), F.lit(SALTS)).cast("int")
        found = pages.join(salted, host.eqNullSafe(F.col(f"{p}_host")) & (salt == F.col(f"{p}_salt")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    pairs = F.arrays_zip(lines.alias("line"), _keys(F.col(text_col)).alias("key"))
    kept = F.filter(pairs, lambda x: x["key"].isNull() | ~F.array_contains(F.col(f"{p}_drop"), x["key"]))
    found = found.withColumn(f"{p}_kept", F.when(F.col(f"{p}_drop").isNull(), F.lit(None)).otherwise(F.transform(kept, lambda x: x["line"])))
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    dropped = F.when(F.col(f"{p}_kept").isNull(), 0).otherwise(n - F.size(f"{p}_kept")).cast("long")
    text = F.when(dropped > 0, F.array_join(f"{p}_kept", "\n")).otherwise(F.col(text_col))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in pages.columns if c.lower() not in counts]
    return found.select(*columns, n.alias(counts[0]), dropped.alias(counts[1]))


def digest(cleaned: DataFrame) -> DataFrame:
    """What op6 returns: the kept text's length and hash, and the numbers of lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return cleaned.select("doc_id", F.col("__line_n").alias("n_lines"), F.col("__line_dropped").alias("n_dropped"), F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))
