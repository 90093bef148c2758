"""Mixing sources to target weights over a time-varying curriculum. Native.

Each source has a weight and a schedule: multipliers at knots of training time between 0 and 1,
linear in between. Targets share the words of all sources by weight; a target stops at ``repeats``
times its source's size and the excess goes to the others. A source's schedule is integrated over
time and scaled to its target: its cumulative demand. Its documents stand in a fixed pseudo-random
order, one after the other, again and again for as long as the demand lasts; a document's place in
that order is a demand, and the demand's inverse gives the time at which training reaches it. All
documents are then sorted by time over ranges.

Running sums within a source are taken in two steps, over buckets of the pseudo-random order and
within each bucket, so that no task holds a whole source. The number of buckets follows the
number of rows. One row per source is the largest table that a single task sorts.

Null text has size 0; a null source is a source of its own, listed last; size-0 documents are
taken 0 times, and a source that has no others has target 0. Repeated rows stand next to each other and are taken like any others. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varispark.llm.shared import materialize, unused, word_count

WEIGHTS = (5, 2, 1)
REPEATS = 3
KNOTS = (0.0, 0.5, 1.0)
#: Multipliers at the knots for the first, second and third weight: the heavy sources come early, the light ones late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Rows of a bucket of the pseudo-random order, about.
BUCKET_ROWS = 20_000


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size and the document's pseudo-random key, and other columns."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key(docs).alias("key"), *more)


def row_key(docs: DataFrame) -> Column:
    """A hash of doc_id and text: rows that share an id, or have none, are spread by their texts; copies of a row stand together."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.md5(F.concat_ws(":", part(docs["doc_id"].cast("string")), part(F.md5(docs["text"]))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: source, source_size, tier (the weight's place), target.

    Sorted by repeats * size / weight, the sources that are full come first. Source k is full if the
    words left after those before it, shared by the weights that are left, would exceed its limit.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    tier = (F.row_number().over(order) - 1) % len(weights)
    by = by.select("source", "source_size", tier.alias("tier"))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("tier") + 1).cast("double"))
    by = by.withColumn("most", (F.lit(repeats) * F.col("source_size")).cast("double"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    by = by.select(
        "source", "source_size", "tier", "weight", "most",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))).alias("words_left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    )
    by = by.withColumn("level", F.col("words_left") / F.col("weight_left")).withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    level = F.max(F.when(~F.col("full"), F.struct("words_left", "weight_left"))).over(every)  # at the first source that is not full
    shared = level["words_left"] / level["weight_left"] * F.col("weight")
    return by.select("source", "source_size", "tier", F.when(F.col("full"), F.col("most")).otherwise(shared).alias("target"))


def _time(demand: Column, target: Column, tier: Column, knots, schedules) -> Column:
    """The time at which the cumulative demand of a source is reached; null for a source without a target, as all its texts are empty."""
    out = F.lit(None).cast("double")
    for k, heights in enumerate(schedules):
        area = [(knots[i + 1] - knots[i]) * (heights[i] + heights[i + 1]) / 2 for i in range(len(knots) - 1)]
        total, below, when = sum(area), 0.0, F.lit(knots[-1]).cast("double")
        for i in reversed(range(len(area))):
            below = sum(area[:i])
            rest = F.try_divide(demand, target) * F.lit(total) - F.lit(below)
            slope = (heights[i + 1] - heights[i]) / (knots[i + 1] - knots[i])
            # slope / 2 * t^2 + height * t = rest, in the form that also holds for slope 0
            root = F.sqrt(F.greatest(F.lit(heights[i] ** 2) + F.lit(2 * slope) * rest, F.lit(0.0)))
            step = 2 * rest / (F.lit(heights[i]) + root)
            when = F.when(rest <= F.lit(area[i]), F.lit(knots[i]) + step).otherwise(when)
        out = F.when(tier == k, when).otherwise(out)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, knots=KNOTS, schedules=SCHEDULES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row: doc_id, source, size, key, source_size, target, taken, and passes.

    passes has a struct(pass, time, words) for each time that the document comes up in training; the last
    pass of a source cuts one document so that the source's words sum to its target, rounded down.
    """
    if len(weights) != len(schedules):
        raise ValueError("each weight needs a schedule")
    rows = materialize(sized(docs), "mix-sizes")
    count = rows.count()
    buckets = max(1, -(-count // bucket_rows))
    rows = rows.withColumn("bucket", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long"))
    by = targets(rows, weights, repeats)
    # Sums of buckets: as many rows for a source as there are buckets.
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    plan = sums.join(by.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("base") + F.col("inner"))
    goal = F.floor("target")

    def one(p: Column) -> Column:
        begin = p * F.col("source_size") + F.col("start")
        words = F.greatest(F.least(F.col("size"), goal - begin), F.lit(0)).cast("long")
        return F.struct(p.cast("int").alias("pass"), _time(begin.cast("double"), F.col("target"), F.col("tier"), knots, schedules).alias("time"), words.alias("words"))

    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats)), one), lambda x: x["words"] > 0)
    out = rows.withColumn("passes", passes)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return out.select("doc_id", "source", "size", "key", "source_size", "target", taken.alias("taken"), "passes")


def digest(mixed: DataFrame) -> DataFrame:
    """What op3 returns: one row per document, sorted over ranges by the time of its first pass; those never taken last."""
    first = F.round(F.get(F.col("passes"), F.lit(0))["time"], 9)
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", F.coalesce(first, F.lit(2.0)).alias("time"))
    return out.repartitionByRange("time", "doc_id").sortWithinPartitions("time", "doc_id").withColumn("time", F.when(F.col("time") < 2, F.col("time")))


def stream(docs: DataFrame, **options) -> DataFrame:
    """The documents in training order, each once for its first pass and for every other in which at least half of it is taken.

    So every document that its source's target reaches is there, whole; a source's words differ from its target by less than one document.
    The columns are those of docs. A document's row is found again by a hash of doc_id and text; copies of a
    row come up equally often, as the one of them that comes first does.
    """
    p = unused("__mix", docs)
    mixed = mix(docs, **options)
    times = F.transform(F.filter("passes", lambda x: (x["pass"] == 0) | (2 * x["words"] >= F.col("size"))), lambda x: x["time"])
    mine = mixed.groupBy(F.col("key").alias(f"{p}_key")).agg(F.min(times).alias(f"{p}_times")).where(F.size(f"{p}_times") > 0)
    found = docs.join(mine, row_key(docs) == F.col(f"{p}_key"))
    found = found.withColumn(f"{p}_time", F.explode(f"{p}_times"))
    return found.repartitionByRange(f"{p}_time").sortWithinPartitions(f"{p}_time").select(*[F.col(f"`{c}`") for c in docs.columns])
