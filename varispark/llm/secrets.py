"""Secret scan: patterns, and sliding-window entropy over candidate strings. Native.

A text is cut natively with ``split`` and ``regexp_extract_all`` on one pattern: the pieces and
the matches alternate, so running sums of their lengths are the spans. Base spans are those of
three patterns. Candidates are maximal runs of one character class; over each run a window
slides by one character: the count of the character that leaves goes down, that of the one that
enters goes up, and the sum of count * log2(count) is updated from these two counts alone. The
span from the first to the last window whose Shannon entropy reaches the class's threshold is
reported, unless the run is on the allow-list or the span lies within one found before.

Null text counts as empty and has no spans. Repeated rows give repeated results. Nothing leaves
a row: there is no shuffle, and no state grows with the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in the order in which kinds at one start are listed.
#: Failing matches of access and hex can be left out in the pattern: a shorter run holds no longer one.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGN = 6

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: kind, alphabet, pattern of a maximal run, window, bits of entropy in a window.
CLASSES = (
    ("entropy_hex", DIGITS + "abcdef", r"[0-9a-f]{24,}", 24, 3.0),
    ("entropy_upper", DIGITS + UPPER, r"[0-9A-Z]{20,}", 20, 3.5),
    ("entropy_base64", DIGITS + UPPER + LOWER + "+/_-", r"[0-9A-Za-z+/_-]{20,}", 20, 3.75),
)
#: Candidates that match the first pattern of a pair and not the second, if any, are no secrets: words joined by single
#: separators, UUIDs, runs of an alphabet, placeholders. No group is repeated without bound, which in Java takes stack for each repeat.
ALLOW = (
    (r"^[A-Za-z][A-Za-z_/+-]*$", r"[_/+-]{2}"),
    (r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", None),
    (r"(?i:example|placeholder|xxxx|0123456789|1234567890|abcdefghij)", None),
)
#: Entropies are summed as whole multiples of this, so that increments leave no rounding behind.
SCALE = 1 << 20


def _running(steps: Column) -> Column:
    """For an array of (gap, length, keep): the spans that are kept, in order, in linear time.

    Spans are gathered in short arrays that are joined at the end; one long array would be copied at each step.
    """
    kind = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(kind).alias("few"), F.array().cast(f"array<{kind}>").alias("full"))
    start = start.withField("few", F.array().cast(kind))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["length"]
        few = F.when(x["keep"], F.concat(acc["few"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["few"])
        over = F.size(acc["few"]) >= 256
        return F.struct(
            end.alias("at"),
            F.when(over & x["keep"], F.array(F.struct(begin.alias("start"), end.alias("end")))).when(over, F.array().cast(kind)).otherwise(few).alias("few"),
            F.when(over, F.concat(acc["full"], F.array(acc["few"]))).otherwise(acc["full"]).alias("full"),
        )

    return F.aggregate(steps, start, step, lambda acc: F.concat(F.flatten(acc["full"]), acc["few"]))


def _arrays(text: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """The pieces between the matches and the matches' groups, zipped; computed once for each text."""
    arrays = [F.transform(F.split(text, pattern, -1), F.length).alias("gap")]
    arrays += [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]
    return F.when(text.rlike(pattern), F.arrays_zip(*arrays))


def _window(run: Column, alphabet: str, window: int, bits: float) -> Column:
    """Struct (start, end) within a run: first to last window with enough entropy; null if there is none.

    The counts are the letters of a string, one for each character of the alphabet, of which a step changes two.
    Time and memory are linear in the run.
    """
    zero = ord("A")
    weight = F.array(*[F.lit(round(c * math.log2(c) * SCALE) if c else 0) for c in range(window + 1)])
    most = int((math.log2(window) - bits) * window * SCALE)
    start = F.struct(F.lit(chr(zero) * len(alphabet)).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), F.lit(0).alias("i"))
    count = lambda n, code: F.ascii(F.substring(n, code, F.lit(1))) - zero
    put = lambda n, code, k: F.overlay(n, F.char(k + zero), code, F.lit(1))

    def slide(acc: Column, x: Column) -> Column:
        new, old = count(acc["n"], x["new"]), count(acc["n"], x["old"])
        moves, gone = x["new"] != x["old"], x["old"] > 0
        up = F.get(weight, new + 1) - F.get(weight, new)
        down = F.get(weight, old - 1) - F.get(weight, old)
        total = F.when(~moves, acc["sum"]).when(gone, acc["sum"] + up + down).otherwise(acc["sum"] + up).cast("long")
        n = F.when(~moves, acc["n"]).when(gone, put(put(acc["n"], x["new"], new + 1), x["old"], old - 1)).otherwise(put(acc["n"], x["new"], new + 1))
        i = acc["i"] + 1
        hot = (i >= window) & (total <= most)
        return F.struct(
            n.alias("n"),
            total.alias("sum"),
            F.when(hot & acc["first"].isNull(), i - window).otherwise(acc["first"]).alias("first"),
            F.when(hot, i).otherwise(acc["last"]).alias("last"),
            i.alias("i"),
        )

    def one(codes: Column) -> Column:
        moves = F.transform(codes, lambda c, i: F.struct(c.alias("new"), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(0)).alias("old")))
        return F.aggregate(moves, start, slide, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    # As the one element of an array, the codes are computed once and not anew for each character.
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c))
    return F.get(F.transform(F.array(codes), one), F.lit(0))


def _allowed(run: Column) -> Column:
    out = F.lit(False)
    for pattern, never in ALLOW:
        out = out | (run.rlike(pattern) & ~run.rlike(never) if never else run.rlike(pattern))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base (the three patterns' spans) and extra (the entropy spans).

    Both are arrays of struct(start, rank, end, kind), ordered; positions are code points, the end
    is exclusive, and rank is the kind's place in the listing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = (("assign", ASSIGN, (0, 2)), ("access", ACCESS, (0,)), ("hex", HEX, (0,)))
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", text.alias("text"))
    out = out.select("id", *[_arrays(F.col("text"), p, g).alias(kind) for kind, p, g in base], *[_arrays(F.col("text"), p, (0,)).alias(kind) for kind, _, p, *_ in CLASSES])
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"

    def placed(name: str, rank: int, keep) -> Column:
        steps = F.transform(F.col(name), lambda x: F.struct(F.coalesce(x["gap"], F.lit(0)).alias("gap"), F.coalesce(F.length(x["g0"]), F.lit(0)).alias("length"), keep(x).alias("keep")))
        spans = F.transform(_running(steps), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(name).alias("kind")))
        return F.coalesce(spans, F.array().cast(kind))

    def entropic(name: str, rank: int, alphabet: str, window: int, bits: float) -> Column:
        matched = F.filter(F.col(name), lambda x: x["g0"].isNotNull())
        runs = F.transform(matched, lambda x: F.when(~_allowed(x["g0"]), _window(x["g0"], alphabet, window, bits)))
        steps = F.transform(F.col(name), lambda x: F.struct(F.coalesce(x["gap"], F.lit(0)).alias("gap"), F.coalesce(F.length(x["g0"]), F.lit(0)).alias("length"), x["g0"].isNotNull().alias("keep")))
        spans = F.zip_with(
            _running(steps), runs, lambda s, w: F.struct((s["start"] + w["first"]).alias("start"), F.lit(rank).alias("rank"), (s["start"] + w["last"]).alias("end"), F.lit(name).alias("kind"))
        )
        return F.coalesce(F.filter(spans, lambda s: s["start"].isNotNull()), F.array().cast(kind))

    found = [
        placed("assign", 0, lambda x: F.coalesce(F.length(x["g2"]) >= MIN_ASSIGN, F.lit(False))),
        placed("access", 1, lambda x: x["g0"].isNotNull()),
        placed("hex", 2, lambda x: x["g0"].isNotNull()),
    ]
    more = [entropic(name, 3 + k, alphabet, window, bits) for k, (name, alphabet, _, window, bits) in enumerate(CLASSES)]
    out = out.select("id", F.sort_array(F.concat(*found)).alias("base"), F.sort_array(F.concat(*more)).alias("extra"))
    new = F.filter("extra", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return out.select(F.col("id").alias(id_col), "base", new.alias("extra"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """What op1 returns for the result of scan()."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.sort_array(F.concat("base", "extra"))).alias("spans"), F.size("extra").cast("long").alias("n_entropy")
    )
