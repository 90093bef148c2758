"""Language identification by cross-parsing entropy.

A bounded sample of labelled texts per language is turned into a suffix automaton, the smallest
automaton that knows every substring of the sample. A text is parsed against each automaton from
left to right into longest matches: when no match can be extended a phrase ends and the next
begins; a character that the sample does not have counts as two phrases. Phrases per character
times the log of the sample's length estimate the cross entropy of the text under the language; the
language that needs fewest normalised phrases wins, ties go to the smaller language name.

Letters are lower-cased, runs of other characters are one space. Texts are cut into blocks of BLOCK
characters, and blocks of many texts are parsed together by array operations: first as if a phrase
began with each block, then once more those that the block before leaves within a phrase, from the
state it leaves, and one by one those that are even then not begun with the state left. So the phrases are those of one parse from the
text's first character to its last. The automata are built in each Python process from the sample,
which is all that is sent to executors.

Null texts and texts without a letter are ``und`` with score 0. Null labels are not learned from;
without any labelled row every prediction is ``und``. Equal texts have equal predictions.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varispark.llm.shared import held, ship, slices

#: Bounds of the sample: texts per language, and characters taken from all of them together.
SAMPLE_TEXTS = 64
SAMPLE_CHARS = 60_000
#: Characters taken from one text, so that no single text makes up the sample; texts of fewer than SHORT are taken last.
TEXT_CHARS = 8_000
SHORT = 200
BLOCK = 512
#: Numbers that are neither letters nor decimal digits: \w has them.
NUMBERS = {c: " " for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha()}
RUNS = re.compile(r"[\W\d_]+")
#: What is left, as Java's regular expressions have it.
LETTERS = r"\p{L}"
UNKNOWN = "und"


def plain(text: str) -> str:
    text = text.lower()
    if not text.isascii() and not NUMBERS.keys().isdisjoint(text):
        text = text.translate(str.maketrans(NUMBERS))
    return RUNS.sub(" ", text).strip()


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, by state and code; state 1 is the start, 0 none."""
    step, link, length = [{}, {}], [0, 0], [0, 0]
    last = 1
    for c in codes:
        new = len(step)
        step.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Moves:
    """Transitions of an automaton in one table, of which each takes one place.

    A state is renamed to a number of its own such that its transition on code c is at place number ^ c and no
    two transitions share a place; own has the number of the state that a place belongs to. The numbers are
    drawn at random until they fit, states with most transitions first; the table is at least twice as long as
    there are transitions. Number 0 is a state without transitions.
    """

    def __init__(self, step: list[dict[int, int]], symbols: int):
        degree = np.array([len(x) for x in step], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(degree)])
        code = np.fromiter((c for x in step for c in x), dtype=np.int64, count=first[-1])
        target = np.fromiter((t for x in step for t in x.values()), dtype=np.int64, count=first[-1])
        size = 1 << int(max(2 * first[-1], 2 * len(step), symbols)).bit_length()
        self.own = np.full(size, -1, dtype=np.int32)
        self.next = np.zeros(size, dtype=np.int32)
        number = np.zeros(len(step), dtype=np.int64)
        taken = np.zeros(size, dtype=bool)
        taken[0] = True
        claim = np.zeros(size, dtype=np.int64)
        rng = np.random.default_rng(1)
        for d in np.unique(degree[1:])[::-1]:
            left = np.nonzero(degree[1:] == d)[0] + 1
            while len(left):
                draw = rng.integers(1, size, len(left))
                place = draw[:, None] ^ code[first[left][:, None] + np.arange(d)[None, :]]
                claim[draw] = np.arange(len(left))
                fits = ~taken[draw] & (claim[draw] == np.arange(len(left)))
                claim[place.ravel()] = np.repeat(np.arange(len(left)), d)
                fits &= ((self.own[place] == -1) & (claim[place] == np.arange(len(left))[:, None])).all(axis=1)
                number[left[fits]] = draw[fits]
                taken[draw[fits]] = True
                self.own[place[fits]] = draw[fits][:, None]
                left = left[~fits]
        self.next[number[np.repeat(np.arange(len(step)), degree)] ^ code] = number[target]
        self.start = np.int32(number[1])
        self.begin = np.zeros(symbols, dtype=np.int32)  # the start's transitions
        self.begin[list(step[1])] = number[list(step[1].values())]

    def parse(self, codes: list[int], state: int) -> tuple[int, int]:
        """Phrases that begin among the codes, and the state at their end."""
        following, own, begin, count = memoryview(self.next), memoryview(self.own), memoryview(self.begin), 0
        for c in codes:
            at = state ^ c
            if own[at] == state:
                state = following[at]
            else:
                state = begin[c]
                count += 1 if state else 2
        return count, state


class Model:
    """Automata of all languages over one alphabet."""

    def __init__(self, sample: dict[str, str]):
        self.langs = sorted(sample)
        letters = sorted(set().union(*sample.values()))
        self.symbols = len(letters) + 1
        self.code = np.zeros(0x110000, dtype=np.int32)  # 0 is any character that is in no sample
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 1
        self.moves = [Moves(automaton(self.code[_points(sample[x])].tolist()), self.symbols) for x in self.langs]
        self.weights = np.array([math.log2(max(2, len(sample[x]))) for x in self.langs])

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each plain text under each language."""
        blocks, owner, first = [], [], []
        for i, t in enumerate(texts):
            codes = self.code[_points(t)]
            for at in range(0, len(codes), BLOCK):
                blocks.append(codes[at : at + BLOCK])
                owner.append(i)
                first.append(not at)
        out = np.zeros((len(texts), len(self.langs)))
        if not blocks:
            return out
        size = np.array([len(b) for b in blocks])
        order = np.argsort(-size, kind="stable")
        grid = np.zeros((BLOCK, len(blocks)), dtype=np.int32)
        for k, b in enumerate(order):
            grid[: size[b], k] = blocks[b]
        size, who = size[order], np.array(owner)[order]
        place = np.empty(len(blocks), dtype=np.int64)
        place[order] = np.arange(len(blocks))
        (later,) = np.nonzero(~np.array(first))
        block, before = place[later], place[later - 1]
        for k, move in enumerate(self.moves):
            # State 0 is that of a finished phrase: any character begins the next one.
            begin = np.zeros(len(blocks), dtype=np.int32)
            count, end = self._parse(move, grid, size, begin)
            todo = np.sort(block[end[before] != begin[block]])  # longer blocks come first
            if len(todo):
                begin[block] = end[before]
                count[todo], end[todo] = self._parse(move, grid[:, todo], size[todo], begin[todo])
                for b, p in zip(block.tolist(), before.tolist()):  # in the order of the texts
                    if end[p] != begin[b]:
                        begin[b] = end[p]
                        count[b], end[b] = move.parse(grid[: size[b], b].tolist(), int(begin[b]))
            out[:, k] = np.bincount(who, weights=count, minlength=len(texts))
        return out

    @staticmethod
    def _parse(move: Moves, grid: np.ndarray, size: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each block (a column of grid, longer ones first), and the state at its end."""
        alive = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # blocks longer than each position
        state, count = begin.copy(), np.zeros(len(size), dtype=np.int32)
        for i, n in enumerate(alive.tolist()):
            c = grid[i, :n]
            at = state[:n] ^ c
            s = move.next[at]
            ended = move.own[at] != state[:n]
            if ended.any():
                (j,) = np.nonzero(ended)
                s[j] = move.begin[c[j]]
                count[j] += 1 + (s[j] == 0)  # a character that the sample doesn't have takes two: an escape and itself
            state[:n] = s
        return count, state

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        clean = [plain(t) if t else "" for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        found = self.phrases(clean) * self.weights
        best = found.argmin(axis=1)
        least = found[np.arange(len(texts)), best]
        rest = found.copy()
        rest[np.arange(len(texts)), best] = np.inf
        second = rest.min(axis=1) if len(self.langs) > 1 else least * 0 + np.inf
        with np.errstate(invalid="ignore"):
            score = np.where(np.isinf(second), 1.0, second / (second + least))
        return [self.langs[b] if c else UNKNOWN for b, c in zip(best, clean)], [float(s) if c else 0.0 for s, c in zip(score, clean)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def model(sample: dict[str, str]) -> Model:
    """One model for each Python process and sample."""
    key = hashlib.sha256(repr(sorted(sample.items())).encode()).hexdigest()
    return held(("languages", key), lambda: Model(sample))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS, learn=None) -> dict[str, str]:
    """A sample of labelled texts for each language, of at most so many texts and characters.

    Texts of any length that have a letter take part, each with its first TEXT_CHARS characters from its
    first letter on, so every language that labels such a text is in the sample. The texts are those with the
    smallest hashes of their ids, short ones after all others, so the choice doesn't depend on the order of
    rows; a limit before the shuffle leaves each task so many rows of a language at most.
    """
    rows = docs.where(F.col("lang").isNotNull() & (~held_out() if learn is None else learn))
    cut = F.substring(F.regexp_replace("text", rf"^[^{LETTERS}]+", ""), 1, TEXT_CHARS)
    rows = rows.select("lang", cut.alias("text"), F.xxhash64(F.lit("sample"), F.col("doc_id"), F.col("text")).alias("h"))
    rows = rows.where(F.length("text") > 0).withColumn("short", F.length("text") < SHORT)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("short", "h"))).where(F.col("k") <= texts)
    out: dict[str, str] = {}
    for r in rows.orderBy("lang", "k").toLocalIterator():
        have = out.get(r["lang"], "")
        if len(have) < chars:
            out[r["lang"]] = (have + " " + plain(r["text"])).strip()[:chars]
    return {k: v for k, v in out.items() if v}


def identify(docs: DataFrame, sample: dict[str, str], id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns named, and lang_pred and score for each row."""
    ship(docs.sparkSession)
    kept = [docs.schema[c] for c in id_cols]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"
    shipped = docs.sparkSession.sparkContext.broadcast(sample)  # bounded by SAMPLE_CHARS a language

    def run(batches):
        own = model(shipped.value)
        for batch in batches:
            for part in slices(batch):
                lang, score = own.predict(part.column(part.num_columns - 1).to_pylist())
                columns = [part.column(i) for i in range(len(id_cols))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*id_cols, "lang_pred", "score"])

    return docs.select(*id_cols, F.col(text_col).alias("__lang_text")).mapInArrow(run, schema)


def keep_known(docs: DataFrame, sample: dict[str, str]) -> DataFrame:
    """The documents for which a language is found, with their columns."""
    ship(docs.sparkSession)
    names = docs.columns
    schema = docs.schema
    shipped = docs.sparkSession.sparkContext.broadcast(sample)
    at = names.index("text")

    def run(batches):
        own = model(shipped.value)
        for batch in batches:
            for part in slices(batch):
                lang, _ = own.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([x != UNKNOWN for x in lang], pa.bool_()))

    return docs.mapInArrow(run, schema)
