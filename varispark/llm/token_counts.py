"""Exact token counts of every prefix, by dynamic programming over byte-level BPE.

For each prefix of a piece (what the pre-tokenisation rule cuts off), exactly one token can be
the last of its encoding: a vocabulary entry that ends there and that merging leaves apart from
the last token of the prefix before it. One pass over a piece's bytes, with all entries that end
at each byte from an Aho-Corasick automaton, so gives the last token and the count of tokens at
every prefix; ``PrefixCounts`` keeps these. How many tokens a text has, how many its first k
characters have, and how many characters fit a budget of tokens are look-ups, with no second
encoding.

Null text counts as empty: no tokens. Equal texts have equal counts. Pieces are counted once
while they stay in a cache with a fixed number of entries; a piece's work is linear in its
length, and a text's in its own. Nothing is shuffled.
"""

from __future__ import annotations

import bisect
import json
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from varispark.llm.shared import held, ship, slices
from varispark.llm.tokens import BYTE_PIECES, PLAIN, Cache, byte_letters

#: The pre-tokenisation rule of the byte-level vocabulary, a fixed value.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 512



class PrefixCounter:
    """Counts for one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in byte_letters().items()}
        raw = lambda s: "".join(chr(letters[c]) for c in s)
        self.tokens = {raw(k): v for k, v in spec["model"]["vocab"].items() if all(c in letters for c in k)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(merges)}
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.pieces = regex.compile(PIECE)
        self.names = {v: k for k, v in self.tokens.items()}
        self.apart: dict[tuple[int, int], bool] = {}
        self.counts_of = Cache(lambda p: self.piece(p)[-1])
        self.automaton = ahocorasick.Automaton()
        for name, i in self.tokens.items():
            self.automaton.add_word(name, (len(name), i))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The encoding of a short byte string by merging alone."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get((parts[k], parts[k + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.ranks:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def stays(self, a: int, b: int) -> bool:
        """Whether merging leaves token b behind token a as they are (a < 0: b alone)."""
        key = (a, b)
        if key not in self.apart:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            left, right = self.names.get(a, ""), self.names[b]
            self.apart[key] = self.merged(left + right) == ([left, right] if left else [right])
        return self.apart[key]

    def piece(self, text: str) -> list[int]:
        """Token counts at every byte of one piece, from 0 to its length."""
        raw = text.encode("utf-8").decode("latin-1")
        n = len(raw)
        count, last = [0] * (n + 1), [-1] * (n + 1)
        apart, stays = self.apart, self.stays
        for end, (length, token) in self.automaton.iter(raw):
            end += 1
            if last[end] >= 0:
                continue
            at = end - length
            before = last[at]
            ok = apart.get((before, token))
            if ok is None:
                ok = stays(before, token)
            if ok and (before >= 0 or at == 0):
                last[end], count[end] = token, count[at] + 1
        return count

    def cut(self, text: str) -> list[str]:
        """The pieces of ordinary text."""
        return BYTE_PIECES.findall(text) if PLAIN.fullmatch(text) else self.pieces.findall(text)

    def total(self, text: str) -> int:
        return sum(map(self.counts_of.__getitem__, self.cut(text)))

    def parts(self, text: str) -> tuple[list[str], list[int]]:
        """The pieces and special strings of a text, and the tokens of each."""
        self.counts_of.turn()
        if "<|" not in text:
            found = self.cut(text)
            return found, list(map(self.counts_of.__getitem__, found))
        parts, counts, at = [], [], 0
        for m in [*self.special.finditer(text), None]:
            found = self.cut(text[at : m.start() if m else len(text)])
            parts += found
            counts += map(self.counts_of.__getitem__, found)
            if m:
                parts.append(m[0])
                counts.append(1)
                at = m.end()
        return parts, counts

    def counts(self, text: str) -> "PrefixCounts":
        return PrefixCounts(self, *self.parts(text))


class PrefixCounts:
    """Token counts at every prefix of one text."""

    def __init__(self, counter: PrefixCounter, parts: list[str], counts: list[int]):
        self.counter, self.parts = counter, parts
        self.tokens = [0, *accumulate(counts)]
        self.chars = [0, *accumulate(map(len, parts))]

    @property
    def total(self) -> int:
        return self.tokens[-1]

    def at(self, chars: int) -> int:
        """Exact number of tokens of the text's first so many characters.

        It is the count before the piece that is cut plus the piece's table at the cut. Three kinds of piece
        are cut otherwise when the text ends in them, and are counted anew with the piece before them: white
        space after white space, a special string, and a contraction.
        """
        chars = max(0, min(chars, self.chars[-1]))
        k = bisect.bisect_left(self.chars, chars) - 1
        if k < 0:
            return 0
        part, own = self.parts[k], self.counter
        head = part[: chars - self.chars[k]]
        before = self.parts[k - 1] if k and not own.special.fullmatch(self.parts[k - 1]) else ""
        if own.special.fullmatch(part):
            if head == part:
                return self.tokens[k + 1]
            return self.tokens[k - bool(before)] + own.total(before + head)
        if head.isspace() and before.isspace():
            return self.tokens[k - 1] + own.total(before + head)
        if head == part:
            return self.tokens[k + 1]
        if head.startswith("'"):
            return self.tokens[k] + own.total(head)
        return self.tokens[k] + own.piece(part)[len(head.encode("utf-8"))]

    def fits(self, budget: int) -> int:
        """Most characters that a budget of tokens holds, looked for in the piece in which the budget ends."""
        if self.total <= budget:
            return self.chars[-1]
        k = bisect.bisect_right(self.tokens, budget) - 1
        part, table = self.parts[k], self.counter.piece(self.parts[k])
        offset = list(accumulate(map(lambda c: len(c.encode("utf-8")), part)))
        n = len(part) - 1
        while n and self.tokens[k] + table[offset[n - 1]] > budget:
            n -= 1
        while n and self.at(self.chars[k] + n) > budget:
            n -= 1
        return self.chars[k] + n


def counter(path: str) -> PrefixCounter:
    """One counter for each Python process and file."""
    return held(("counter", path), lambda: PrefixCounter(path))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes, n_tokens, over_limit, and fit_chars: the characters that the limit holds."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"

    def run(batches):
        own = counter(path)
        for batch in batches:
            for part in slices(batch):
                size, tokens, fit = [], [], []
                for t in part.column(1).to_pylist():
                    t = t or ""
                    size.append(len(t.encode("utf-8")))
                    parts, counts = own.parts(t)
                    n = sum(counts)
                    tokens.append(n)
                    fit.append(len(t) if n <= limit else PrefixCounts(own, parts, counts).fits(limit))
                n = pa.array(tokens, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), n, pa.array([x > limit for x in tokens], pa.bool_()), pa.array(fit, pa.int64())], [id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
