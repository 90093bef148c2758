"""Token ids by the tokenizers library, encoded once for each distinct piece of text.

A text of ASCII characters and Latin-1 letters, for which the pre-tokenisation rules are plain, is
cut into pieces here. The ids of each distinct piece, which the library's BPE model makes, are kept
in a cache of two generations with a fixed number of entries. Any other text is cut at spaces
between other characters than white space, where both rules used here always cut and across which
no normalisation reaches; stretches with other characters are encoded by the whole library. For a
tokenizer with other rules, whole texts are encoded by it.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

from varispark.llm.shared import held

CUT = re.compile(r" (?<=\S )(?=\S)")
#: Entries of one cache generation.
ENTRIES = 300_000
#: Longer stretches are encoded but not kept.
KEPT_CHARS = 64
#: Characters for which pieces are cut here. Letters are ASCII and Latin-1 ones that are composed and have one lower case.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[\n !-~{_L}]*")
#: The two pre-tokenisation rules for these characters, fixed values.
BYTE_PIECES = re.compile(rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{_L}]+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf"[{_L}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s0-9{_L}]+")



def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Cache(dict):
    """Values made by a function when first asked for; forgets what two turns have not asked for."""

    def __init__(self, make, entries: int = ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT_CHARS:
            self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary, by its rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are written as little-endian 32-bit integers")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.rule = _rule(path)
        self.letters = byte_letters()
        self.pieces = Cache(self._piece)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        mapped = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _stretch(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or "<|" in text:  # special strings begin so
            return self._encode([text])[0]
        found = WORD_PIECES.findall(text.lower()) if self.rule == "words" else BYTE_PIECES.findall(text)
        return b"".join(map(self.pieces.__getitem__, found))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; no special tokens are added."""
        if not self.rule:
            return self._encode(texts)
        self.pieces.turn()
        out = []
        for t in texts:
            if PLAIN.fullmatch(t) and "<|" not in t:
                out.append(self._stretch(t))
            else:
                first, *rest = CUT.split(t)
                out.append(self._stretch(first) + b"".join([self._stretch(" " + x) for x in rest]))
        return out


def _rule(path: str) -> str:
    """Which of the two rules a file has: bytes, words, or none of them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if any(t["lstrip"] or t["rstrip"] or " " in t["content"] or not t["content"].startswith("<|") for t in spec["added_tokens"]):
        return ""
    before, normal = spec["pre_tokenizer"], spec["normalizer"]
    if normal is None:
        return "bytes" if before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] else ""
    kinds = [n["type"] for n in normal.get("normalizers", [])]
    split = before.get("pretokenizers", [{}])[0]
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
    same = drops and split["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return "words" if kinds == ["NFC", "Replace", "Lowercase"] and same else ""


def encoder(path: str) -> Encoder:
    """One encoder for each Python process and file."""
    return held(("encoder", path), lambda: Encoder(path))
