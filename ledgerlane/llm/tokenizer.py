"""Token ids by the ``tokenizers`` library, with a bounded cache of words in each worker.

A byte-level BPE vocabulary never merges across the boundary between a visible character
and white space, so a text is the concatenation of its chunks (white space, then a word),
and a chunk seen before needs no second encoding. Texts with white space beyond
blank, tab and line ends, or with one of the vocabulary's special strings, are encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

_CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([,.!?;:#*$%&]*)")
#: White space, or what some libraries take for it, beyond blank, tab and line ends.
_RARE_SPACE = "[\x0b\x0c\x1c-\x1f\x85\xa0" + "".join(
    map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]"
_RARE = re.compile(_RARE_SPACE)
#: A blank with white space, or nothing, behind it and white space ahead of it.
_BLANKS = re.compile(r"[ \t\n\r] (?:[ \t\n\r]|\Z)")
_LOADED: dict[str, "Encoder"] = {}


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the
    others in order from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


_SIGNS = _byte_signs()


class Encoder(dict):
    """Word -> the ids of a blank and the word, as little-endian unsigned 32-bit integers; ``encode`` for whole texts.

    Words are what blanks part; a blank begins a chunk unless white space stands on both its sides, and
    texts with such blanks are cut by pattern. The cache takes the first ``cache_entries`` words a worker
    meets (about 0.2 KB each); others are encoded each time. Letters and marks that can't merge with their
    neighbours go to the library's BPE model directly, other chunks through all of its tokenizer."""

    def __init__(self, path: str, cache_entries: int = 250_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.bpe, self.room, self.marks = self.tokenizer.model.tokenize, cache_entries, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.by_chunk = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                         and not pre.get("add_prefix_space") and not spec.get("normalizer")
                         and spec["model"]["type"] == "BPE")

    def _ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of what the tokenizer's pattern leaves in one piece."""
        if part.isascii():  # blanks, line ends, letters and marks: the first two have signs of their own
            signs = part.replace(" ", _SIGNS[0x20]).replace("\n", _SIGNS[0x0A])
        else:
            signs = part.encode("utf-8").decode("latin-1").translate(_SIGNS)
        return array("I", [t.id for t in self.bpe(signs)]).tobytes()

    def _mark(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self._part(marks)
            if len(marks) <= 2:
                self.marks[marks] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        found = _PARTS.fullmatch(chunk)
        if not found:
            return self._ids(chunk)
        line_end, word, marks = found.groups()  # these never merge
        ids = self[word[1:]] if word[0] == " " else self._part(word)
        if marks:
            ids += self._mark(marks)
        return self._mark(line_end) + ids if line_end else ids

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and word.isascii():
            ids = array("I", [t.id for t in self.bpe(_SIGNS[0x20] + word)]).tobytes()
        elif word.isalpha() and _LETTERS.fullmatch(word):
            ids = self._part(" " + word)
        else:
            ids = b"".join([self._chunk(c) for c in _CHUNK.findall(" " + word)])
        if len(self) < self.room and len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_chunk or _RARE.search(text) or any(s in text for s in self.special):
            return self._ids(text)
        if _BLANKS.search(text):
            return b"".join(map(self._chunk, _CHUNK.findall(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self._chunk, _CHUNK.findall(first))) + b"".join(map(self.__getitem__, rest))


def encoder(path: str) -> Encoder:
    """The worker's encoder of this vocabulary, loaded once and kept over tasks."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
