"""Cutting texts by a tokenizer's pattern, fast where a text has only Latin characters.

The pattern's character classes (``\\p{L}``, ``\\p{N}``, ``\\s``, ``\\S``) are written out for code points below
``LIMIT``; a text without others is cut by the standard library with that pattern, any other text
by the pattern itself.  Both give the same matches.  For the best known pattern, ``Runs`` cuts many texts at once by array operations.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import regex

from .words import hash_spans

LIMIT = 0x2B0
SPACE = r"\s"
CLASSES = (r"\p{L}", r"\p{N}", SPACE)


def _written_out(name: str) -> str:
    """The members of a class below ``LIMIT``, as for a bracket."""
    member = regex.compile(name)
    return "".join(f"\\u{c:04x}" for c in range(LIMIT) if member.match(chr(c)))


class Splitter:
    def __init__(self, pattern: str):
        self.full = regex.compile(pattern)
        self.latin = re.compile(self._latin(pattern))
        self.only_latin = re.compile(f"[\\x00-\\u{LIMIT - 1:04x}]*")

    @staticmethod
    def _latin(pattern: str) -> str:
        out, inside = [], False
        for part in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.DOTALL):
            if part in CLASSES:
                part = _written_out(part) if inside else f"[{_written_out(part)}]"
            elif part == r"\S" and not inside:
                part = f"[^{_written_out(SPACE)}]"
            elif part in ("[", "]"):
                inside = part == "["
            out.append(part)
        return "".join(out)

    def split(self, text: str) -> list[str]:
        return (self.latin if self.only_latin.fullmatch(text) else self.full).findall(text)


#: the pattern whose matches are, contractions and the ends of white space aside, runs of one class behind an optional space
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, WHITE = 0, 3
QUOTE, BLANK = ord("'"), ord(" ")
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


class Runs:
    """Matches of ``RUNS`` in many texts, as places in a list of distinct ones."""

    def __init__(self) -> None:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
        self.kind = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for kind, name in ((1, r"\p{L}+"), (2, r"\p{N}+"), (WHITE, r"\s+")):
            for found in regex.finditer(name, every):
                first, last = ord(every[found.start()]), ord(every[found.end() - 1])
                self.kind[first : last + 1] = kind
        self.kind[0xD800:0xE000] = OTHER

    def starts(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where matches start; ``begins``: where texts do."""
        n, kind = len(codes), self.kind.take(codes)
        first = np.zeros(n + 1, bool)
        first[begins] = True
        cut = first.copy()
        cut[1:n] |= kind[1:] != kind[:-1]
        # of white space before something else the last character is a match, or begins the next one
        white = kind == WHITE
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])
        cut[last] = True
        cut[last[codes.take(last) == BLANK] + 1] = False
        quotes = np.flatnonzero((codes == QUOTE) & cut[:n])
        # characters behind a quote, 0 beyond its text
        one = np.where(first.take(quotes + 1), 0, codes.take(quotes + 1, mode="clip"))
        one[quotes + 1 >= n] = 0
        two = np.where((one == 0) | first.take(np.minimum(quotes + 2, n)), 0, codes.take(quotes + 2, mode="clip"))
        two[quotes + 2 >= n] = 0
        for ending in ENDINGS:
            held = one == ord(ending[0])
            if len(ending) == 2:
                held &= two == ord(ending[1])
            at = quotes[held]
            cut[at + 1] = False
            cut[at + 1 + len(ending)] = True
        return np.flatnonzero(cut[:n])

    def distinct(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """Distinct matches as they come, every match's place among them, and each text's range of matches.

        Matches are told apart by a hash, then compared; None if two that differ share one.
        """
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        begins = np.cumsum([0, *map(len, texts)])
        if not len(codes):
            return [], np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = self.starts(codes, begins)
        ends = np.append(starts[1:], len(codes))
        coded = pa.array(hash_spans(codes, starts, ends)).dictionary_encode()
        places = coded.indices.to_numpy()
        first = np.zeros(len(coded.dictionary), np.int64)
        first[places[::-1]] = np.arange(len(places))[::-1]
        sizes, like = ends - starts, first.take(places)
        if not np.array_equal(sizes.take(like), sizes):
            return None
        at = np.repeat((starts.take(like) - starts).astype(np.int32), sizes)
        at += np.arange(len(codes), dtype=np.int32)
        if not np.array_equal(codes.take(at), codes):
            return None
        words = [whole[a:b] for a, b in zip(starts.take(first).tolist(), ends.take(first).tolist())]
        return words, places, np.searchsorted(starts, begins)
