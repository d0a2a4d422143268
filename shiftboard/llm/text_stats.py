"""Structure counts of whole texts, from their bytes.

``n_repeat_words``: words inside eight-word windows that occur twice or more in the text, the first
occurrence included.  ``n_dup_lines``: lines with a word that equal an earlier line of the text.
A null or empty text counts 0 everywhere.
"""

from __future__ import annotations

import numpy as np

from .words import Words, gram_bounds, grams, hash_spans, mix, split

WINDOW = 8
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_chars", "n_upper", "n_bang", "n_punct", "n_digits", "n_lines", "n_unique_words",
]


def _among(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOLS = _among(b"#*$%&|<>")
UPPER = _among(bytes(range(65, 91)))
BANG = _among(b"!")
PUNCT = _among(b".,;:?")
DIGITS = _among(b"0123456789")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which hashes occur more than once in their text."""
    key = hashes ^ mix(rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which hashes have an equal one before them in their text."""
    key = hashes ^ mix(rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:][key[order][1:] == key[order][:-1]]] = True
    return out


def _lines(data: np.ndarray, offsets: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(lines, duplicate lines) per text."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.append(start[1:] - 1, len(data))
    final = np.append(row[1:] != row[:-1], True)
    end[final] = offsets[row[final] + 1]
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, with_word = start[worded], end[worded], row[worded]
    again = later(hash_spans(data, start, end), with_word)
    return np.bincount(row, minlength=n), np.bincount(with_word[again], minlength=n)


def counts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], Words]:
    """Every count of ``COUNTS`` for each text, and its words."""
    w = split(data, offsets, "graphic", lower=False)
    n, rows = len(offsets) - 1, w.row_of()
    begins = (data & 0xC0) != 0x80  # first bytes of characters
    chars = np.concatenate([[0], np.cumsum(begins)])
    in_words = np.concatenate([[0], np.cumsum(chars[w.end] - chars[w.start])])
    hashes = grams(w.hash, WINDOW)
    first, last = gram_bounds(w.bounds, WINDOW)
    runs = last - first
    at = np.repeat(first - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
    at = at[repeated(hashes[at], np.repeat(np.arange(n), runs))]
    cover = np.bincount(at, minlength=len(w.hash) + 1) - np.bincount(at + WINDOW, minlength=len(w.hash) + 1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[: len(w.hash)] > 0)])
    n_lines, dup_lines = _lines(data, offsets, w)
    out = {
        "n_words": w.counts(),
        "word_chars": in_words[w.bounds[1:]] - in_words[w.bounds[:-1]],
        "n_symbols": _per_text(SYMBOLS[data], offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": covered[w.bounds[1:]] - covered[w.bounds[:-1]],
        "n_chars": chars[offsets[1:]] - chars[offsets[:-1]],
        "n_upper": _per_text(UPPER[data], offsets),
        "n_bang": _per_text(BANG[data], offsets),
        "n_punct": _per_text(PUNCT[data], offsets),
        "n_digits": _per_text(DIGITS[data], offsets),
        "n_lines": n_lines,
        "n_unique_words": np.bincount(rows[~later(w.hash, rows)], minlength=n),
    }
    return out, w


def shares(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Counts as shares that do not grow with the text; 0 where there is nothing to share."""

    def over(a: str, b: str) -> np.ndarray:
        return c[a] / np.maximum(c[b], 1)

    return {
        "symbol_share": over("n_symbols", "word_chars"),
        "dup_line_share": over("n_dup_lines", "n_lines"),
        "repeat_share": over("n_repeat_words", "n_words"),
        "upper_share": over("n_upper", "word_chars"),
        "bang_share": over("n_bang", "word_chars"),
        "punct_share": over("n_punct", "n_words"),
        "digit_share": over("n_digits", "word_chars"),
        "unique_share": over("n_unique_words", "n_words"),
        "mean_word": over("word_chars", "n_words"),
        "words_per_line": over("n_words", "n_lines"),
    }
