"""Statistics of whole texts, computed for many texts at once with numpy.

Each measure takes a ``Texts`` slice and returns one number per text.  The
word, line and window tables of a slice are built once, on first use, so a
measure pays only for what no earlier measure has built.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from reelforge.llm.common import blank, mix64, span_hash, spans, text_slices, window_hash

#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
REPEAT_WORDS = 8


class Texts:
    """A slice of texts as one byte array."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    @classmethod
    def of(cls, column: pa.Array) -> Iterator[tuple[int, int, "Texts"]]:
        """(lo, hi, slice) over the rows of a string column; null is ''."""
        for lo, hi, data, offsets in text_slices(column):
            yield lo, hi, cls(data, offsets)

    def take(self, rows: np.ndarray) -> "Texts":
        """The texts at ``rows`` only."""
        if len(rows) == self.n:
            return self
        parts = [self.data[self.offsets[r]:self.offsets[r + 1]] for r in rows]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return Texts(np.concatenate(parts) if parts else self.data[:0], offsets)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def counted(self, rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        out = np.bincount(rows, weights, minlength=self.n)
        return out if weights is not None else out.astype(np.int64)

    # -- tables of a slice ------------------------------------------------
    @cached_property
    def blanks(self) -> np.ndarray:
        return blank(self.data)

    @cached_property
    def letters(self) -> np.ndarray:
        """Bytes that begin a code point."""
        return (self.data & 0xC0) != 0x80

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return spans(~self.blanks, self.offsets)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        starts, ends, _ = self.words
        return span_hash(self.data, starts, ends)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of every line that has a word."""
        starts, ends, rows = spans(self.data != 10, self.offsets)
        dark = np.concatenate([[0], np.cumsum(~self.blanks)])
        some = dark[ends] > dark[starts]
        return span_hash(self.data, starts, ends)[some], rows[some]

    # -- measures -----------------------------------------------------------
    def n_words(self) -> np.ndarray:
        return self.counted(self.words[2])

    def n_chars(self) -> np.ndarray:
        return self.per_text(self.letters)

    def word_chars(self) -> np.ndarray:
        return self.per_text(self.letters & ~self.blanks)

    def n_symbols(self) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(SYMBOLS.encode())] = True
        return self.per_text(table[self.data])

    def n_of(self, chars: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(chars)] = True
        return self.per_text(table[self.data])

    def n_lines(self) -> np.ndarray:
        return self.counted(self.lines[1])

    def n_dup_lines(self) -> np.ndarray:
        hashes, rows = self.lines
        return self.n_lines() - self.counted(rows[_first_of(hashes, rows)])

    def n_distinct_words(self) -> np.ndarray:
        rows = self.words[2]
        return self.counted(rows[_first_of(self.word_hashes, rows)])

    def n_echo_words(self) -> np.ndarray:
        """Words equal to the word before them."""
        rows, h = self.words[2], self.word_hashes
        same = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        return self.counted(rows[1:][same])

    def n_repeat_words(self, n: int = REPEAT_WORDS) -> np.ndarray:
        """Words inside an n-word window that the text has twice or more."""
        rows = self.words[2]
        first, h = window_hash(self.word_hashes, rows, n)
        if not len(first):
            return np.zeros(self.n, np.int64)
        key = _keyed(h, rows[first])
        order = np.argsort(key, kind="stable")
        equal = np.zeros(len(key) + 1, bool)
        equal[1:-1] = key[order][1:] == key[order][:-1]
        again = first[order[equal[1:] | equal[:-1]]]
        cover = np.zeros(len(rows) + 1, np.int32)
        np.add.at(cover, again, 1)
        np.subtract.at(cover, again + n, 1)
        return self.counted(rows[np.cumsum(cover[:-1]) > 0])


def _keyed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return mix64(hashes ^ mix64(rows.astype(np.uint64) + np.uint64(1)))


def _first_of(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Index of the first of each set of equal (hash, row)."""
    return np.unique(_keyed(hashes, rows), return_index=True)[1]
