"""Counts over whole texts, for many texts at once, on their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import Words, in_text, sums, text_bytes, window_hashes, within

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


class TextStats:
    """Per text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, and the bytes for further counts.

    ``n_lines`` counts \\n-split lines with a word; a line is repeated if it equals an earlier one byte for byte.
    ``n_repeat_words`` counts the words in windows of three words found twice or more in the text; ``repeated`` marks them.
    Without ``lines`` the counts of lines are left out.
    """

    def __init__(self, column: pa.Array, lines: bool = True):
        self.raw, self.offsets = raw, offsets = text_bytes(column)
        self.words = words = Words(raw, offsets)
        self.n_words = words.count
        self.word_chars = sums(words.ink & ((raw & 0xC0) != 0x80), offsets)
        self.n_symbols = self.bytes_in(_SYMBOL)
        if lines:
            self._lines()
        self._repeats()

    def bytes_in(self, table: np.ndarray) -> np.ndarray:
        return sums(table[self.raw], self.offsets)

    def _lines(self) -> None:
        lines = Words(self.raw, self.offsets, self.raw != 10)
        inked = np.concatenate([[0], np.cumsum(self.words.ink)])
        real = inked[lines.end] > inked[lines.begin]
        keys, docs = in_text(lines.hashes(self.raw), lines.doc)[real], lines.doc[real]
        self.n_lines = np.bincount(docs, minlength=len(self.n_words))
        _, once = np.unique(keys, return_index=True)
        self.n_dup_lines = self.n_lines - np.bincount(docs[once], minlength=len(self.n_words))
        last = self.raw[lines.end[real] - 1] if real.any() else np.zeros(0, np.uint8)
        self.n_closed_lines = np.bincount(docs[np.isin(last, list(b".!?:;\""))], minlength=len(self.n_words))

    def _repeats(self) -> None:
        words = self.words
        windows = window_hashes(words.hashes(self.raw), 3)
        inside, _ = within(len(words.begin), words.first, 3)
        keys = in_text(windows, words.doc[: len(windows)])
        own = np.sort(keys[inside])
        twice = own[1:][own[1:] == own[:-1]]
        marked = np.zeros(len(words.begin), bool)
        if len(twice):
            twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
            at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            found = inside & (twice[at] == keys)
            for i in range(3):
                marked[i : i + len(found)] |= found
        self.repeated = marked
        self.n_repeat_words = sums(marked, words.first)

    def repeated_bytes(self) -> np.ndarray:
        """1 for the bytes of repeated words, 0 for others."""
        turns = np.zeros(len(self.raw) + 1, np.int8)
        turns[self.words.begin[self.repeated]] += 1
        turns[self.words.end[self.repeated]] -= 1
        return np.cumsum(turns[:-1], dtype=np.int8)


def grams(raw: np.ndarray, offsets: np.ndarray, width: int, bits: int, mark: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all runs of ``width`` bytes within texts, and the place of each text's first run (n + 1).

    With a ``mark`` for each byte, runs are the same only if their first bytes are marked alike.
    """
    inside, first = within(len(raw), offsets, width)
    if not len(inside):
        return np.zeros(0, np.uint32), first
    key = np.zeros(len(inside), np.uint32) if mark is None else mark[: len(inside)].astype(np.uint32)
    for i in range(width):
        key = key * np.uint32(0x01000193) + raw[i : i + len(inside)]
    key = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (key >> np.uint32(32 - bits))[inside], first
