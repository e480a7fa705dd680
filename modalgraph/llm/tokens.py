"""Ids of the ``tokenizers`` library with a cache of pre-tokens, shared by the binary writer and the packer."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import chunks

#: Letters and numbers among the characters up to U+024F.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
#: The byte-level pre-tokenizer's splits, for texts of usual characters.
_SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
#: Texts with characters beyond these are encoded whole by the library, as Unicode tables differ between libraries.
_UNUSUAL = re.compile(r"[^\x00-\x1b\x20-ɏ‐-‧‰-›€]")
#: Pre-tokens kept by a worker before it starts anew.
KEEP = 600_000


class _Known(dict):
    """Numbers of pre-tokens; one asked for the first time gets the next number and waits to be encoded."""

    def __init__(self):
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.waiting.append(piece)
        return n


class CachedTokenizer:
    """Encodes texts as the library does.  A pre-token is encoded by the library when first seen, then looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.ends = _Known(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        new = self.known.waiting
        if not new:
            return
        ids, ends, base = [self.ids], [self.ends], len(self.ids)
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            got = self.library.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got.ids, np.uint32))
            ends.append(base + np.searchsorted(np.array(got.word_ids), np.arange(len(some)), side="right"))
            base += len(ids[-1])
        self.ids, self.ends, self.known.waiting = np.concatenate(ids), np.concatenate(ends), []

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > KEEP:
            self._forget()
        whole = [bool(t and _UNUSUAL.search(t)) for t in texts]
        split = [[] if w or not t else _SPLIT.findall(t) for t, w in zip(texts, whole, strict=True)]
        counts = np.array([len(s) for s in split], np.int64)
        number = np.fromiter((n for s in split for n in map(self.known.__getitem__, s)), np.int64, int(counts.sum()))
        self._learn()
        begin = self.ends[number]
        size = self.ends[number + 1] - begin
        total = np.cumsum(size)
        ids = self.ids[np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        cuts = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(counts)])]
        return [self._whole(t) if w else ids[a:b] for t, w, a, b in zip(texts, whole, cuts[:-1], cuts[1:], strict=True)]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_LOADED: dict[str, CachedTokenizer] = {}


def loaded(path: str) -> CachedTokenizer:
    """The worker's own tokenizer; its cache lives as long as the worker."""
    if path not in _LOADED:
        _LOADED[path] = CachedTokenizer(path)
    return _LOADED[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, text: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Chunks of the batches with each row's ids, the end id appended."""
    tokenizer, end = loaded(path), np.array([end_id], np.uint32)
    for part in chunks(batches, text):
        yield part, [np.append(ids, end) for ids in tokenizer.encode(part.column(text).to_pylist())]
