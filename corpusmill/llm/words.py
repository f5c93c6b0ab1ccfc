"""Texts as sequences of words that are looked up once a batch."""

from __future__ import annotations

import gc
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@contextmanager
def no_collection():
    """Without cyclic garbage collection, which many small objects set off in vain."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Memo:
    """Ids of words, as bytes, from ``compute(words)``. When it is full, what it holds
    becomes the old half, and words that come again move over from there; long words
    aren't kept."""

    def __init__(self, compute: Callable[[list[str]], list[bytes]], room: int = 400_000, longest: int = 48):
        self.compute, self.room, self.longest = compute, room, longest
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, words: list[str]) -> list[bytes]:
        if len(self.now) > self.room:
            self.old, self.now = self.now, {}
        now, old = self.now, self.old
        lacking = [w for w in words if w not in now]
        new = [w for w in lacking if w not in old]
        now.update((w, old[w]) for w in lacking if w in old)
        now.update(zip(new, self.compute(new)))
        out = list(map(now.__getitem__, words))
        for w in new:
            if len(w) > self.longest:
                del now[w]
        return out


def gathered(parts: list[bytes], codes: np.ndarray, kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``parts`` in the order of ``codes``, and where each code's end."""
    width = np.dtype(kind).itemsize
    sizes = np.fromiter(map(len, parts), np.int32, len(parts)) // width
    begins = np.cumsum(sizes, dtype=np.int32) - sizes
    own = sizes[codes]
    after = np.cumsum(own, dtype=np.int32)
    at = np.repeat(begins[codes] - (after - own), own) + np.arange(after[-1] if len(after) else 0, dtype=np.int32)
    return np.frombuffer(b"".join(parts), kind)[at], np.concatenate([[0], after])


def split_words(column: pa.StringArray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The texts at single spaces: where each text's words begin and end, and all words."""
    lists = pc.split_pattern(column.fill_null(""), " ")
    return lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
