"""Words of a column of texts as one Arrow array, by passes over its bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD, BLANK, BREAK = 0, 1, 2
#: Bytes as they are, but A-Z as a-z.
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def classes(blanks: bytes, breaks: bytes = b"") -> np.ndarray:
    """The class of every byte. All are ASCII, so they never lie within a longer character."""
    out = np.zeros(256, np.uint8)
    out[list(blanks)] = BLANK
    out[list(breaks)] = BREAK
    return out


@dataclass
class Words:
    """``words`` of all rows in order; ``row`` and ``piece`` of each: pieces are numbered
    through, and a new one begins with every row and after every break."""

    words: pa.StringArray
    row: np.ndarray
    piece: np.ndarray


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where rows begin and end, and all their bytes; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return at - at[0], values


def words_in(column: pa.Array, kinds: np.ndarray, lowered: bool = False) -> Words:
    at, data = raw(column)
    kind = kinds[data]
    inner = kind == WORD
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inner[:-1], inner[1:]
    starts = np.flatnonzero(inner & (~before | edge[:-1]))
    ends = np.flatnonzero(inner & (~after | edge[1:])) + 1
    letters = np.ascontiguousarray((LOWERED[data] if lowered else data)[inner])
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    row = np.searchsorted(at, starts, side="right") - 1
    piece = row + np.cumsum(kind == BREAK, dtype=np.int32)[starts] if len(starts) else row
    return Words(pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)), row, piece)


def slices(column: pa.Array, most: int):
    """(begin, end) of stretches of rows of at most ``most`` bytes each, or of one row."""
    at, _ = raw(column)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield begin, min(end, len(column))
        begin = end
