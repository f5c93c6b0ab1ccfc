"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces, their log scores and their kinds come from a public model file whose
path is a parameter; nothing is trained. The text is taken as it is (identity
normaliser): a space is put in front, spaces become the marker U+2581, and the
segmentation with the highest sum of scores wins, the earlier found one on
ties. A character that no piece covers is spelt with the 256 byte pieces.
No piece holds the marker after another character (this is checked when a
model is loaded), so the best segmentation of a text is that of its units, each
a run of markers with what follows it; a worker keeps the ids of units it has
met, up to a bound.

Defined cases: null and empty texts have no ids and decode to an empty text; a very
long text without spaces is searched in windows, with the same ids; an empty table
gives an empty result;
a U+2581 in a text is a marker like a space, and decodes as a space, as in the
public library; repeated rows are encoded alike; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from corpusmill.llm.names import fresh
from corpusmill.llm.words import Memo, gathered, no_collection, split_words
from corpusmill.ship import ship

MARK = "▁"
UNIT = re.compile(r" +[^ ]*")
UNKNOWN_PENALTY = 10.0
WINDOW = 1 << 16  # bytes of a unit that are searched at once


@dataclass
class Model:
    """What the workers need: the trie's arrays, and each id's score and bytes."""

    base: np.ndarray
    check: np.ndarray
    scores: np.ndarray
    spelling: list[bytes]  # with a space for the marker
    byte_ids: list[int]
    unknown: int
    unknown_score: float


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """base and check of a trie over bytes. From state s the byte c leads to
    ``t = base[s] + c + 1`` if ``check[t] == s``; ``t = base[s]`` holds a key's
    value as ``-base[t] - 1``. The root is state 0."""
    tree: dict = {}
    for key, value in keys.items():
        node = tree
        for c in key:
            node = node.setdefault(c + 1, {})
        node[0] = value
    base, check, queue, free = [0] * 1024, [-1] * 1024, [(0, tree)], 1
    check[0] = 0
    for state, node in queue:
        labels, b = sorted(node), free
        while check[free] != -1:
            free += 1
            if free + 300 > len(check):
                base += [0] * len(base)
                check += [-1] * len(check)
        b = max(1, free - labels[0])
        while True:
            if b + 300 > len(check):
                base += [0] * len(base)
                check += [-1] * len(check)
            if all(check[b + c] == -1 for c in labels):
                break
            b += 1
        base[state] = b
        for c in labels:
            check[b + c] = state
        for c in labels:
            if c:
                queue.append((b + c, node[c]))
            else:
                base[b] = -node[0] - 1
    return np.array(base, np.int32), np.array(check, np.int32)


def load(path: str) -> Model:
    """The model in a SentencePiece file, whatever kind it was made as: its
    pieces and scores are all that is read. A model made by merges has ranks
    0, -1, -2 ... for scores, which are no log probabilities: a rank r then
    counts as the logarithm of Zipf's frequency 1 / (r + 1), scaled to sum to 1."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    pieces, spelling, scores, byte_ids = {}, [], np.zeros(n), [-1] * 256
    for i in range(n):
        piece = p.id_to_piece(i)
        if p.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            spelling.append(bytes([int(piece[3:5], 16)]))
        elif p.is_unknown(i) or p.is_control(i):
            spelling.append(b"")
        else:
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece crosses a word's start")
            pieces[piece.replace(MARK, " ").encode()] = i
            scores[i] = p.get_score(i)
            spelling.append(piece.replace(MARK, " ").encode())
    real = sorted(pieces.values())
    ranks = scores[real]
    if (ranks <= 0).all() and (ranks == np.floor(ranks)).all():
        scores[real] = -np.log((1 - ranks) * (1 / np.arange(1.0, len(real) + 1)).sum())
    return Model(*double_array(pieces), scores, spelling, byte_ids, p.unk_id(), float(scores[real].min(initial=0.0)) - UNKNOWN_PENALTY)


class Encoder:
    """Encodes texts with a model's trie; the ids of short units are kept."""

    def __init__(self, model: Model, remember: int = 200_000):
        self.model = model
        self.base, self.check, self.scores = model.base.tolist(), model.check.tolist(), model.scores.tolist()
        self.unknown_score, self.longest = model.unknown_score, max([4, *map(len, model.spelling)])
        self.known = Memo(lambda words: [array("I", self.segment(b" " + w.encode())).tobytes() for w in words], remember)

    def segment(self, text: bytes) -> list[int]:
        """Ids of a unit, by Viterbi. A unit longer than ``WINDOW`` is done window by
        window: once all paths that are still open have a place in common, the ids up to
        there are settled, and the search goes on from there."""
        ids, size, start = array("I"), WINDOW, 0
        while len(text) - start > size:
            part = text[start : start + size + self.longest]
            back, at = self.forward(part, size)
            open_ = {p for p in range(at, len(back)) if back[p] is not None}
            while len(open_) > 1:
                last = max(open_)
                open_ = open_ - {last} | {back[last][0]}
            (common,) = open_
            if common:
                ids.extend(self.path(part, back, common))
                start, size = start + common, WINDOW
            else:
                size *= 2
        text = text[start:] if start else text
        back, _ = self.forward(text, len(text))
        rest = self.path(text, back, len(text))
        return [*ids, *rest] if ids else rest

    def forward(self, text: bytes, stop: int) -> tuple[list, int]:
        """(start, piece) of the best path's last step to every place that a step from
        before ``stop`` reaches, and the first place from ``stop`` on; the piece of an
        unknown character is -1."""
        base, check, scores, n = self.base, self.check, self.scores, len(text)
        best, back = [None] * (n + 1), [None] * (n + 1)
        best[0], back[0], at = 0.0, (0, 0), 0
        while at < stop:
            here, c = best[at], text[at]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            state, end, single = 0, at, False
            while end < n:
                to = base[state] + text[end] + 1
                if check[to] != state:
                    break
                state, end = to, end + 1
                leaf = base[state]
                if check[leaf] == state and base[leaf] < 0:
                    piece = -base[leaf] - 1
                    score = here + scores[piece]
                    if best[end] is None or score > best[end]:
                        best[end], back[end] = score, (at, piece)
                    single = single or end - at == width
            if not single:
                end, score = at + width, here + self.unknown_score
                if best[end] is None or score > best[end]:
                    best[end], back[end] = score, (at, -1)
            at += width
        return back, at

    def path(self, text: bytes, back: list, end: int) -> list[int]:
        ids = []
        while end:
            at, piece = back[end]
            ids += [piece] if piece >= 0 else [self.byte(c) for c in reversed(text[at:end])]
            end = at
        return ids[::-1]

    def byte(self, c: int) -> int:
        x = self.model.byte_ids[c]
        return x if x >= 0 else self.model.unknown

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, column: pa.StringArray) -> list[np.ndarray]:
        """Ids of each text. Between single spaces the units are the words, told apart
        in Arrow so that Python sees each different word of the batch once; texts with
        runs of spaces or at their edges are cut into units one by one."""
        with no_collection():
            texts = [t or "" for t in column.to_pylist()]
            odd = {i for i, t in enumerate(texts) if "  " in t or MARK in t or t[:1] == " " or t[-1:] == " "}
            rest = pa.array([None if i in odd or not t else t for i, t in enumerate(texts)], pa.string())
            ends, words = split_words(rest)
            parts = self.known(words.dictionary.to_numpy(False).tolist())
            ids, after = gathered(parts, words.indices.to_numpy())
            out = []
            for i, t in enumerate(texts):
                if i in odd:
                    x = array("I", [k for u in UNIT.findall(" " + t.replace(MARK, " ")) for k in self.segment(u.encode())])
                    out.append(np.array(x, np.uint32))
                else:
                    out.append(ids[after[ends[i]] : after[ends[i + 1]]] if t else ids[:0])
            return out

    def decode(self, ids: np.ndarray) -> str:
        s = self.model.spelling
        return b"".join([s[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast model, made once."""
    key = f"{shared.id if hasattr(shared, 'id') else id(shared)}"
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def encoded(docs: DataFrame, model_path: str, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """``docs`` with an array column of piece ids, called ``ids``, with underscores after
    it if there is such a column already. The model is a fixed file of some hundred
    kB, sent to the workers once."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))
    names, ids = docs.columns, fresh(docs.columns, ids)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                parts = enc.encode_all(b.column(at))
                ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], [*plain, "ids"])

    # Names with dots and the like are put back at the end.
    plain = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*plain)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("ids", ArrayType(IntegerType()))])).toDF(*names, ids)


def checked(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_byte_tokens, ids_crc32, round_trip) per row: each text is
    encoded and decoded again; ``round_trip`` says if the same text came back."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        is_byte = np.zeros(len(enc.model.spelling), bool)
        is_byte[[i for i in enc.model.byte_ids if i >= 0]] = True
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                rows = []
                for t, x in zip(b.column(1).to_pylist(), enc.encode_all(b.column(1))):
                    rows.append((len(x), int(is_byte[x].sum()), zlib.crc32(x.astype("<u4").tobytes()), enc.decode(x) == (t or "")))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in zip(*rows)]], ["id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean")
    return out.withColumnRenamed("id", doc_id)
