"""Periodic runs of words, found with an enhanced suffix array.

A run is a stretch of consecutive words with a smallest period q that can't be
extended on either side keeping it. The branching tandem repeat test finds those with
enough repetitions: suffix array, its inverse and the table of longest common prefixes
stand for the suffix tree, whose inner nodes are the LCP intervals. In each interval
of depth d, every suffix i outside the largest child looks in the inverse array whether
i + d or i - d lies in the interval too; if so, and if the words after both differ,
a square of 2 d words begins at i (or i - d) that can't be moved to the right. Rotating
it to the left as far as words agree gives the whole stretch; squares of one stretch are
merged, and the smallest period is the smallest divisor of d that is one.

Every run asked for holds a square of some multiple of its period that is at least
``_least_half`` words long. Texts in which no stretch of so many words occurs twice
(told by sorted window hashes, so without a miss) go no further, and intervals of less
depth aren't looked at. Many texts share one suffix array: their words are told apart
by text. Nothing is shuffled; a text of n words takes some hundred bytes a word.

Defined cases: words are told apart by ASCII white space; a null text has none, and an
empty collapsed text; repeated rows give repeated rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.names import quoted
from corpusmill.llm.word_arrays import classes, slices, words_in
from corpusmill.ship import ship

KINDS = classes(b" \t\n\x0b\x0c\r")
#: Bytes of texts that share a suffix array.
SLICE = 6_000_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _least_half(min_length: int, min_exponent: int) -> int:
    """Every run of ``min_length`` words and ``min_exponent`` periods holds a square whose
    half is a multiple of the period and at least so long."""
    return min(q * (max(min_length, min_exponent * q) // (2 * q)) for q in range(1, min_length + 1))


def _repeating(x: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Per text whether some ``width`` words in a row may occur in it twice (always told if they do).
    ``x`` tells words of different texts apart."""
    n = len(x) - width + 1
    if n < 2:
        return np.zeros(owner[-1] + 1 if len(owner) else 0, bool)
    mixed = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.sort(h)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    out = np.zeros(owner[-1] + 1, bool)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        out[owner[:n][twice[at] == h]] = True
    return out


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The suffixes of ``x`` in order, the inverse, and the ranks by the first 1, 2, 4 ... words
    that led there. Only suffixes that aren't told apart yet are sorted in a round."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    new = np.concatenate([[True], np.diff(x[order]) != 0])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h = [rank.copy()], 1
    while True:
        alone = new & np.append(new[1:], True)
        left = np.flatnonzero(~alone)  # places in the order whose suffixes share a rank
        if not len(left):
            break
        at = order[left]
        first, second = rank[at], rank[np.minimum(at + h, n)] + 1
        sort = np.argsort(first * (n + 1) + second, kind="stable")
        order[left] = at = at[sort]
        first, second = first[sort], second[sort]
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        new[left] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, left, 0))
        levels.append(rank.copy())
        h *= 2
    return order, rank, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Of each suffix in order, how many words it shares with the one before it."""
    n = len(order)
    i, j, length = order[1:].copy(), order[:-1].copy(), np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(i, n)] == levels[k][np.minimum(j, n)]
        i[same] += 1 << k
        j[same] += 1 << k
        length[same] += 1 << k
    return np.concatenate([[0], length])


def _smaller_children(lcp: np.ndarray, least: int) -> np.ndarray:
    """(begin, end, depth, child's begin, child's end) of all children but a largest one of every
    LCP interval of depth ``least`` or more; places in the suffix array, ends excluded."""
    out: list[tuple[int, int, int, int, int]] = []

    def closed(depth: int, edges: list[int], end: int) -> None:
        edges.append(end)
        begin = edges[0]
        big = max(range(len(edges) - 1), key=lambda c: edges[c + 1] - edges[c])
        out.extend((begin, end, depth, edges[c], edges[c + 1]) for c in range(len(edges) - 1) if c != big)

    deep = np.flatnonzero(lcp >= least)
    heads = np.flatnonzero(np.concatenate([[True], np.diff(deep) != 1])) if len(deep) else []
    for a, b in zip(heads, [*heads[1:], len(deep)]):
        begin, end = int(deep[a]), int(deep[b - 1]) + 1
        open_: list[tuple[int, list[int]]] = []
        for place, depth in enumerate(lcp[begin:end].tolist(), begin):
            edge = place - 1
            while open_ and open_[-1][0] > depth:
                d, edges = open_.pop()
                edge = edges[0]
                closed(d, edges, place)
            if open_ and open_[-1][0] == depth:
                open_[-1][1].append(place)
            else:
                open_.append((depth, [edge, place]))
        while open_:
            d, edges = open_.pop()
            closed(d, edges, end)
    return np.array(out, np.int64).reshape(-1, 5)


def _squares(x: np.ndarray, order: np.ndarray, inverse: np.ndarray, children: np.ndarray) -> np.ndarray:
    """(end, half, start) of the squares that can't be moved to the right, in this order."""
    n, found = len(x), []
    after = np.append(x, -1)
    sizes = children[:, 4] - children[:, 3]
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + 1, 4_000_000)[1:])
    for part in np.split(children, np.unique(cuts)):
        if not len(part):
            continue
        size = part[:, 4] - part[:, 3]
        which = np.repeat(np.arange(len(part)), size)
        place = np.repeat(part[:, 3] - (np.cumsum(size) - size), size) + np.arange(len(which))
        i, d, low, high = order[place], part[which, 2], part[which, 0], part[which, 1]
        for start in (i, i - d):
            other = np.where(start == i, i + d, start)
            held = inverse[np.clip(other, 0, n)]
            fits = (start >= 0) & (other < n) & (held >= low) & (held < high)
            s, half = start[fits], d[fits]
            s, half = s[(b := after[np.minimum(s + half, n)] != after[np.minimum(s + 2 * half, n)])], half[b]
            found.append(np.stack([s + 2 * half, half, s], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def _begins(x: np.ndarray, start: int, d: int) -> int:
    """How far to the left a stretch with period ``d`` reaches that begins at ``start`` at the latest."""
    step = 32
    while start > 0:
        size = min(step, start)
        differ = np.flatnonzero(x[start - size : start] != x[start - size + d : start + d])
        if len(differ):
            return start - size + int(differ[-1]) + 1
        start -= size
        step *= 2
    return 0


def _smallest(x: np.ndarray, start: int, end: int, d: int) -> int:
    """The smallest period of a stretch of at least two periods ``d``."""
    small = [q for q in range(1, int(d**0.5) + 1) if d % q == 0]
    for q in sorted({*small, *(d // q for q in small)}):
        near = start + min(16, d)
        if q == d or (x[start:near] == x[start + q : near + q]).all() and (x[start : end - q] == x[start + q : end]).all():
            return q
    return d


def runs(x: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> np.ndarray:
    """(start, length, period) by start, then period, of the runs of ``min_length`` words and
    ``min_exponent`` periods or more. Words of different texts are different numbers in ``x``."""
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    if len(x) < 2:
        return np.zeros((0, 3), np.int64)
    order, inverse, levels = suffix_array(x)
    lcp = common_prefixes(order, levels)
    del levels
    found: list[tuple[int, int, int]] = []
    end_now, here = -1, []
    for end, half, start in _squares(x, order, inverse, _smaller_children(lcp, _least_half(min_length, min_exponent))).tolist():
        if end != end_now:
            end_now, here = end, []
        if any(start >= s and half % q == 0 for s, q in here):
            continue
        begin = _begins(x, start, half)
        q = _smallest(x, begin, end, half)
        here.append((begin, q))
        if end - begin >= max(min_length, min_exponent * q):
            found.append((begin, end - begin, q))
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def of_texts(column: pa.Array, min_length: int, min_exponent: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Per text the number of its words, its runs, and the text without repetitions."""
    found = words_in(column, KINDS)
    rows, n = len(column), len(found.words)
    begins = np.searchsorted(found.row, np.arange(rows + 1))
    coded = found.words.dictionary_encode()
    x = found.row * np.int64(len(coded.dictionary) or 1) + coded.indices.to_numpy(zero_copy_only=False)
    keep, spans = np.ones(n, bool), np.zeros((0, 3), np.int64)
    some = np.zeros(rows, bool)
    repeating = _repeating(x, found.row, _least_half(min_length, min_exponent))
    some[: len(repeating)] = repeating
    if some.any():
        chosen = np.flatnonzero(some[found.row])
        spans = runs(np.unique(x[chosen], return_inverse=True)[1].astype(np.int64), min_length, min_exponent)
        spans[:, 0] = chosen[spans[:, 0]]  # a run lies within a text, whose words are all there
        gone = np.zeros(n + 1, np.int64)
        np.add.at(gone, spans[:, 0] + spans[:, 2], 1)
        np.add.at(gone, spans[:, 0] + spans[:, 1], -1)
        keep = np.cumsum(gone)[:-1] == 0
    owner = found.row[spans[:, 0]] if len(spans) else np.zeros(0, np.int64)
    fields = [spans[:, 0] - begins[owner] if len(spans) else spans[:, 0], spans[:, 1], spans[:, 2]]
    structs = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], fields=list(RUN))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), structs)
    left = np.concatenate([[0], np.cumsum(keep)])[begins]
    kept = found.words if keep.all() else found.words.filter(pa.array(keep))
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), kept), " ")
    return pa.array(np.diff(begins), pa.int64()), lists, collapsed


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """(id, n_words, runs, collapsed) per row: ``runs`` by start, then period, words numbered from 0;
    ``collapsed`` has the words but those that repeat a run's first period, joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, end in slices(b.column(1), SLICE):
                out = of_texts(b.column(1).slice(begin, end - begin), min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), *out], ["id", "n_words", "runs", "collapsed"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(quoted(doc_id)).alias("id"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", doc_id)
