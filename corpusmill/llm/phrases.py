"""Phrases and collocations, counted by an FM-index per shard over word ids.

A task gathers the texts of a language into shards of a bounded number of words. A
shard's words become ids in the order of the words, its pieces one sequence with
breaks between. ``Index`` keeps the Burrows-Wheeler transforms of that sequence and
of the reversed one; a phrase is a pair of intervals of equal length, one in each.
All phrases of a length are extended at once by the words that follow (from the
reversed transform) or go before (from the other), and the second interval follows
from the counts of smaller words. Suffixes are ordered by their first depth - 1 words
only: no more is needed to extend a phrase of that length. The counts of shards are
then summed. They are sent as compressed blocks of sorted phrases, one for each
shard, length and part of the hash range, so that no key is hot: a phrase is sent at most
once per shard. The number of parts grows with the bytes of all texts, and with it
each summing task holds a bounded number of phrases.

Defined cases: texts are lowered in A-Z alone; null counts as empty, a null language
as ``und``; repeated rows count once each; a very long text is cut into several shards
between pieces, and a piece is never cut, so its length bounds a shard from below; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.names import quoted
from corpusmill.llm.word_arrays import classes, slices, words_in
from corpusmill.shared import written
from corpusmill.ship import ship

KINDS = classes(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Words of a shard, and bytes of text to a part of the hash range.
SHARD, PART = 600_000, 8_000_000


@dataclass
class Phrases:
    """Phrases of one length: their words, column by column, where their intervals begin
    in the transform of the sequence and in that of the reversed one, and their counts."""

    words: list[np.ndarray]
    front: np.ndarray
    back: np.ndarray | None
    n: np.ndarray


class Index:
    """Of a sequence of ids from 1 to ``size`` that begins and ends with a break, 0."""

    def __init__(self, sequence: np.ndarray, size: int, depth: int):
        self.base = size + 1
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=self.base))])
        self.before, self.after = (self._transform(s, max(1, depth - 1)) for s in (sequence, sequence[::-1]))

    def _transform(self, s: np.ndarray, width: int) -> np.ndarray:
        n, columns = len(s), [np.roll(s, -k).astype(np.int64) for k in range(width)]
        low = n.bit_length()
        if width * self.base.bit_length() + low <= 63:
            key = columns[0]
            for c in columns[1:]:
                key = key * self.base + c
            order = np.sort(key << low | np.arange(n)) & ((1 << low) - 1)
        else:
            order = np.lexsort(columns[::-1])
        return s[order - 1]

    def _ranks(self, transform: np.ndarray, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where the suffixes begin that ``symbols`` make with what lies before ``places``."""
        n = len(transform)
        held = np.sort(transform.astype(np.int64) * n + np.arange(n))
        return np.searchsorted(held, symbols.astype(np.int64) * n + places)

    def single(self) -> Phrases:
        ids = np.arange(1, self.base, dtype=np.int32)
        return Phrases([ids], self.begins[1:-1], self.begins[1:-1], np.diff(self.begins)[1:])

    def extended(self, p: Phrases, right: bool, both: bool = True) -> Phrases:
        """All phrases by one word longer. Without ``both`` the interval on the side of
        the new word isn't worked out, so that only the other side can be extended."""
        transform, own, other = (self.after, p.back, p.front) if right else (self.before, p.front, p.back)
        which = np.repeat(np.arange(len(p.n)), p.n)
        begins = np.cumsum(p.n) - p.n
        symbols = transform[np.repeat(own - begins, p.n) + np.arange(len(which))]
        keys = np.sort(which * self.base + symbols)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(keys)))
        which, symbols = np.divmod(keys[first], self.base)
        del keys
        moved = None if other is None else other[which] + first - begins[which]
        kept = symbols > 0
        which, symbols, n = which[kept], symbols[kept], n[kept]
        moved = None if moved is None else moved[kept]
        grown = self._ranks(transform, symbols, own[which]) if both else None
        words = [w[which] for w in p.words]
        symbols = symbols.astype(np.int32)
        return Phrases([*words, symbols], moved, grown, n) if right else Phrases([symbols, *words], grown, moved, n)

    def enumerated(self, depth: int) -> Iterator[Phrases]:
        """The phrases of each length up to ``depth``, by turns to the right and to the left."""
        p = self.single()
        yield p
        for k in range(2, depth + 1):
            p = self.extended(p, right=k % 2 == 0, both=k < depth - 1)
            yield p


def _sequences(texts: pa.Array, most: int) -> Iterator[tuple[np.ndarray, pa.StringArray]]:
    """Shards of texts: ids with breaks, and the words in order, which ids number from 1."""
    found = words_in(texts, KINDS, lowered=True)
    new = np.concatenate([[True], np.diff(found.piece) != 0]) if len(found.piece) else np.zeros(0, bool)
    heads = np.append(np.flatnonzero(new), len(new))
    begin = 0
    while begin < len(new):
        end = int(heads[max(np.searchsorted(heads, begin + most, side="right") - 1, np.searchsorted(heads, begin, side="right"))])
        coded = found.words[begin:end].dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int32)
        place[order.to_numpy()] = np.arange(1, len(order) + 1)
        breaks = np.cumsum(new[begin:end])
        sequence = np.zeros(end - begin + breaks[-1] + 1, np.int32)
        sequence[np.arange(end - begin) + breaks] = place[coded.indices.to_numpy()]
        yield sequence, coded.dictionary.take(order)
        begin = end


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def blocks(texts: pa.Array, depth: int, parts: int, most: int = SHARD) -> Iterator[tuple[int, bytes]]:
    """(part, block) of each shard of ``texts``: a block is an Arrow stream of the phrases of one
    length in a part of the hash range, and of their counts."""
    rows = (texts.slice(begin, end - begin) for begin, end in slices(texts, 6 * most))  # a word has about six bytes
    for sequence, words in (x for some in rows for x in _sequences(some, most)):
        hashes = np.concatenate([[0], np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))]).astype(np.uint64)
        for p in Index(sequence, len(words), depth).enumerated(depth):
            order = np.arange(len(p.n)) if len(p.words) < 3 else np.lexsort(p.words[::-1]) if len(p.words) > 3 else np.sort(p.words[0].astype(np.int64) << 32 | np.arange(len(p.n))) & 0xFFFFFFFF
            h = np.zeros(len(order), np.uint64)
            for w in p.words:
                h = _mixed(h + hashes[w[order]])
            part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 65536 else np.uint32)
            dealt = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[dealt], np.arange(parts + 1))
            order = order[dealt]
            columns = [words.take(pa.array(w[order] - 1)) for w in p.words]
            rows = pa.table({"phrase": columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, " "), "n": pa.array(p.n[order].astype(np.int64))})
            del columns, h, part, dealt, order
            for i in np.flatnonzero(np.diff(edges)).tolist():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rows.slice(edges[i], edges[i + 1] - edges[i]))
                yield i, sink.getvalue().to_pybytes()


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("phrase").aggregate([("n", "sum")]).rename_columns(["phrase", "n"])


def merged(found: Iterator[bytes], least: int) -> pa.Table:
    """(words, phrase, n): the phrases of a part that are found ``least`` times or more, and a
    row of 0 words with the number of all words."""
    held, rows, room = [], 0, 1_500_000
    for block in found:
        held.append(pa.ipc.open_stream(block).read_all())
        rows += len(held[-1])
        if rows > room:
            held = [_summed(held)]
            rows = len(held[0])
            room = max(room, 2 * rows)
    all_ = _summed(held)
    words = pc.add(pc.count_substring(all_["phrase"], " "), 1)
    total = pc.sum(all_["n"].filter(pc.equal(words, 1))).as_py() or 0
    often = pc.greater_equal(all_["n"], least)
    out = pa.table({"words": pc.cast(words.filter(often), pa.int32()), "phrase": all_["phrase"].filter(often), "n": all_["n"].filter(often)})
    one = pa.table({"words": pa.array([0], pa.int32()), "phrase": pa.array([None], pa.string()), "n": pa.array([total], pa.int64())})
    return pa.concat_tables([out, one])


def counts(docs: DataFrame, lang: str = "lang", text: str = "text", depth: int = 3, least: int = 10, shard: int = SHARD, part: int = PART) -> DataFrame:
    """(lang, words, phrase, n): phrases of up to ``depth`` words that a language's texts hold
    ``least`` times or more, and a row without a phrase, of 0 words, with the number of all
    its words."""
    rows = docs.select(F.coalesce(F.col(quoted(lang)).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(8, math.ceil(size / part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}

        def flushed(name: str) -> Iterator[pa.RecordBatch]:
            del sizes[name]
            for i, block in blocks(pa.concat_arrays(held.pop(name)), depth, parts, shard):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int32()), pa.array([block], pa.binary())], ["lang", "part", "block"])

        for b in (whole.slice(begin, end - begin) for whole in batches for begin, end in slices(whole.column(1), 6 * shard)):
            for name in pc.unique(b.column(0)).to_pylist():
                own = b.column(1).filter(pc.equal(b.column(0), name))
                held.setdefault(name, []).append(own)
                sizes[name] = sizes.get(name, 0) + (pc.sum(pc.binary_length(own)).as_py() or 0)
                del own
            while sum(sizes.values()) > 6 * shard:
                yield from flushed(max(sizes, key=sizes.get))
        for name in list(sizes):
            yield from flushed(name)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        out = merged((x.as_py() for x in table["block"]), least)
        return out.add_column(0, "lang", pa.array([key[0].as_py()] * len(out), pa.string()))

    ship(docs.sparkSession)
    sent = rows.mapInArrow(run, "lang string, part int, block binary")
    found = written(sent.groupBy("lang", "part").applyInArrow(merge, "lang string, words int, phrase string, n long"))
    totals = found.where("words = 0").groupBy("lang").agg(F.lit(0).alias("words"), F.lit(None).cast("string").alias("phrase"), F.sum("n").alias("n"))
    return found.where("words > 0").unionByName(totals)


def _within(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longest): of every phrase of two words or more that lies inside a longer
    one, the count of the most frequent such."""
    w = F.col("words")
    begins = F.transform(F.sequence(F.lit(1), w), lambda i: F.transform(F.sequence(F.lit(2), F.greatest(w - 1, F.lit(2))), lambda k: F.struct(i.alias("i"), k.alias("k"))))
    spans = F.filter(F.flatten(begins), lambda s: (s["i"] + s["k"] - 1 <= w) & (s["k"] < w))
    each = phrases.where("words > 2").select("lang", F.split("phrase", " ", -1).alias("ws"), "n", F.explode(spans).alias("s"))
    return each.groupBy("lang", F.array_join(F.slice("ws", F.col("s.i"), F.col("s.k")), " ").alias("phrase")).agg(F.max("n").alias("longest"))


def scored(found: DataFrame, least: int = 10) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of the phrases of two words or more in ``found``
    (lang, words, phrase, n): at the cut with the lowest score. Sides of joins are written
    before, so that Spark can split those of a word that begins or ends very many phrases."""
    held = written(found.where(F.col("n") >= least).where("words > 0").select("lang", "phrase", "words", "n"))
    w = F.col("words")
    cuts = held.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), w - 1)).alias("k"))
    cuts = written(cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - words)").alias("rest")))
    part = lambda c, n: held.select("lang", F.col("phrase").alias(c), F.col("n").alias(n))
    both = written(cuts.join(part("first", "l"), ["lang", "first"])).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(1000000 * cast(a AS decimal(15,0)) * cast(a AS decimal(15,0)) AS decimal(38,0)) div cast(cast(l AS decimal(15,0)) * cast(r AS decimal(15,0)) AS decimal(38,0))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")
    return both.groupBy("lang", "words", "phrase", "a").agg(lowest).select("lang", "words", "phrase", "a", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", depth: int = 3, least: int = 10, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``depth``
    words by score, then count, then the phrase's bytes. A phrase of which a longer one makes
    up half the occurrences or more is left out in favour of the longer."""
    found = counts(docs, lang, text, depth, least)
    told = written(scored(found, least))
    longer = written(_within(told.withColumnRenamed("a", "n")))
    kept = told.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (2 * F.col("longest") < F.col("a"))).drop("longest")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # Each of 32 parts of a language keeps its first, so that no task orders all of a language's.
    some = kept.withColumn("slot", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slot").orderBy(*order))).where(F.col("rank") <= top).drop("slot")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = found.where("words = 0").select("lang", "n")
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
