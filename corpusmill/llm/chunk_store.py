"""Token ids in a content-addressed store.

Each document's ids (with an end id) are cut where a rolling hash over the last
``WINDOW`` ids hits a pattern, so that an insertion moves only nearby cuts.
A chunk is named by the SHA-256 of its ids as little-endian 32-bit integers.
Layout under the store's folder:

- ``packs/``: files of zstd-compressed chunks, one after another; every chunk
  is stored once. Chunks are dealt to packs by their name, and copies that a
  task has already sent on are dealt by document instead, so that a text with
  thousands of copies loads no single task.
- ``chunks``: a table (chunk, pack, at, size, n) of where each chunk lies.
- ``recipes``: a table in ascending document order: (place, doc_id, start,
  n_tokens, chunks, root); ``start`` counts the ids of all documents before, and
  ``root`` is the hash of the document's chunk names.
- ``manifest``: the Merkle tree over the roots, ``FAN`` children a node.

Packs of lost or repeated tasks are no harm: only packs that the written tables
name are read. ``read_ids`` and ``digests`` check every chunk's name and every
document's length, and fail if a chunk is lacking, damaged or of another length
than its recipe says; ``check_manifest`` builds the tree anew up to its top.

Defined cases: null and empty texts consist of the end id alone; a text that holds
the content of a special token gets that token's id there, as in the library; a
very long text is encoded in one piece and stored in chunks of at most ``MOST``
ids; an empty table makes a store without documents; null ids come first in the
order, repeated ids follow each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.shared import shared_dir, written
from corpusmill.llm.words import Memo, gathered, no_collection, split_words
from corpusmill.ship import ship

WINDOW, LEAST, MOST, MEAN_BITS, FAN = 16, 256, 8192, 10, 1024
ODD = 0x9E3779B97F4A7C15

#: White space, as tokenizers' patterns have it, and separators that might count.
SPACES = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Before a space that a word follows, a byte-level tokenizer always cuts; runs
#: of spaces before other white space are the exception, and line ends between rare
#: kinds of white space. Texts with these are encoded as a whole.
RUNS = rf"  (?:[{SPACES}]|$)|[{SPACES}]\n[{SPACES}]|\x{{fffe}}"
#: A line end between two words is a cut as well; what follows it gets this mark.
MARK = "\ufffe"
#: ASCII punctuation, but for the apostrophe, which opens contractions.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_alphabet() -> dict[int, int]:
    """Of byte-level models: printable Latin-1 characters stand for their bytes, the
    other bytes are numbered from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {**{b: b for b in plain}, **{b: 256 + k for k, b in enumerate(others)}}


BYTE_ALPHABET = _byte_alphabet()


class WordTokenizer:
    """The tokenizers library, asked once for each word between the cuts that it
    always makes; a worker keeps the ids of words that it has met, up to a bound.
    A word stands for itself with a space in front; a word that ends in
    punctuation is put together from the word and the punctuation, between which
    there is always a cut as well."""

    def __init__(self, model: str, remember: int = 400_000):
        """``model``: the text of a tokenizer's file."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        #: Texts that hold one of these are encoded as a whole, as the library reads them as one id.
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Memo(self.spaced, remember)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def spaced(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space in front, or of a line end and a word. Letters alone are never cut, so the
        library's model can be asked at once, in its own byte alphabet."""
        letters = [w.isalpha() for w in words]
        ask, alphabet = self.tokenizer.model.tokenize, BYTE_ALPHABET
        rest = iter(self.whole([w[1:] if w[:1] == MARK else " " + w for w, x in zip(words, letters) if not x]))
        return [array("I", [x.id for x in ask((" " + w).encode().decode("latin-1").translate(alphabet))]).tobytes() if x else next(rest) for w, x in zip(words, letters)]

    def __call__(self, column: pa.StringArray) -> list[np.ndarray]:
        """Ids of each text. The words are told apart in Arrow, so that Python sees
        each different word of the batch once."""
        with no_collection():
            return self._encode(column)

    def _encode(self, column: pa.StringArray) -> list[np.ndarray]:
        texts = [t or "" for t in column.to_pylist()]
        found = pc.match_substring_regex(column.fill_null(""), RUNS)
        for content in self.added:
            found = pc.or_(found, pc.match_substring(column.fill_null(""), content))
        odd = dict.fromkeys(np.flatnonzero(found.to_numpy(False)).tolist())
        if odd:
            odd = dict(zip(odd, self.whole([texts[i] for i in odd])))
            column = pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.string())
        ends, words = split_words(pc.replace_substring_regex(column.fill_null(""), r"(\S)\n(\S)", f"\\1 {MARK}\n\\2"))
        # A word of letters and the punctuation after it are looked up one by one.
        names = words.dictionary
        stems = pc.utf8_rtrim(names, MARKS)
        apart = pc.utf8_is_alpha(stems)
        stems = pc.if_else(apart, stems, names).dictionary_encode()
        tails = [w[n:] for w, n in zip(names.to_numpy(False), pc.utf8_length(stems.dictionary.take(stems.indices)).to_numpy())]
        marks = {m: k for k, m in enumerate({"", *tails})}
        parts = [*self.known(stems.dictionary.to_numpy(False).tolist()), *self.whole(list(marks))]
        n = len(stems.dictionary)
        parts += self.whole(names.to_numpy(False)[words.indices.to_numpy()[ends[:-1]]].tolist())
        codes = np.empty((len(words), 2), np.int32)
        at = words.indices.to_numpy()
        codes[:, 0] = stems.indices.to_numpy()[at]
        codes[:, 1] = (n + np.array([marks[m] for m in tails], np.int32))[at]
        codes[ends[:-1], 0] = np.arange(n + len(marks), len(parts))
        codes[ends[:-1], 1] = n + marks[""]
        ids, after = gathered(parts, codes.ravel())
        at = after[2 * ends]
        return [np.frombuffer(odd[i], np.uint32) if i in odd else ids[at[i] : at[i + 1]] for i in range(len(texts))]


_tokenizers: dict[int, WordTokenizer] = {}


def tokenizer(shared) -> WordTokenizer:
    """The worker's tokenizer for a broadcast model, made once."""
    key = getattr(shared, "id", id(shared))
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordTokenizer(shared.value)
    return _tokenizers[key]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks. The rolling hash of a window is its polynomial in an
    odd base modulo 2**64; windows come from differences of prefix sums."""
    n = len(ids)
    ends, last = [], 0
    if n > LEAST:
        up, down = _powers(n, ODD), _powers(n, pow(ODD, -1, 1 << 64))
        sums = np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * down, dtype=np.uint64)
        rolled = sums.copy()
        rolled[WINDOW:] -= sums[:-WINDOW]
        hit = (rolled * up * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - MEAN_BITS) == 0
        for end in (np.flatnonzero(hit) + 1).tolist():
            while end - last > MOST:
                last += MOST
                ends.append(last)
            if end - last >= LEAST and n - end >= WINDOW:
                last = end
                ends.append(end)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n]


def chunk_name(ids: bytes) -> str:
    return hashlib.sha256(ids).hexdigest()


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """A row per chunk of each document; its data only where this task first met it. The tokenizer's file,
    of a few MB, is read by the driver and sent to the workers once."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack, met = tokenizer(shared), zstandard.ZstdCompressor(level=1), set()
        end = np.array([end_id], np.uint32)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                row, pos, n, after, chunk, data = [], [], [], [], [], []
                for i, ids in enumerate(encode(b.column(2))):
                    ids = np.concatenate([ids, end])
                    start = 0
                    for k, stop in enumerate(cuts(ids)):
                        raw = ids[start:stop].astype("<u4")
                        name = chunk_name(raw.tobytes())
                        small = raw.astype("<u2") if int(raw.max()) < 65536 else raw
                        data.append(None if name in met else bytes([small.itemsize]) + pack.compress(small.tobytes()))
                        met.add(name)
                        if len(met) > 2_000_000:
                            met.clear()
                        row.append(i)
                        pos.append(k)
                        n.append(stop - start)
                        after.append(len(ids) - stop)
                        chunk.append(name)
                        start = stop
                at = pa.array(row, pa.int64())
                cols = [b.column(0).take(at), b.column(1).take(at), pa.array(pos, pa.int32()), pa.array(n, pa.int64()), pa.array(after, pa.int64()), pa.array(chunk), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "pos", "n", "after", "chunk", "data"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"uid long, doc_id {kind}, pos int, n long, after long, chunk string, data binary")


def _write_packs(chunks: DataFrame, folder: str) -> DataFrame:
    """Stores each chunk's first copy; the rows with where it lies, without the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name, met, at, out = f"{uuid.uuid4().hex}.pack", set(), 0, None
        for b in batches:
            pack, place, size = [], [], []
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("data")):
                if not data.is_valid or chunk in met:
                    pack.append(None)
                    place.append(None)
                    size.append(None)
                    continue
                met.add(chunk)
                out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
                raw = data.as_buffer()
                out.write(raw)
                pack.append(name)
                place.append(at)
                size.append(raw.size)
                at += raw.size
            cols = [b.column(c) for c in ("uid", "doc_id", "pos", "n", "after", "chunk")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pack, pa.string()), pa.array(place, pa.int64()), pa.array(size, pa.int64())], ["uid", "doc_id", "pos", "n", "after", "chunk", "pack", "at", "size"])
        if out:
            out.close()

    kind = chunks.schema["doc_id"].dataType.simpleString()
    return chunks.mapInArrow(run, f"uid long, doc_id {kind}, pos int, n long, after long, chunk string, pack string, at long, size long")


def _root(chunks: Column) -> Column:
    return F.sha2(F.array_join(chunks, ""), 256)


def _level(nodes: DataFrame) -> DataFrame:
    up = nodes.groupBy(F.floor(F.col("place") / FAN).alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "root"))).alias("below"))
    return up.select("place", _root(F.transform("below", lambda x: x["root"])).alias("root"))


def merkle(leaves: DataFrame) -> DataFrame:
    """(level, place, root) of the nodes over (place, root), the top last. A node
    takes FAN children, so no group and no level grows beyond its due."""
    levels, n, k = [], leaves.count(), 0
    nodes = leaves.select("place", "root")
    while n > 1 or not k:
        nodes, n, k = _level(nodes), -(-n // FAN), k + 1
        levels.append(nodes.select(F.lit(k).alias("level"), "place", "root"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> Store:
    spark = docs.sparkSession
    ship(spark)
    path = path or f"{shared_dir(spark)}/store"
    store = Store(spark, path)
    chunks = _cut_documents(docs, tokenizer_path, end_id, doc_id, text)
    dealt = chunks.repartition(F.when(F.col("data").isNotNull(), F.col("chunk")).otherwise(F.sha2(F.col("uid").cast("string"), 256)))
    cut = written(_write_packs(dealt, f"{path}/packs"), f"{path}/cut")
    cut.where("pack is not null").select("chunk", "pack", "at", "size", "n").write.parquet(f"{path}/chunks")
    whole = cut.groupBy("uid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "chunk", "after"))).alias("parts"), F.sum("n").alias("n_tokens"))
    # Ranges of documents; a first pass counts each range, a second adds what the ranges before it hold.
    ranged = written(whole.repartitionByRange("doc_id", "uid").withColumn("range", F.spark_partition_id()), f"{path}/ranges")
    sizes = ranged.groupBy("range").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sizes.select("range", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"))
    inside = Window.partitionBy("range").orderBy("doc_id", "uid")
    told = ranged.withColumn("place", F.row_number().over(inside)).withColumn("run", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    recipes = told.join(F.broadcast(offsets), "range").select(  # a row per range of shuffled data, however large
        (F.col("docs_before") + F.col("place") - 1).alias("place"), "doc_id", (F.col("tokens_before") + F.col("run") - F.col("n_tokens")).alias("start"),
        "n_tokens", "parts", _root(F.transform("parts", lambda x: x["chunk"])).alias("root"),
    )
    recipes.repartitionByRange("place").sortWithinPartitions("place").write.parquet(f"{path}/recipes")
    merkle(store.table("recipes")).write.parquet(f"{path}/manifest")
    return store


def _read_chunks(store: Store, with_ids: bool) -> DataFrame:
    """(chunk, n, crc, sound[, ids]) of every stored chunk. Each pack is read by
    one task from its start to its end."""
    folder = f"{store.path}/packs"
    names = ["chunk", "n", "crc", "sound", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        unpack, name, file = zstandard.ZstdDecompressor(), None, None
        for b in batches:
            rows = []
            for chunk, pack, at, size in zip(*[b.column(c).to_pylist() for c in ("chunk", "pack", "at", "size")]):
                if pack != name:
                    name, file = pack, fs.open_input_file(f"{path}/{pack}")
                data = file.read_at(size, at)
                raw = np.frombuffer(unpack.decompress(data[1:]), f"<u{data[0]}").astype("<u4").tobytes()
                rows.append((chunk, len(raw) // 4, zlib.crc32(raw), chunk_name(raw) == chunk, raw)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    placed = store.table("chunks").select("chunk", "pack", "at", "size").repartition("pack").sortWithinPartitions("pack", "at")
    return placed.mapInArrow(run, "chunk string, n long, crc long, sound boolean" + ", ids binary" * with_ids)


#: Fixed value: the CRC-32 polynomial, bits reversed.
POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the CRC polynomial."""
    out = np.zeros_like(a)
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(k) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), b >> np.uint64(1) ^ np.uint64(POLY), b >> np.uint64(1))
    return out


def moved_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part contributes to the CRC of a whole if ``after`` bytes follow it;
    the CRC of the whole is the exclusive or of these."""
    out, after = crc.astype(np.uint64), after.astype(np.uint64)
    step = np.full_like(out, 0x00800000)  # x**8
    while after.any():
        out = np.where(after & np.uint64(1), _times(step, out), out)
        step, after = _times(step, step), after >> np.uint64(1)
    return out.astype(np.int64)


def _complete(n_tokens: str, want: str) -> Column:
    """``n_tokens`` where it is what the recipe says; an error elsewhere."""
    lacking = F.raise_error(F.concat(F.lit("a document at place "), F.col("place").cast("string"), F.lit(" isn't whole")))
    return F.when(F.col(n_tokens).eqNullSafe(F.col(want)), F.col(n_tokens)).otherwise(lacking.cast("long"))


def _sound(chunk, sound) -> None:
    """Fails for a chunk that is lacking (``sound`` is null) or isn't what its name says."""
    for name, x in zip(chunk, sound):
        if not x:
            raise ValueError(f"chunk {name} is {'damaged' if x is False else 'lacking'}")


def digests(store: Store) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks) of each document, computed from
    the stored chunks: every pack is read once, and only each chunk's CRC-32 goes
    to the documents that name it. A lacking or damaged chunk is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not pc.all(b.column("sound").fill_null(False), min_count=0).as_py():
                _sound(b.column("chunk").to_pylist(), b.column("sound").to_pylist())
            part = moved_crc(b.column("crc").to_numpy(), 4 * b.column("after").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("place"), b.column("n"), pa.array(part)], ["place", "n", "part"])

    recipes = store.table("recipes")
    named = recipes.select("place", F.explode("parts").alias("p")).select("place", F.col("p.chunk").alias("chunk"), F.col("p.after").alias("after"))
    facts = named.join(_read_chunks(store, False), "chunk", "left").mapInArrow(run, "place long, n long, part long")
    whole = facts.groupBy("place").agg(F.sum("n").alias("stored"), F.bit_xor("part").alias("ids_crc32"))
    out = recipes.select("place", "doc_id", "start", "n_tokens", F.size("parts").alias("n_chunks")).join(whole, "place", "left")
    return out.select("doc_id", "start", _complete("stored", "n_tokens").alias("n_tokens"), "ids_crc32", "n_chunks")


def read_ids(store: Store) -> DataFrame:
    """(doc_id, start, ids) of each document, put together from its chunks. A lacking
    or damaged chunk is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for place, want, parts in zip(b.column("place").to_pylist(), b.column("n_tokens").to_pylist(), b.column("parts").to_pylist()):
                _sound([x["chunk"] for x in parts or []], [x["sound"] for x in parts or []])
                ids = np.frombuffer(b"".join(x["ids"] for x in parts or []), "<u4").tolist()
                if len(ids) != want:
                    raise ValueError(f"the document at place {place} has {len(ids)} ids instead of {want}")
                out.append(ids)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    recipes = store.table("recipes")
    named = recipes.select("place", F.explode("parts").alias("p")).select("place", F.col("p.pos").alias("pos"), F.col("p.chunk").alias("chunk"))
    held = named.join(_read_chunks(store, True), "chunk", "left")
    parts = held.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk", "sound", "ids"))).alias("parts"))
    kind = recipes.schema["doc_id"].dataType.simpleString()
    return recipes.select("place", "doc_id", "start", "n_tokens").join(parts, "place", "left").mapInArrow(run, f"doc_id {kind}, start long, ids array<long>")


def check_manifest(store: Store) -> None:
    """Builds the Merkle tree anew from the recipes' chunk names; fails where a node
    up to the top isn't the kept one."""
    leaves = store.table("recipes").select("place", _root(F.transform("parts", lambda x: x["chunk"])).alias("root"))
    again, kept = merkle(leaves), store.table("manifest").withColumnRenamed("root", "told")
    both = again.join(kept, ["level", "place"], "full")
    if wrong := both.where(~F.col("root").eqNullSafe(F.col("told"))).take(1):
        raise ValueError(f"the manifest's node {wrong[0]['place']} of level {wrong[0]['level']} isn't that of its recipes")


def verify(store: Store) -> bool:
    """Whether the manifest follows from the recipes, and every chunk from its data."""
    try:
        check_manifest(store)
    except ValueError:
        return False
    return not _read_chunks(store, False).where("not sound").take(1)
