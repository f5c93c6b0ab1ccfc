"""Tokens of source files as an array in each file's row, with places and brackets.

The JVM splits a file by one regular expression; a small helper adds places (running sums
over the bytes of many files) and matches brackets (a stack). Nothing is shuffled, and a file's text
and tokens stay together; rules and facts are cut out of the array where they are wanted.
Sequences of tokens are looked at by neighbours: ``code_only`` leaves out blanks and comments.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.ship import ship

FIELDS = [("i", "int"), ("kind", "string"), ("text", "string"), ("line", "long"), ("column", "long"), ("end_line", "long"), ("depth", "int"), ("level", "int"), ("parent", "int"), ("pair", "int"), ("head", "int")]
TOKEN = "struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS) + ">"
ARROW = {"int": pa.int32(), "string": pa.string(), "long": pa.int64()}
#: Tokens that a worker places at a time, but for a longer file, so that its memory doesn't depend on the number of files.
MOST = 30_000
CLOSES = {"}": "{", ")": "(", "]": "["}


def brackets(texts: Sequence[str]) -> tuple[list[int], list[int], list[int]]:
    """Of a file's brackets and semicolons, in order: the place of the bracket that matches each, or -1; of the
    innermost one that is open after it; and, for an opening brace, of the last one before it that ends
    what went before at its level. A closing bracket ends the last open one of its kind; those
    opened after that one match none, and a closing one without its like is passed by."""
    pair, inner, head = [-1] * len(texts), [], [-1] * len(texts)
    open_, ended = [], [-1]  # ``ended`` has one entry more: where the last item of each level ends
    held = dict.fromkeys(CLOSES.values(), 0)  # the open ones of each kind
    for k, x in enumerate(texts):
        if x == ";":
            ended[-1] = k
        elif x not in CLOSES:
            head[k] = ended[-1]
            open_.append(k)
            ended.append(k)
            held[x] += 1
        elif held[want := CLOSES[x]]:
            while texts[open_[-1]] != want:
                held[texts[open_.pop()]] -= 1
                ended.pop()
            held[want] -= 1
            pair[k], pair[open_[-1]] = open_[-1], k
            open_.pop()
            ended.pop()
            if x == "}":
                ended[-1] = k
        inner.append(open_[-1] if open_ else -1)
    return pair, inner, head


def _kinds(flat: pa.Array, first: list[np.ndarray], size: np.ndarray, rust: np.ndarray) -> np.ndarray:
    """By the first four bytes of each token, 0 beyond its end; only letters of several bytes are looked up."""
    a, b, c, d = first
    among = lambda x, chars: np.isin(x, list(chars.encode()))
    line, block = ((a == ord("/")) & (b == ord(x)) for x in "/*")
    doc = ((line & rust & among(c, "/!")) | (block & (c == ord("*")))) & (d != ord("/"))
    string = (among(a, "\"'`") & (size > 1)) | (among(a, "br") & (b == ord('"'))) | ((a == ord("r")) & (b == ord("#")))
    word = ((a | 32) >= ord("a")) & ((a | 32) <= ord("z")) | (a >= ord("0")) & (a <= ord("9")) | (a == ord("_"))
    others = np.flatnonzero(a >= 128)
    word[others] = pc.match_substring_regex(flat.take(pa.array(others)), r"^[\pL\pN]").to_numpy(zero_copy_only=False)
    return np.select([doc, line | block, string, among(a, " \t\r\n"), word], [0, 1, 2, 3, 4], 5)


NAMES = pa.array(["doc_comment", "comment", "string", "blank", "word", "sign"])


def placed(tokens: pa.ListArray, rust: np.ndarray) -> pa.ListArray:
    """The structs of ``TOKEN`` for each row's strings, which follow one another without a gap. All rows are
    placed at once, by their bytes; only brackets are matched one by one."""
    flat, ends = tokens.flatten(), tokens.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    sizes, n = np.diff(ends), len(flat)
    if not n:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([], pa.struct([pa.field(f, ARROW[t]) for f, t in FIELDS])))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + n + 1].astype(np.int64)
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at -= at[0]
    size, padded = np.diff(at), np.concatenate([data, np.zeros(4, np.uint8)])
    start = [np.where(size > k, padded[at[:-1] + k], 0) for k in range(4)]
    kind = _kinds(flat, start, size, rust[row])
    newlines = np.flatnonzero(data == ord("\n"))
    lines = np.searchsorted(newlines, at)  # line ends before each token
    line_begin = np.concatenate([[0], newlines + 1])[lines[:-1]]
    first = ends[:-1][row]
    place = np.arange(n) - first
    is_sign = (kind == 5) & (size == 1) & np.isin(start[0], list(b"{}()[];"))
    signs = np.flatnonzero(is_sign)
    cuts = np.searchsorted(signs, ends)
    chars = start[0][signs].astype(np.uint8).tobytes().decode()
    told = [[], [], []]
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        for whole, own in zip(told, brackets(chars[cuts[r] : cuts[r + 1]])):
            whole += own
    begin = cuts[row]  # the file's first bracket
    match, inner, ended = (np.where(x >= 0, x + begin[signs], -1) for x in (np.array(y, np.int64) for y in told))
    local = place[signs]
    pair, parent, head = np.full(n, -1), np.full(n, -1), np.full(n, -1)
    depth, level = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(signs):
        pair[signs] = np.where(match >= 0, local[match], -1)
        head[signs] = np.where(ended >= 0, local[ended] + 1, 0)
        after = np.cumsum(is_sign) - is_sign  # brackets before each token
        parent = np.where(after > begin, np.where(inner >= 0, local[inner], -1)[after - 1], -1)
        code = start[0][signs].astype(np.int64)
        opens = np.where(match < 0, 0, np.where(match > np.arange(len(signs)), 1, -1))
        for x, step in ((depth, (code == ord("{")).astype(np.int64) - (code == ord("}"))), (level, opens)):
            total = np.concatenate([[0], np.cumsum(step)])
            x[:] = total[after] - total[begin]
    # A closing bracket lies beside the one that it matches.
    closing = np.flatnonzero((pair >= 0) & (pair < place))
    for x in (parent, level):
        x[closing] = x[pair[closing] + first[closing]]
    line = 1 + lines[:-1] - lines[first]
    columns = [place, NAMES.take(pa.array(kind)), flat, line, at[:-1] - np.maximum(line_begin, at[first]) + 1, line + np.diff(lines), depth, level, parent, pair, head]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, ARROW[t]) for c, (_, t) in zip(columns, FIELDS)]
    structs = pa.StructArray.from_arrays(arrays, fields=[pa.field(f, ARROW[t]) for f, t in FIELDS])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)


def slices(tokens: pa.ListArray, most: int = MOST) -> Iterator[tuple[int, int]]:
    """The rows [begin, end) that are placed together: cut where the tokens before a row pass a multiple of ``most``."""
    starts = tokens.offsets.to_numpy()[:-1].astype(np.int64)
    cuts = (np.flatnonzero(np.diff((starts - starts[:1]) // most)) + 1).tolist()
    yield from zip([0, *cuts], [*cuts, len(tokens)])


def token_arrays(files: DataFrame, pattern) -> DataFrame:
    """(path, lang, text, tokens) of ``files``; ``pattern`` gives a language's expression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rust = pc.fill_null(pc.equal(b.column(1), "rust"), False).to_numpy(zero_copy_only=False)
            for begin, end in slices(b.column(3)):
                own = b.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*own.columns[:3], placed(own.column(3), rust[begin:end])], ["path", "lang", "text", "tokens"])

    ship(files.sparkSession)
    rust, script = (F.regexp_extract_all("text", F.lit(f"({pattern(x)})"), F.lit(1)) for x in ("rust", "typescript"))
    rows = files.select("path", "lang", "text", F.when(F.col("lang") == "rust", rust).otherwise(script).alias("parts"))
    return rows.mapInArrow(run, f"path string, lang string, text string, tokens array<{TOKEN}>")


def code_only(tokens: Column) -> Column:
    """Without blanks and comments; ``i``, ``parent`` and ``pair`` still number all tokens."""
    return F.filter(tokens, lambda t: ~t["kind"].isin("blank", "comment", "doc_comment"))


def neighbours(tokens: Column, *, before: int = 0, after: int = 0) -> Column:
    """Each token with the texts of those around it, null beyond the ends: fields ``b1`` ..., ``a1`` ...
    and ``t`` for the token itself."""

    def each(t: Column, i: Column) -> Column:
        near = lambda k: F.when(i + k >= 0, F.get(tokens, i + k)["text"])
        return F.struct(t.alias("t"), *[near(-k).alias(f"b{k}") for k in range(1, before + 1)], *[near(k).alias(f"a{k}") for k in range(1, after + 1)])

    return F.transform(tokens, each)
