"""Quality rules by cross-document line frequency, on DataFrame functions only.

Every line with a word is normalised (lower case, runs of white space as one
space, trimmed) and hashed. A line is above the limit in a host if more than
``max(min_docs, max_share * documents of the host)`` distinct documents of the
host hold it. Lines above the limit are removed; a document whose removed words
exceed ``max_removed`` of its words, or that keeps fewer than ``min_words`` words,
is depleted and rejected.

``count`` says what is a distinct document: ``documents`` tells them by id, so
that a line counts as often as it was copied; ``texts`` counts exact copies once;
``near_copies`` counts near copies (five-word shingles, similarity 0.8 or more)
once, so that a large group of copies isn't taken for boilerplate, but left for
de-duplication to settle.

Defined cases: null text counts as an empty text; a null host is a host of its
own; repeated rows get equal results and count as one document; rows with a null
id are told apart by their text; an empty table gives an empty result; a very long
text is one row like any other, whose windows are found by sorting, in n log n;
other columns pass through ``clean_documents`` unchanged, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import near_copies as near
from corpusmill.llm.names import columns, fresh, quoted
from corpusmill.llm.rows import repeated
from corpusmill.shared import scratch, shared_dir, written

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    min_docs: int = 20
    max_share: float = 0.02
    max_removed: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def text_key(text: Column) -> Column:
    """16 bytes that tell texts apart."""
    return F.unhex(F.md5(text))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def normalised(words: Column) -> Column:
    """The hash of a line, from its words."""
    return F.xxhash64(F.lower(F.array_join(words, " ")))


def _covered(at: Column) -> Column:
    """Positions within the 3-word windows that start at the sorted ``at``."""
    gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda x, y: x + y)


def _doubled(placed: Column) -> Column:
    """Positions of windows that have an equal; ``placed`` is sorted by hash."""
    either = lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"]))
    pairs = F.filter(F.zip_with(placed, F.slice(placed, 2, F.size(placed)), either), lambda x: x.isNotNull())
    return F.sort_array(F.array_distinct(F.flatten(pairs)))


def _host(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("h:"), F.col(quoted(name)).cast("string")), F.lit("none"))


def profiles(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One narrow row per document: base counts, and its distinct line hashes
    with the words that each stands for. Equal 3-word windows are found by
    sorting their hashes, so the work is n log n in the length of a text."""
    t = F.coalesce(F.col("t"), F.lit(""))
    m = F.size("grams")
    read = docs.select(F.col(quoted(doc_id)).alias("id"), _host(host).alias("host"), F.col(quoted(text)).alias("t"))
    lined = read.select(
        "id", "host", text_key(F.col("t")).alias("text_key"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("raw"),
        F.when(t.rlike(f"[{SYMBOLS}]"), F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
    )
    worded = lined.select(
        "id", "host", "text_key", "n_symbols", F.transform("raw", _words).alias("by_line"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
    )
    flat = worded.select(
        "id", "host", "text_key", "n_symbols", "n_dup_lines", F.flatten("by_line").alias("words"),
        F.transform("by_line", lambda x: F.struct(normalised(x).alias("hash"), F.size(x).alias("words"))).alias("lines"),
    )
    coded = flat.select(
        "id", "host", "text_key", "n_symbols", "n_dup_lines", "lines", F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
    )
    n = F.size("codes")
    pairs = F.zip_with("codes", F.slice("codes", 2, n), lambda a, b: F.xxhash64(a, b))
    grams = F.slice(F.zip_with(pairs, F.slice("codes", 3, n), lambda a, b: F.xxhash64(a, b)), 1, n - 2)
    hashed = coded.select(
        "id", "host", "text_key", "n_symbols", "n_dup_lines", "lines", "word_chars", n.cast("long").alias("n_words"),
        F.when(n >= 4, grams).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    kept = ["id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "lines"]
    placed = F.sort_array(F.zip_with("grams", F.sequence(F.lit(0), m - 1), lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    doubles = hashed.select(*kept, F.when(F.size(F.array_distinct("grams")) < m, placed).alias("placed"))
    at = doubles.select(*kept, F.when(F.col("placed").isNotNull(), _let(F.col("placed"), _doubled)).alias("at"))
    return at.select(*kept, F.when(F.col("at").isNotNull(), _let(F.col("at"), _covered)).otherwise(0).cast("long").alias("n_repeat_words"))


def counted_as(prof: DataFrame, count: str, groups: DataFrame | None = None) -> DataFrame:
    """(host, document, lines): what counts as one document has one ``document``;
    ``groups`` (text_key, near) says which texts are near copies."""
    if count == "documents":
        document = F.struct(F.col("id"), F.when(F.col("id").isNull(), F.col("text_key")).alias("text_key"))
        return prof.select("host", document.alias("document"), "lines")
    if count == "texts":
        return prof.select("host", F.col("text_key").alias("document"), "lines")
    if count == "near_copies":
        own = prof.withColumn("text_key", F.coalesce("text_key", text_key(F.lit(""))))
        return written(own.join(groups, "text_key").select("host", F.col("near").alias("document"), "lines"))
    raise ValueError(f"documents can't be counted by {count}")


def frequent_lines(rows: DataFrame, limits: Limits) -> DataFrame:
    """(host, hash, docs) of the lines above the host's limit. Both counts are of
    distinct documents; a first grouping by document makes the second one free of
    hot keys, and both combine before they shuffle."""
    host_docs = rows.select("host", "document").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    held = rows.select("host", "document", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash"))
    docs = held.distinct().groupBy("host", "hash").agg(F.count("*").alias("docs")).where(F.col("docs") > limits.min_docs)
    return docs.join(host_docs, "host").where(F.col("docs") > limits.max_share * F.col("host_docs")).select("host", "hash", "docs")


def verdicts(prof: DataFrame, limits: Limits = Limits(), count: str = "documents", groups: DataFrame | None = None) -> DataFrame:
    """A row per document: base counts, removed lines and words, verdict."""
    lines = prof.select("id", "host", "text_key", F.explode("lines").alias("x")).select("id", "host", "text_key", F.col("x.hash").alias("hash"), F.col("x.words").alias("words"))
    own = lines.groupBy("id", "host", "text_key", "hash").agg(F.max("words").alias("line_words"), F.count("*").alias("times"))
    rows = prof.groupBy("id", "host", "text_key").agg(F.count("*").alias("rows"), *[F.max(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
    # Written, so that the join is by broadcast if Spark finds them small, and of two plain shuffles that it can split if not.
    hit = own.join(written(frequent_lines(counted_as(prof, count, groups), limits)), ["host", "hash"])
    removed = hit.groupBy("id", "host", "text_key").agg(
        F.sum(F.col("line_words") * F.col("times")).alias("removed_words"), F.sum("times").alias("removed_lines"), F.collect_set("hash").alias("removed_hashes")
    )
    r = removed.select(F.col("id").alias("rid"), F.col("host").alias("rhost"), F.col("text_key").alias("rkey"), "removed_words", "removed_lines", "removed_hashes")
    on = rows["id"].eqNullSafe(r["rid"]) & (rows["host"] == r["rhost"]) & rows["text_key"].eqNullSafe(r["rkey"])
    gone = lambda c: F.coalesce(F.floor(F.col(c) / F.col("rows")), F.lit(0)).cast("long")
    base_failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    out = rows.join(r, on, "left").select(
        "id", "host", "text_key", "rows", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        gone("removed_words").alias("removed_words"), gone("removed_lines").alias("removed_lines"), "removed_hashes", base_failed.alias("base_failed"),
    )
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > limits.max_removed * F.col("n_words")) | (left < limits.min_words)
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def line_quality(docs: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", host: str = "source", count: str = "documents") -> DataFrame:
    """A row per row of ``docs``: id, base counts, removed lines and words,
    ``base_failed`` and ``kept``. The texts are read once; what follows works on
    the narrow profiles, written in the shared folder."""
    groups = near.groups(docs, text) if count == "near_copies" else None
    out = verdicts(written(profiles(docs, doc_id, text, host)), limits, count, groups)
    once = out.where("rows = 1").drop("removed_hashes")
    more = repeated(out.where("rows > 1").drop("removed_hashes"), "rows")
    return once.drop("rows").unionByName(more).withColumnRenamed("id", doc_id)


def clean_documents(docs: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", host: str = "source", n_chars: str = "n_chars", count: str = "documents") -> DataFrame:
    """The kept documents with the lines above the limits taken out; the columns
    of ``docs``, with ``n_chars``, if there is one, brought up to date where a text
    changed. The texts are joined with what is rejected or changed alone."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/changed"
    with scratch(spark):
        groups = near.groups(docs, text) if count == "near_copies" else None
        v = verdicts(written(profiles(docs, doc_id, text, host)), limits, count, groups)
        v = v.where("not kept or removed_hashes is not null")
        changed = written(v.select("id", "host", "text_key", "kept", F.when(F.col("kept"), F.col("removed_hashes")).alias("hashes")), path)
    name = fresh(docs.columns, "verdict")
    changed = changed.select(F.struct("*").alias(name))
    body, size = F.col(quoted(text)), quoted(n_chars)
    on = F.col(quoted(doc_id)).eqNullSafe(F.col(f"{name}.id")) & (_host(host) == F.col(f"{name}.host")) & text_key(body).eqNullSafe(F.col(f"{name}.text_key"))
    gone = F.col(f"{name}.hashes")
    keep = F.filter(F.split(body, "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(gone, normalised(_words(x)))))
    out = docs.join(changed, on, "left").where(F.coalesce(F.col(f"{name}.kept"), F.lit(True)))
    out = out.withColumn(text, F.when(gone.isNull(), body).otherwise(F.array_join(keep, "\n")))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(gone.isNull(), F.col(size)).otherwise(F.length(body).cast(docs.schema[n_chars].dataType)))
    return out.select(*columns(docs.columns))
