"""Fixes of whole files, round by round until nothing changes.

An edit is a byte range of a file, from 0 on, and what takes its place; edits come in
groups that are made whole or not at all. Ranges can be protected from a rule. A file's
matches, protected ranges and edits are arrays in its row, so a round is one narrow
transformation: nothing is shuffled, texts stay where they are, and only the files
that the last round changed are looked at again. Each round is written in the
shared folder, so that a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.functions.text import let
from corpusmill.operators.findings import file_findings, hashed, suppressed
from corpusmill.operators.tokens import slices
from corpusmill.plans.rules import Rule
from corpusmill.shared import written
from corpusmill.ship import ship

EDIT = "struct<position:bigint,deleted:bigint,inserted:string>"
GROUPS = f"array<struct<at:bigint,seq:bigint,edits:array<{EDIT}>>>"
RANGES = "array<struct<rule_id:string,start:bigint,end:bigint>>"


def fixable(rules: Sequence[Rule], unsafe: bool = False, own: Sequence[Rule] = (), trust_own: bool = False) -> list[Rule]:
    """The rules that may rewrite: those with a replacement, if it is safe or ``unsafe`` is
    asked for; rules of the user's ``own`` only if they are trusted."""
    return [r for r in [*rules, *(own if trust_own else ())] if r.replacement is not None and (unsafe or not r.unsafe)]


def matched(files: DataFrame, rules: Sequence[Rule], context: int | None = None) -> DataFrame:
    """``files`` (path, lang, text, ...) with ``found``: the matches of all rules, in the order of lines,
    rules and places, with their byte ranges [start, end) in the file."""
    rows = file_findings(files.withColumn("_source", F.col("text")), rules, context)
    rest = [c for c in rows.columns if c not in ("findings", "_source")]
    before = lambda m: F.when(m["line"] == 1, F.lit(0)).otherwise(F.octet_length(F.call_function("substring_index", F.col("_source"), F.lit("\n"), (m["line"] - 1).cast("int"))) + 1)
    more = lambda m: [] if context is None else [m["context"].alias("context")]

    def placed(m: Column) -> Column:
        return let(
            before(m).cast("long"),
            lambda b: F.struct(
                m["rule_id"].alias("rule_id"), m["line"].alias("line"), (b + m["column"] - 1).alias("start"), (b + m["end_column"] - 1).alias("end"),
                m["matched_text"].alias("matched_text"), (m["seq"] % len([r for r in rules if r.pattern])).alias("seq"), *more(m),
            ),
        )

    return rows.select(*rest, F.col("_source").alias("text"), F.transform("findings", placed).alias("found"))


def protected_ranges(files: DataFrame, rules: Sequence[Rule], directives: DataFrame | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """(path, rule_id, start, end): the matches, in the files as they are, that a directive (path,
    target_line, rule_id) switches off or a baseline (hash) holds."""
    rows = matched(files, rules, None if baseline is None else 2).select("path", F.explode_outer("found").alias("f")).where("f is not null").select("path", "f.*")
    rows = written(rows)
    parts = []
    if directives is not None:
        key = ["path", "rule_id", "line", "start"]
        parts.append(rows.join(suppressed(rows, directives).select(*key), key, "left_anti"))
    if baseline is not None:
        parts.append(hashed(rows).join(baseline.select("hash").distinct(), "hash", "left_semi"))
    if not parts:
        raise ValueError("neither directives nor a baseline")
    out = parts[0].select("path", "rule_id", "start", "end")
    for p in parts[1:]:
        out = out.unionByName(p.select("path", "rule_id", "start", "end"))
    return out.distinct()


CHOSEN = f"struct<edits:array<{EDIT}>,seqs:array<bigint>>"


def _ends(lists: pa.ListArray) -> np.ndarray:
    """Where each row's items begin among all of ``lists.flatten()``, and the end of the last."""
    at = lists.offsets.to_numpy().astype(np.int64)
    return at - at[0]


def _taken(groups: list[tuple[int, int, list[tuple[int, int, str, int]]]], size: int) -> tuple[list[int], list[int]]:
    """The greedy walk over one file's groups (at, seq, edits), an edit being (position, deleted, inserted, its number): the
    numbers of the edits taken, by position, and the groups' ``seq``. ``near`` keeps what later groups can still clash with."""
    near, out, seqs = [], [], []
    for at, seq, edits in sorted(groups):
        if not edits or any(p < 0 or p + d > size for p, d, *_ in edits):
            continue
        near = [k for k in near if k[0] >= at or k[1] > at]
        if not any(p == kp or (p < ke and kp < p + d) for p, d, *_ in edits for kp, ke in near):
            near += [(p, p + d) for p, d, *_ in edits]
            out += edits
            seqs.append(seq)
    return [e[3] for e in sorted(out)], seqs


def _chosen(groups: pa.Array, sizes: pa.Array) -> pa.Array:
    ends, flat = _ends(groups), groups.flatten()
    at, seq, edits = (flat.field(k) for k in ("at", "seq", "edits"))
    cuts, each = _ends(edits).tolist(), edits.flatten()
    at, seq, size = at.to_pylist(), seq.to_pylist(), sizes.to_pylist()
    edit = list(zip(*[each.field(k).to_pylist() for k in ("position", "deleted", "inserted")], range(len(each))))
    kept, seqs, kept_ends, seq_ends = [], [], [0], [0]
    for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        if a < b:
            numbers, names = _taken([(at[g], seq[g], edit[cuts[g] : cuts[g + 1]]) for g in range(a, b)], size[row])
            kept += numbers
            seqs += names
        kept_ends.append(len(kept))
        seq_ends.append(len(seqs))
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    return pa.StructArray.from_arrays([lists(kept_ends, each.take(pa.array(kept, pa.int64()))), lists(seq_ends, pa.array(seqs, pa.int64()))], ["edits", "seqs"])


def without_conflicts(groups: Column, size: Column) -> Column:
    """The ``edits`` of the groups that are taken, by position, and these groups' ``seqs``. A greedy walk in
    order of the groups' first positions, then ``seq``: a group is taken if it lies within
    ``size`` bytes and none of its edits clashes with one taken before. A small helper walks, as a fold of columns would
    copy what it has taken at every step. ``groups`` has to be a plain column."""

    def chosen(groups: pa.Array, sizes: pa.Array) -> pa.Array:
        return _chosen(groups, sizes)

    ship(SparkSession.active())
    return F.arrow_udf(chosen, CHOSEN)(groups, size.cast("long"))


def spliced(text: Column, edits: Column) -> Column:
    """``text`` with edits that don't clash, in the order of their positions: the pieces between them are
    cut out of the bytes once each. A result that isn't UTF-8 leaves the text as it is."""

    def put(data: Column) -> Column:
        ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(edits, lambda e: e["position"] + e["deleted"]))
        pieces = F.zip_with(edits, F.slice(ends, F.lit(1), F.size(edits)), lambda e, b: F.concat(F.substring(data, (b + 1).cast("int"), (e["position"] - b).cast("int")).cast("string"), e["inserted"]))
        tail = F.substring(data, (F.element_at(ends, -1) + 1).cast("int"), F.octet_length(data)).cast("string")
        return F.concat(F.array_join(pieces, ""), tail)

    return let(let(text.cast("binary"), put), lambda out: F.when(F.is_valid_utf8(out), out).otherwise(text))


def _moved(ranges: pa.Array, edits: pa.Array) -> pa.Array:
    """Ranges after ``edits`` that don't clash, by position: those behind an edit move by its change in length, those that it
    touches grow to what it put in, so that they go on protecting what they held. Both are looked up in
    sums over the edits, which a range needn't go through."""
    flat, each = ranges.flatten(), edits.flatten()
    ends, cuts = _ends(ranges), _ends(edits)
    start, end, position = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (flat.field("start"), flat.field("end"), each.field("position")))
    stop = position + each.field("deleted").to_numpy(zero_copy_only=False).astype(np.int64)
    added = pc.binary_length(each.field("inserted")).to_numpy(zero_copy_only=False).astype(np.int64)
    change = np.concatenate([[0], np.cumsum(added - (stop - position))])
    for row in np.flatnonzero((np.diff(ends) > 0) & (np.diff(cuts) > 0)).tolist():
        own, (a, b) = slice(ends[row], ends[row + 1]), cuts[row : row + 2]
        behind = a + np.searchsorted(stop[a:b], start[own], "right")
        touched = np.maximum(behind, a + np.searchsorted(position[a:b], end[own], "left"))
        some = touched > behind
        low, high = np.minimum(start[own], position[np.minimum(behind, b - 1)]), np.maximum(end[own], stop[touched - 1])
        start[own], end[own] = np.where(some, low, start[own]) + change[behind] - change[a], np.where(some, high, end[own]) + change[touched] - change[a]
    rows = pa.StructArray.from_arrays([flat.field("rule_id"), pa.array(start), pa.array(end)], ["rule_id", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def _groups(rules: Sequence[Rule]) -> Column:
    """A group per match of a rule that no range protected from this rule overlaps; ``seq`` is the
    rule's place in the list."""
    new = F.array(*[F.lit(r.replacement) for r in rules])
    free = F.filter("found", lambda m: ~F.exists("protected", lambda p: (p["rule_id"] == m["rule_id"]) & (m["start"] < p["end"]) & (p["start"] < m["end"])))
    edit = lambda m: F.struct(m["start"].alias("position"), (m["end"] - m["start"]).alias("deleted"), F.element_at(new, (m["seq"] + 1).cast("int")).alias("inserted"))
    return F.transform(free, lambda m: F.struct(m["start"].alias("at"), m["seq"].alias("seq"), F.array(edit(m)).alias("edits")))


def one_round(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rows`` (path, lang, text, protected, ...) after one round, with the edits made and their number."""
    rules = fixable(rules, unsafe=True)
    rest = [c for c in rows.columns if c not in ("text", "protected")]
    found = matched(rows, rules)
    grouped = found.select(*rest, "text", "protected", _groups(rules).alias("groups"), F.octet_length("text").cast("long").alias("size"))
    kept = len(rest) + 1
    told = StructType([*grouped.schema.fields[:kept], *StructType.fromDDL(f"protected {RANGES}, edits array<{EDIT}>, n bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(kept + 1)):
                b = batch.slice(begin, end - begin)
                edits, seqs = _chosen(b.column(kept + 1), b.column(kept + 2)).flatten()
                yield pa.RecordBatch.from_arrays([*b.columns[:kept], _moved(b.column(kept), edits), edits, pc.list_value_length(seqs).cast(pa.int64())], told.fieldNames())

    ship(rows.sparkSession)
    chosen = grouped.mapInArrow(run, told)
    return chosen.select(*rest, spliced(F.col("text"), F.col("edits")).alias("text"), "protected", "edits", "n")


def with_protected(files: DataFrame, protected: DataFrame | None) -> DataFrame:
    """``files`` with the ranges of each as an array ``protected``."""
    none = F.array().cast(RANGES)
    if protected is None:
        return files.withColumn("protected", none)
    held = protected.groupBy("path").agg(F.collect_list(F.struct("rule_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("protected"))
    return files.join(held, "path", "left").withColumn("protected", F.coalesce("protected", none))


def fixed(files: DataFrame, rules: Sequence[Rule], protected: DataFrame | None = None, max_rounds: int = 10) -> DataFrame:
    """(path, lang, text, protected, n_fixes, rounds, settled) of every file: rewritten until a round changes
    nothing, or ``max_rounds`` times; ``settled`` says which. ``rounds`` counts those that changed something."""
    long = lambda x: F.lit(x).cast("long")
    rows = with_protected(files.select("path", "lang", "text"), protected).select("*", long(0).alias("n_fixes"), long(0).alias("rounds"))
    done = []
    for k in range(max_rounds):
        after = written(one_round(rows, rules).select("path", "lang", "text", "protected", (F.col("n_fixes") + F.col("n")).alias("n_fixes"), (F.col("rounds") + (F.col("n") > 0).cast("long")).alias("rounds"), "n"))
        done.append(after.where("n = 0").drop("n").withColumn("settled", F.lit(True)))
        rows = after.where("n > 0").drop("n")
        if not rows.take(1):
            break
    else:
        done.append(rows.withColumn("settled", F.lit(False)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def chosen_groups(edits: DataFrame) -> DataFrame:
    """(path, group, position, deleted, inserted) of the groups that are taken, of rows with these
    columns: within a file by their first positions, then by name of the group. Groups are folded by
    stretches of a file that none of its groups crosses, so that a fold stays short."""
    by_group = edits.groupBy("path", "group").agg(
        F.min("position").cast("long").alias("at"), F.max(F.col("position") + F.col("deleted")).cast("long").alias("end"),
        F.array_sort(F.collect_list(F.struct(F.col("position").cast("long").alias("position"), F.col("deleted").cast("long").alias("deleted"), F.col("inserted").cast("string").alias("inserted")))).alias("edits"),
    )
    order = Window.partitionBy("path").orderBy("at", "group")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = by_group.withColumn("new", (F.col("at") > F.coalesce(before, F.lit(-1).cast("long"))).cast("int")).withColumn("seq", F.row_number().over(order).cast("long"))
    told = opened.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    folded = told.groupBy("path", "stretch").agg(F.collect_list(F.struct("at", "seq", "edits")).alias("groups"), F.collect_list(F.struct("at", "seq", "group", "edits")).alias("named"))
    taken = folded.select("path", "named", without_conflicts(F.col("groups"), F.lit(2**62)).alias("c"))
    own = taken.select("path", F.explode(F.filter("named", lambda g: F.array_contains("c.seqs", g["seq"]))).alias("g")).select("path", "g.group", F.explode("g.edits").alias("e"))
    return own.select("path", "group", "e.position", "e.deleted", "e.inserted")
