"""Review by a model: candidates, clusters, verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import keyed, let, strip_control
from corpusmill.shared import written


def capped(candidates: DataFrame, most: int, order: tuple[str, ...] = ("path", "line", "column", "rule_id")) -> DataFrame:
    """Adds ``sent``: the first ``most`` candidates in order go to the model, the
    rest are returned unverified. The limit is that of a budget for calls; it is
    found by a top-k, not by ordering all."""
    candidates = written(candidates)  # found once; the limit's place, its ties and the result all start from the files
    first = candidates.select(*order).orderBy(*order).limit(most)
    last = first.agg(F.max(F.struct(*order)).alias("last"), F.count("*").alias("n")).first()
    if last["n"] < most:
        return candidates.withColumn("sent", F.lit(True))
    bound = F.struct(*[F.lit(last["last"][c]).cast(candidates.schema[c].dataType).alias(c) for c in order])
    ties = Window.partitionBy(*order).orderBy(F.lit(1))
    below = F.struct(*order) < bound
    room = most - candidates.where(below).count()
    edge = candidates.where(F.struct(*order) == bound).withColumn("sent", F.row_number().over(ties) <= room)
    return candidates.where(F.struct(*order) != bound).withColumn("sent", below).unionByName(edge)


def islands(at: DataFrame, reach: int) -> DataFrame:
    """(path, cluster, start, end, n): windows of ``reach`` lines around places in a
    file, merged where they touch."""
    w = Window.partitionBy("path").orderBy("line", "column")
    before = F.max(F.col("line") + reach).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = at.withColumn("new", F.when(F.greatest(F.col("line") - reach, F.lit(1)) <= before, 0).otherwise(1))
    told = opened.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return told.groupBy("path", "cluster").agg(F.greatest(F.min("line") - reach, F.lit(1)).alias("start"), F.max(F.col("line") + reach).alias("end"), F.count("*").alias("n"))


def clusters(at: DataFrame, reach: int = 25, most: int = 8, most_lines: int = 200) -> DataFrame:
    """As ``islands``, but a cluster holds up to ``most`` places and ``most_lines``
    lines. That makes it a greedy walk over the lines of an island in order, as a fold:
    no cluster crosses an island, and an island lies in one file."""
    w = Window.partitionBy("path").orderBy("line", "column")
    before = F.max(F.col("line") + reach).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = at.select("path", "line", "column").withColumn("new", F.when(F.greatest(F.col("line") - reach, F.lit(1)) <= before, 0).otherwise(1))
    told = opened.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    long = lambda x: F.lit(x).cast("long")

    def step(s: Column, line: Column) -> Column:
        low, high = F.greatest(line - reach, long(1)), line + reach
        fits = (s["n"] > 0) & (low <= s["end"]) & (s["n"] < most) & (high - s["start"] + 1 <= most_lines)
        ended = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["n"].alias("n")))
        return F.struct(
            F.when(fits, s["start"]).otherwise(low).alias("start"), F.when(fits, F.greatest(s["end"], high)).otherwise(high).alias("end"),
            F.when(fits, s["n"] + 1).otherwise(long(1)).alias("n"), F.when(fits | (s["n"] == 0), s["out"]).otherwise(F.concat(s["out"], ended)).alias("out"),
        )

    none = F.struct(long(0).alias("start"), long(0).alias("end"), long(0).alias("n"), F.array().cast("array<struct<start:bigint,end:bigint,n:bigint>>").alias("out"))
    last = lambda s: F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["n"].alias("n"))))
    places = told.groupBy("path", "island").agg(F.sort_array(F.collect_list(F.col("line").cast("long"))).alias("lines"))
    return places.select("path", F.explode(F.aggregate("lines", none, step, last)).alias("c")).select("path", "c.*")


def verdict_keys(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("key", keyed(F.col("rule_id"), F.col("path"), F.col("line"), F.col("matched_text"), F.col("context")))


def confirmed(candidates: DataFrame, verdicts: DataFrame, threshold: float | None = None) -> DataFrame:
    """Joins stored verdicts (key, is_issue, probability, reason). A verdict that
    says no drops the candidate; one with an invalid probability, or none at all,
    keeps it. The threshold is applied here, after storage, so that it can change."""
    v = verdicts.select(F.col("key").alias("_k"), "is_issue", "probability", F.col("reason").alias("_reason"))
    out = candidates.join(v, F.col("key") == F.col("_k"), "left")
    sound = F.col("probability").between(0.0, 1.0) & ~F.isnan("probability")
    yes = F.coalesce("is_issue", F.lit(True)) if threshold is None else F.when(F.coalesce(sound, F.lit(False)), F.col("probability") >= threshold).otherwise(True)
    status = F.when(F.col("_k").isNull(), "unverified").when(~F.coalesce(sound, F.lit(False)), "invalid").otherwise("confirmed")
    return out.where(yes).withColumn("status", status).withColumn("reason", strip_control(F.col("_reason"))).drop("_k", "_reason", "is_issue")


def asked(candidates: DataFrame, model) -> DataFrame:
    """Verdicts from ``model(texts) -> probabilities``, called on batches of prompts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = pd.Series(model(pdf["prompt"].tolist()), dtype=float)
            yield pd.DataFrame({"key": pdf["key"], "is_issue": p >= 0.5, "probability": p, "reason": ""})

    return candidates.select("key", "prompt").mapInPandas(run, "key string, is_issue boolean, probability double, reason string")


def gated(candidates: DataFrame, builtin: DataFrame, allow_external: bool = False) -> DataFrame:
    """The candidates that may be sent to a model: those of built-in rules (rule_id), and of others only if
    they are allowed."""
    return candidates if allow_external else candidates.join(builtin.select("rule_id").distinct(), "rule_id", "left_semi")


#: Bytes of source that are sent with a question.
MOST_BYTES = 64 * 1024


def cut_at_line(text: Column, most: int = MOST_BYTES) -> Column:
    """The text, or what lies before the last line end of its first ``most`` bytes; without a line end there, as many
    whole characters as these bytes hold."""
    data = text.cast("binary")
    part = lambda k: F.substring(data, 1, most - k).cast("string")
    # A character has up to four bytes.
    whole = F.coalesce(*[F.when(F.is_valid_utf8(part(k)), part(k)) for k in range(4)], F.lit(""))
    before = let(whole, lambda x: F.when(F.instr(x, "\n") > 0, F.substring(x, F.lit(1), F.length(x) - F.length(F.substring_index(x, "\n", -1)) - 1)).otherwise(x))
    return F.when(F.octet_length(data) <= most, text).otherwise(before)


def states(candidates: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Adds ``state``, the numbered ``region`` with its tags escaped, cut and in tags of its own, and whether
    it was ``truncated``."""
    safe = F.replace(F.replace(F.col("region"), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = candidates.withColumn("_safe", safe)
    told = F.concat(F.lit("<code>\n"), cut_at_line(F.col("_safe"), most), F.lit("\n</code>"))
    return rows.withColumn("state", told).withColumn("truncated", F.octet_length("_safe") > most).drop("_safe")


def prompts(candidates: DataFrame, template: str) -> DataFrame:
    """Fills a template's {rule}, {file} and {code}; tags in the code are escaped
    and the code is filled in last, so that it can't fill in anything itself."""
    code = F.replace(F.replace(F.col("context"), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    out = F.lit(template)
    for name, value in (("{rule}", F.col("rule_id")), ("{file}", F.col("path")), ("{code}", F.concat(F.lit("<code>\n"), code, F.lit("\n</code>")))):
        out = F.replace(out, F.lit(name), value)
    return candidates.withColumn("prompt", out)
