"""Mixing sources to target weights by hierarchical budgeting, on DataFrame
functions only.

A tree of domain, language and source gets a token budget at its root. Each
node's budget is split among its children by weight. A child that can't use its
share, as its tokens times ``max_epochs`` fall short, is filled, and what it
leaves is dealt to its siblings by weight until all of them are full; only then
does the node itself count as full and leave the rest to its own siblings, and
so on upwards. This is water filling: children ordered by capacity over weight
fill up one by one while the level that the rest would reach exceeds them, which
one pass of running sums finds. Budgets are whole tokens: children that aren't
full get the differences of the rounded running sums, so that they add up to
what their parent has, and the mixture to the budget of the root.

A leaf reads its documents in whole epochs and then a prefix of one more epoch.
An epoch's order is by the MD5 of seed, epoch and id. Running token counts are
taken first over slices of the order, by aggregation, and then inside the one
slice in which the budget ends, so that no leaf is ordered in one task, however
large it is. What comes out is a row per leaf: where its prefix ends. The
document in which the budget ends is the last one taken; ``take_tokens`` says
how much of it the budget covers.

Running sums over the nodes of a level are taken in two steps as well, in ranges
and over ranges, so that a language with millions of sources needs no single task.

Defined cases: null text has no tokens and is never taken; null sources or
languages are a leaf of their own; weights default to 1 and count in millionths;
a weight of 0 leaves a node out, as does a budget of 0; equal ids tie by the text's
hash; of repeated rows at the boundary as many are taken as the budget covers; an
empty table makes an empty mixture; a very long text is one document like any other,
and taken in part if the budget ends in it; extra columns, whatever their names,
stay with ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.names import columns, fresh, quoted
from corpusmill.llm.rows import numbers, repeated
from corpusmill.shared import written

SPACE = r"[\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
SLICE = 3  # hex digits of a slice's name: 4096 slices a leaf


def default_domain(source: Column) -> Column:
    """Sources are grouped by the last digit of their name, if they have one."""
    return F.coalesce(F.concat(F.lit("domain"), F.nullif(F.regexp_extract(source, "([0-9])$", 1), F.lit("")).cast("int") % 4), F.lit("other"))


def tokens(text: Column) -> Column:
    """White-space words."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def leaf_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain: Column | None = None) -> DataFrame:
    """(domain, lang, source, id, text_key, n_tokens) per row with a token."""
    where = default_domain(F.col(quoted(source))) if domain is None else domain
    named = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit("(none)"))
    body = F.col(quoted(text))
    out = docs.select(where.alias("domain"), named(lang).alias("lang"), named(source).alias("source"), F.col(quoted(doc_id)).alias("id"), F.md5(body).alias("text_key"), tokens(F.coalesce(body, F.lit(""))).alias("n_tokens"))
    return out.where("n_tokens > 0")


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    """In millionths, so that sums of weights are exact. A weight too small for that is refused."""
    out = F.lit(1_000_000)
    for name, w in weights.get(level, {}).items():
        if w < 0 or w > 0 and not round(w * 1_000_000):
            raise ValueError(f"weight {w} of {level} {name}: 0, or a millionth at least")
        out = F.when(F.col(level) == name, round(w * 1_000_000)).otherwise(out)
    return out.cast("long")


def running(rows: DataFrame, by: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """``rows`` with ``<name>_before`` for each of ``sums``: the sum over the rows of
    the same ``by`` that come earlier in ``order``. Ranges of rows are summed in their
    own tasks; a row per range gives what lies before it."""
    ranged = written(rows.repartitionByRange(*by, *order).withColumn("range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "range").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_start") for c in sums])
    inside = Window.partitionBy(*by, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    told = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_inside") for c in sums])
    out = told.join(starts, [*by, "range"])
    return out.select(*rows.columns, *[(F.col(f"{c}_start") + F.col(f"{c}_inside")).alias(f"{c}_before") for c in sums])


def filled(nodes: DataFrame, above: list[str], level: str) -> DataFrame:
    """Splits each parent's ``share`` among its children by ``weight``, none above
    its ``capacity``; adds the children's ``budget``. All in whole numbers."""
    large = lambda x: x.cast("decimal(19,0)")
    nodes = nodes.where("weight > 0").withColumn("ratio", F.col("capacity") / F.col("weight"))
    whole = nodes.groupBy(*above).agg(F.sum("weight").alias("weights"))
    put = written(running(nodes, above, ["ratio", level], ["capacity", "weight"]).join(whole, above))
    rest, left = F.col("weights") - F.col("weight_before"), F.col("share") - F.col("capacity_before")
    put = put.withColumn("full", large(F.col("capacity")) * large(rest) <= large(left) * large(F.col("weight")))
    # Where the first child that isn't full stands.
    first = F.min(F.struct("ratio", level, "capacity_before", "weight_before"))
    edges = put.where("not full").groupBy(*above).agg(first.alias("first")).select(*above, F.col("first.capacity_before").alias("filled"), F.col("first.weight_before").alias("used"))
    dealt = put.join(edges, above, "left")

    def reached(weight: str) -> Column:
        return F.expr(f"(cast(share - filled as decimal(19,0)) * cast({weight} - used as decimal(19,0))) div cast(weights - used as decimal(19,0))")

    budget = F.when(F.col("full"), F.col("capacity")).otherwise(reached("weight_before + weight") - reached("weight_before"))
    return dealt.select(*nodes.drop("ratio", "share").columns, budget.alias("budget"))


def budgets(leaves: DataFrame, budget: float, max_epochs: int, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(domain, lang, source, leaf_tokens, budget) from (domain, lang, source,
    leaf_tokens). ``budget`` is a share of all tokens."""
    w = {x: _weight(x, weights) for x in LEVELS}
    rooted = leaves.withColumn("root", F.lit(0))
    sources = rooted.withColumn("capacity", F.col("leaf_tokens") * F.lit(max_epochs).cast("long")).where((w["domain"] > 0) & (w["lang"] > 0) & (w["source"] > 0))
    langs = sources.groupBy("root", "domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = langs.groupBy("root", "domain").agg(F.sum("capacity").alias("capacity"))
    have = leaves.agg(F.sum("leaf_tokens")).first()[0] or 0
    total = min(int(have * budget), have * max_epochs)
    level = lambda nodes, name: nodes.withColumn("weight", w[name])
    top = filled(level(domains, "domain").withColumn("share", F.lit(total).cast("long")), ["root"], "domain").select("domain", F.col("budget").alias("share"))
    mid = filled(level(langs.join(top, "domain"), "lang"), ["root", "domain"], "lang").select("domain", "lang", F.col("budget").alias("share"))
    low = filled(level(sources.join(mid, ["domain", "lang"]), "source"), ["root", "domain", "lang"], "source")
    return low.select(*LEVELS, "leaf_tokens", "budget")


def _key(whole: Column, id_: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), whole.cast("string"), id_.cast("string")))


def prefixes(parts: DataFrame, budget: float, max_epochs: int, weights: Mapping[str, Mapping[str, float]], seed: int) -> DataFrame:
    """A row per leaf that gets tokens: ``whole`` epochs, and of one more epoch the
    rows before ``last`` (key, text_key); of the ``copies`` equal rows there, ``some``
    are taken as a whole and, if ``rest`` isn't 0, one more up to ``rest`` tokens.
    ``last`` is null if nothing of that epoch is taken."""
    plan = budgets(parts.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("leaf_tokens")), budget, max_epochs, weights)
    plan = plan.select(*LEVELS, F.expr("budget div leaf_tokens").alias("whole"), (F.col("budget") % F.col("leaf_tokens")).alias("left_over")).where("whole > 0 or left_over > 0")
    plan = written(plan)
    ordered = parts.join(plan.where("left_over > 0"), list(LEVELS)).withColumn("key", _key(F.col("whole"), F.col("id"), seed)).withColumn("slice", F.substring("key", 1, SLICE))
    slices = ordered.groupBy(*LEVELS, "slice", "left_over").agg(F.sum("n_tokens").alias("size"))
    cut = running(slices, list(LEVELS), ["slice"], ["size"]).where("size_before < left_over and size_before + size >= left_over").select(*LEVELS, "slice", "size_before")
    edge = ordered.join(written(cut), [*LEVELS, "slice"])
    classes = edge.groupBy(*LEVELS, "left_over", "size_before", "key", "text_key", "id", "n_tokens").agg(F.count("*").alias("copies"))
    earlier = Window.partitionBy(*LEVELS).orderBy("key", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("copies") * F.col("n_tokens")
    begun = classes.withColumn("left", F.col("left_over") - F.col("size_before") - F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    last = begun.where((F.col("left") > 0) & (F.col("left") <= size)).select(
        *LEVELS, F.struct("key", "text_key").alias("last"), "id", "n_tokens", "copies", F.expr("left div n_tokens").alias("some"), (F.col("left") % F.col("n_tokens")).alias("rest")
    )
    return written(plan.join(last, list(LEVELS), "left").drop("left_over"))


def mixture(docs: DataFrame, budget: float = 0.5, max_epochs: int = 1, weights: Mapping[str, Mapping[str, float]] | None = None, seed: int = 42, **options) -> DataFrame:
    """(id, text_key, domain, lang, source, n_tokens, epoch, take_tokens): a row
    per document and epoch that is taken."""
    parts = written(leaf_documents(docs, **options))
    plan = prefixes(parts, budget, max_epochs, weights or {}, seed)
    told = ["id", "text_key", *LEVELS, "n_tokens"]
    planned = parts.join(plan.select(*LEVELS, "whole", "last"), list(LEVELS))
    here = F.struct(_key(F.col("whole"), F.col("id"), seed).alias("key"), F.col("text_key"))
    before = F.when(here < F.col("last"), F.array("whole")).otherwise(F.array().cast("array<bigint>"))
    taken = planned.select(*told, F.explode(F.concat(numbers(F.col("whole")), before)).alias("epoch")).select(*told, "epoch", F.col("n_tokens").alias("take_tokens"))
    at = plan.where("last is not null").select(*told[:1], F.col("last.text_key").alias("text_key"), *told[2:], F.col("whole").alias("epoch"), "some", "rest")
    equal = repeated(at.select(*told, "epoch", "some"), "some").select(*told, "epoch", F.col("n_tokens").alias("take_tokens"))
    partly = at.where("rest > 0").select(*told, "epoch", F.col("rest").alias("take_tokens"))
    return taken.unionByName(equal).unionByName(partly)


def _numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` (in files) with a number from 0 on within ``by``: first counted per
    task, so that no group is numbered in one."""
    n, part = fresh(rows.columns, "n"), fresh(rows.columns, "part")
    marked = written(rows.select("*", F.monotonically_increasing_id().alias(n)).withColumn(part, F.shiftright(n, 33)))
    sizes = marked.groupBy(*by, part).agg(F.count("*").alias("size"))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sizes.select(*by, part, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias(name)))
    a, s = fresh(rows.columns, "a"), fresh(rows.columns, "s")
    on = [F.col(f"{a}.{quoted(c)}").eqNullSafe(F.col(f"{s}.{quoted(c)}")) for c in [*by, part]]
    own = F.row_number().over(Window.partitionBy(*[F.col(f"{a}.{quoted(c)}") for c in [*by, part]]).orderBy(F.col(f"{a}.{quoted(n)}"))) - 1
    joined = marked.select(F.struct("*").alias(a)).join(starts.select(F.struct("*").alias(s)), on)
    return joined.select(*[F.col(f"{a}.{quoted(c)}").alias(c) for c in rows.columns], (F.col(f"{s}.{quoted(name)}") + own).alias(name))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain: Column | None = None, budget: float = 0.5, max_epochs: int = 1, weights: Mapping[str, Mapping[str, float]] | None = None, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that are taken, once for each epoch, with their columns.
    Each row is held against its leaf's prefix; the texts are joined with the leaves
    alone. Of equal rows at the end of a prefix, any are taken, in the right number."""
    named = {"doc_id": doc_id, "text": text, "lang": lang, "source": source, "domain": domain}
    plan = prefixes(written(leaf_documents(docs, **named)), budget, max_epochs, weights or {}, seed)
    m, l, r = fresh(docs.columns, "leaf"), fresh(docs.columns, "plan"), fresh(docs.columns, "equal")
    where = default_domain(F.col(quoted(source))) if domain is None else domain
    text_of = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit("(none)"))
    leaf = F.struct(where.alias("domain"), text_of(lang).alias("lang"), text_of(source).alias("source"), F.md5(F.col(quoted(text))).alias("text_key"))
    has_tokens = F.col(quoted(text)).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(has_tokens).select(*columns(docs.columns), leaf.alias(m))
    on = [F.col(f"{m}.{x}") == F.col(f"{l}.{x}") for x in LEVELS]
    rows = rows.join(plan.select(F.struct("*").alias(l)), on)
    here = F.struct(_key(F.col(f"{l}.whole"), F.col(quoted(doc_id)), seed).alias("key"), F.col(f"{m}.text_key"))
    whole, last, taken = F.col(f"{l}.whole"), F.col(f"{l}.last"), F.expr(f"{quoted(l)}.some + if({quoted(l)}.rest > 0, 1, 0)")
    at_end = F.coalesce((here == last) & (taken < F.col(f"{l}.copies")), F.lit(False))
    sure = whole + F.when(F.coalesce(here <= last, F.lit(False)), 1).otherwise(0)
    out = rows.where(~at_end).select(*columns(docs.columns), F.explode(numbers(sure)).alias(r)).select(*columns(docs.columns))
    if plan.where("some + if(rest > 0, 1, 0) < copies").take(1):
        equal = written(rows.where(at_end).select(*columns(docs.columns), F.struct(f"{m}.domain", f"{m}.lang", f"{m}.source", whole.alias("whole"), taken.alias("taken")).alias(m)))
        equal = _numbered(equal, [m], r)
        out = out.unionByName(equal.select(*columns(docs.columns), F.explode(numbers(F.col(f"{m}.whole") + F.when(F.col(quoted(r)) < F.col(f"{m}.taken"), 1).otherwise(0))).alias(r)).select(*columns(docs.columns)))
    return out
