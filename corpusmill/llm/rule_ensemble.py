"""A sparse rule ensemble as quality classifier.

Statistics of a text are DataFrame expressions. Boosted trees of depth 3 over a
bounded sample of labelled rows yield rules: each path from a root to another
node is a conjunction of comparisons. Lasso logistic regression weighs the
rules, most of them to zero; the rest are compiled into one column expression,
so that scoring is one pass over the texts, without Python or a model at run time.

Learning takes labelled documents whose ``crc32(id as text) mod 3`` is not 1, at
most ``max_rows`` of them (and one of each class): of each class those with the
smallest hash of their id, as many as its share of all labels. Their ids alone are
looked for among the documents, so statistics for learning are computed for the
sample alone.

Defined cases: null and empty texts have statistics of zero and get a score; a
very long text is one row like any other; without labelled documents the score is
0.5, with one class only that class's share as smoothed by one document of each; if
an id has several labels the smallest counts; of rows with one id one is learnt from;
repeated rows are scored alike; rows with a null id are scored, never learnt from;
an empty table gives an empty result; other columns are ignored, or pass through
``keep_good``, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.names import quoted
from corpusmill.llm.samples import smallest
from corpusmill.shared import written

SPACE = r"[\x20\x09-\x0D]+"

#: Characters that a statistic counts: the share of the text that they make up.
COUNTED = {
    "upper": r"\p{Lu}",
    "digit": r"[0-9]",
    "symbol": r"[#*$%&@^~=+_\\/<>{}\[\]]",
    "pipe": r"\|",
    "bang": r"[!?]",
    "stop": r"[.,;:]",
    "line": r"\n",
}
STATS = ["n_words", "word_length", "distinct_words", "distinct_lines", "short_words", "long_words", "n_lines", *COUNTED]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where Spark moves the
    expression into a filter."""
    return F.transform(F.array(value), body)[0]


def statistics(text: Column) -> Column:
    """The statistics of a text as a struct."""

    def of(x: Column) -> Column:
        t, words, rows = x["t"], x["words"], x["lines"]
        n, chars, lines = F.size(words), F.greatest(F.length(t), F.lit(1)), F.size(rows)
        per_word = lambda x: F.when(n > 0, x / n).otherwise(0.0)
        longer = lambda k: F.size(F.filter(words, lambda w: F.length(w) > k))
        shares = [F.when(t.rlike(p), F.regexp_count(t, F.lit(p)) / chars).otherwise(0.0).alias(name) for name, p in COUNTED.items()]
        return F.struct(
            n.cast("double").alias("n_words"),
            per_word(F.length(F.array_join(words, ""))).alias("word_length"),
            per_word(F.size(F.array_distinct(words))).alias("distinct_words"),
            (F.size(F.array_distinct(rows)) / lines).alias("distinct_lines"),
            per_word(n - longer(3)).alias("short_words"),
            per_word(longer(12)).alias("long_words"),
            lines.cast("double").alias("n_lines"),
            *shares,
        )

    whole = lambda t: F.struct(t.alias("t"), F.array_remove(F.split(t, SPACE), "").alias("words"), F.split(t, "\n").alias("lines"))
    return _let(F.coalesce(text.cast("string"), F.lit("")), lambda t: _let(whole(t), of))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Rules:
    """score = 1 / (1 + exp(-(bias + sum of the weights of rules that hold)))"""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...] = ()  # weight, (statistic, at most?, bound)s

    def score(self, stats: Column) -> Column:
        """From a struct of statistics."""

        def of(s: Column) -> Column:
            total = reduce(lambda a, b: a + b, [F.when(holds(r, s), w).otherwise(0.0) for w, r in self.rules], F.lit(self.bias))
            return 1 / (1 + F.exp(-total))

        return _let(stats, of)


def holds(rule, stats: Column) -> Column:
    return reduce(lambda a, b: a & b, [stats[c] <= x if low else stats[c] > x for c, low, x in rule])


def tree_rules(root, names: list[str]) -> list[tuple]:
    """Every path from the root as a rule; bounds on one statistic are merged."""
    out = []

    def visit(node, path):
        if path:
            merged = {}
            for c, low, x in path:
                old = merged.get((c, low), x)
                merged[c, low] = min(old, x) if low else max(old, x)
            out.append(tuple((c, low, x) for (c, low), x in sorted(merged.items())))
        if "Leaf" not in node.getClass().getSimpleName():
            split = node.split()
            name, bound = names[split.featureIndex()], split.threshold()
            visit(node.leftChild(), [*path, (name, True, bound)])
            visit(node.rightChild(), [*path, (name, False, bound)])

    visit(root, [])
    return out


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, label_id: str, max_rows: int, seed: int) -> tuple[dict[float, int], DataFrame | None]:
    """How many documents each class has, and (id, label, stats) of the sample; none
    if there are fewer than two classes."""
    marks = labels.where(F.col(quoted(label)).isNotNull()).groupBy(F.col(quoted(label_id)).alias("id")).agg(F.min(quoted(label)).cast("double").alias("label"))
    marks = marks.where(F.col("id").isNotNull() & F.col("label").isin(0.0, 1.0) & ~held_out(F.col("id")))
    ids = docs.select(F.col(quoted(doc_id)).alias("id"))
    known = written(marks.join(ids, "id", "left_semi").select("id", "label", F.xxhash64("id", F.lit(seed)).alias("key")))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    n = sum(counts.values())
    if len(counts) < 2:
        return counts, None
    chosen = smallest(known, "label", "key", {c: min(k, max(1, round(min(1.0, max_rows / n) * k))) for c, k in counts.items()}).select("id", "label")
    read = docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("t"))
    rows = read.join(F.broadcast(written(chosen)), "id")  # max_rows ids
    return counts, written(rows.select("id", "label", statistics(F.col("t")).alias("stats")).groupBy("id", "label").agg(F.min("stats").alias("stats")))


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", label_id: str = "doc_id",
    max_rows: int = 20_000, trees: int = 12, lasso: float = 0.002, seed: int = 7,
) -> Rules:
    counts, rows = sample(docs, labels, doc_id, text, label, label_id, max_rows, seed)
    if rows is None:
        share = (counts.get(1.0, 0) + 1) / (sum(counts.values()) + 2)
        return Rules(-math.log(1 / share - 1))
    # The sample is a small table of its own: few tasks are enough for the rounds of fitting.
    rows = rows.coalesce(4).sortWithinPartitions("id").select("label", "stats.*")
    rows = VectorAssembler(inputCols=STATS, outputCol="x").transform(rows).select("x", "label", *STATS).persist()
    try:
        model = GBTClassifier(featuresCol="x", labelCol="label", maxDepth=3, maxIter=trees, maxBins=64, stepSize=0.3, seed=seed).fit(rows)
        rules = sorted({r for t in model.trees for r in tree_rules(t._call_java("rootNode"), STATS)})
        stats = F.struct(*STATS)
        flags = [F.when(holds(r, stats), 1.0).otherwise(0.0).alias(f"r{i}") for i, r in enumerate(rules)]
        flagged = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules").transform(rows.select("label", *flags)).select("label", "rules")
        line = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(flagged)
        weights = line.coefficients.toArray()
        return Rules(float(line.intercept), tuple((float(w), r) for w, r in zip(weights, rules) if w))
    finally:
        rows.unpersist()


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, held_out, score, predicted) of every row, in one pass over the texts."""
    rules = fit(docs, labels, doc_id, text, **options)
    own = F.col(quoted(doc_id))
    out = docs.select(own.alias("id"), held_out(own).alias("held_out"), rules.score(statistics(F.col(quoted(text)))).alias("score"))
    return out.select(F.col("id").alias(doc_id), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are predicted good. Scoring is a column
    expression over each row's own text, so nothing is joined or shuffled."""
    rules = fit(docs, labels, doc_id, text, **options)
    return docs.where(rules.score(statistics(F.col(quoted(text)))) >= 0.5)
