"""Language identification by hierarchical discrimination.

A text is first given to a language family, then to a language within it. Both
steps are one-versus-one linear support vector machines (squared hinge loss) on
hashed byte trigrams of the lower-cased text; the class with most duels won is
the answer, the sum of margins settles ties. Related languages thus get machines
that learn from each other's texts alone.

Learning takes rows with text and a non-null language whose ``crc32(id as text)
mod 3`` is not 1, at most ``max_rows`` of each language, those with the smallest
hash of id and text. Their features are counted where the texts are and written in
the shared folder. Each pair's machine is a task of its own, over the vectors of its
two sides (``max_rows`` for each language on them); only weights go to the driver.

Defined cases: null texts and texts without a letter get ``und`` and score 0;
with one language learnt, every other text gets it; with none, all get ``und``; a
very long text is one row like any other, an empty table gives an empty result;
repeated rows are treated alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.names import quoted
from corpusmill.llm.samples import smallest
from corpusmill.shared import written
from corpusmill.ship import ship

DIMS = 2048
LETTER = regex.compile(r"\p{L}")

#: Families of languages that are often found on the web. A
#: language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "finnic": ("fi", "et"),
    "turkic": ("tr", "az", "kk"),
}


def features(text: str) -> np.ndarray:
    """Square roots of trigram counts, scaled to length 1."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(DIMS, np.float32)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(21)
    x = np.sqrt(np.bincount(h, minlength=DIMS).astype(np.float32))
    return x / np.linalg.norm(x)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def machine(x: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear machine, y being 1 or -1: accelerated gradient
    descent on the squared hinge loss, both classes weighed alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = last = np.zeros(x.shape[1])
    for k in range(rounds):
        v = w + k / (k + 3) * (w - last)
        short = np.maximum(0, 1 - y * (x @ v))
        last, w = w, v - 0.25 * (ridge * v - 2 * x.T @ (each * y * short))
    return w


@dataclass(frozen=True)
class Duels:
    """One-versus-one machines between ``names``."""

    names: tuple[str, ...]
    weights: np.ndarray  # a row per pair

    @staticmethod
    def of(names, weights: Mapping[tuple[str, str], np.ndarray]) -> Duels:
        names = tuple(sorted(names))
        return Duels(names, np.array([weights[pair] for pair in combinations(names, 2)]).reshape(-1, DIMS + 1))

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winner, its least sure duel as a probability) per row."""
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        n, k = len(x), len(self.names)
        won, sums, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for m, (a, b) in zip(margins.T, combinations(range(k), 2)):
            won[:, a] += m > 0
            won[:, b] += m <= 0
            sums[:, a] += m
            sums[:, b] -= m
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        best = np.argmax(won + 0.5 * np.tanh(sums / max(1, k)) * 0.9, axis=1)
        return best, 1 / (1 + np.exp(-np.clip(3 * least[np.arange(n), best], -30, 30)))


@dataclass(frozen=True)
class Identifier:
    families: Duels
    within: dict[str, Duels]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        sound = [t if t is not None and LETTER.search(t) else None for t in texts]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(sound) if t is not None]
        if rows and self.families.names:
            x = np.stack([features(sound[i]) for i in rows])
            family, sure = self.families.judge(x)
            for f, name in enumerate(self.families.names):
                at = np.flatnonzero(family == f)
                if len(at):
                    lang, surer = self.within[name].judge(x[at])
                    for j, k, s in zip(at, lang, surer):
                        langs[rows[j]], scores[rows[j]] = self.within[name].names[k], float(min(s, sure[j]))
        return langs, scores


def vectors(docs: DataFrame, doc_id: str, text: str, lang: str, max_rows: int) -> DataFrame:
    """(lang, x) of the sample; x is the text's features."""
    own, t = F.col(quoted(doc_id)), F.col(quoted(text))
    known = docs.select(own.alias("id"), t.cast("string").alias("t"), F.col(quoted(lang)).cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}") & ~held_out(F.col("id")))
    chosen = smallest(known.select("t", "lang", F.xxhash64("id", "t").alias("key")), "lang", "key", max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t).astype(np.float16).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.binary())], ["lang", "x"])

    return written(chosen.select("t", "lang").mapInArrow(run, "lang string, x binary"))


def trained(sample: DataFrame, duels: list[tuple[str, str, str, str, int]]) -> dict[tuple[str, str, str], np.ndarray]:
    """Weights by (level, a, b); ``duels`` has (level, a, b, lang, side) for each language
    that takes part on a side. A pair's vectors go to one task: ``max_rows`` for each
    language of its sides."""
    if not duels:
        return {}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "x"])  # whatever the order that they came in
        x = np.array([np.frombuffer(v, np.float16) for v in rows["x"]], np.float32).reshape(-1, DIMS)
        first = rows.iloc[0]
        return pd.DataFrame({"level": [first["level"]], "a": [first["a"]], "b": [first["b"]], "weights": [machine(x, rows["side"].to_numpy()).tobytes()]})

    sides = sample.sparkSession.createDataFrame(duels, "level string, a string, b string, lang string, side int")
    out = sample.join(sides, "lang").groupBy("level", "a", "b").applyInPandas(run, "level string, a string, b string, weights binary").collect()
    return {(r["level"], r["a"], r["b"]): np.frombuffer(bytes(r["weights"])) for r in out}


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 1000, families: Mapping[str, tuple[str, ...]] = FAMILIES) -> Identifier:
    ship(docs.sparkSession)
    sample = vectors(docs, doc_id, text, lang, max_rows)
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # a row per language
    family_of = {name: f for f, names in families.items() for name in names}
    members: dict[str, list[str]] = {}
    for name in langs:
        members.setdefault(family_of.get(name, name), []).append(name)
    duels = [("", a, b, x, side) for a, b in combinations(sorted(members), 2) for side, f in ((1, a), (-1, b)) for x in members[f]]
    duels += [("in " + f, a, b, x, side) for f, names in members.items() for a, b in combinations(names, 2) for side, x in ((1, a), (-1, b))]
    weights = trained(sample, duels)
    of = lambda level, names: Duels.of(names, {k[1:]: w for k, w in weights.items() if k[0] == level})
    return Identifier(of("", members), {f: of("in " + f, names) for f, names in members.items()})


def identified(docs: DataFrame, model: Identifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) per row. The model has a vector per pair
    of families and of related languages."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                langs, scores = shared.value.predict(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("t"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", doc_id)
