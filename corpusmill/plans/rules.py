"""Rules as data: what they look for, where, and how they are switched on."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import similarity

SEVERITIES = ("error", "warning")
CATEGORIES = ("correctness", "security", "slop")
METRICS = ("file_lines", "code_lines", "import_count", "function_count", "comment_ratio")
TOKENS = ("comment", "doc_comment", "string", "code", "line")


@dataclass(frozen=True)
class Rule:
    """A rule has a pattern over tokens of some kind, or a metric with a threshold.
    ``language`` None means any; the key of a rule is (id, language). A replacement that
    may change what a text means is ``unsafe``."""

    id: str
    severity: str
    category: str
    message: str
    language: str | None = None
    kind: str = "line"
    pattern: str | None = None
    unless: str | None = None
    metric: str | None = None
    threshold: float | None = None
    min_lines: int = 0
    enabled: bool = True
    skip_tests: bool = False
    files: tuple[str, ...] = ()
    ignores: tuple[str, ...] = ()
    replacement: str | None = None
    unsafe: bool = False
    note: str | None = None

    def __post_init__(self):
        if self.severity not in SEVERITIES or self.category not in CATEGORIES:
            raise ValueError(f"{self.id}: unknown severity or category")
        if (self.pattern is None) == (self.metric is None):
            raise ValueError(f"{self.id}: either a pattern or a metric")
        if self.metric is not None and (self.metric not in METRICS or self.threshold is None):
            raise ValueError(f"{self.id}: a known metric needs a threshold")
        if self.kind not in TOKENS:
            raise ValueError(f"{self.id}: unknown kind {self.kind}")
        if self.replacement is not None and self.pattern is None:
            raise ValueError(f"{self.id}: a replacement needs a pattern")


@dataclass(frozen=True)
class Activation:
    """``enable`` alone decides if given; else a rule runs if its category is on,
    it is enabled and not disabled. Rules of the user's own always run."""

    categories: tuple[str, ...] = CATEGORIES
    enable: tuple[str, ...] = ()
    disable: tuple[str, ...] = ()
    own: tuple[Rule, ...] = field(default=())


def active(rules: Iterable[Rule], how: Activation = Activation()) -> list[Rule]:
    rules = list(rules)
    known = {(r.id, r.language) for r in rules}
    if clash := [r.id for r in how.own if (r.id, r.language) in known]:
        raise ValueError(f"rule ids in use already: {clash}")
    if how.enable:
        chosen = [r for r in rules if r.id in how.enable]
    else:
        chosen = [r for r in rules if r.category in how.categories and r.enabled and r.id not in how.disable]
    return [*chosen, *how.own]


def catalog(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [(r.id, r.language or "*", r.severity, r.category, "metric" if r.metric else r.kind, r.enabled, r.message, None if r.threshold is None else float(r.threshold)) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, language string, severity string, category string, kind string, enabled boolean, message string, threshold double")


def suggest(names: DataFrame, rules: Iterable[Rule], least: float = 0.6) -> DataFrame:
    """For each ``name`` the most similar rule id, the first by name on ties. The
    ids of a rule set are a short list and part of the expression."""
    ids = F.array(*[F.lit(x) for x in sorted({r.id for r in rules})])
    scores = F.transform(ids, lambda x: F.struct((-similarity(F.col("name"), x)).alias("score"), x.alias("rule_id")))
    best = F.array_min(scores)
    return names.select("name", F.when(-best["score"] >= least, best["rule_id"]).alias("rule_id"))


#: Rules for prose corpora.
TEXT_RULES = (
    Rule("secret-token", "error", "security", "A token is spelt out", pattern=r'token = "[0-9a-f]{40}"', replacement='token = "***"'),
    Rule("mail-address", "warning", "security", "A mail address", pattern=r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}", replacement="<mail>"),
    Rule("ipv4-address", "warning", "security", "An IPv4 address", pattern=r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", replacement="<ip>"),
    Rule("card-number", "error", "security", "A number of sixteen digits", pattern=r"[0-9]{16}", replacement="<card>"),
    Rule("license-line", "warning", "correctness", "A licence line", pattern=r"[Ll]icen[cs]e"),
    Rule("shouting", "warning", "slop", "Capitals and exclamation marks", pattern=r"[A-Z]{4,}!!"),
    Rule("symbol-run", "warning", "slop", "A run of symbols", pattern=r"[#*$%&]{3}"),
    Rule("pipe-list", "warning", "slop", "Words between pipes", pattern=r" \| [^|]{1,40} \| "),
    Rule("long-word", "warning", "slop", "A very long word", pattern=r"[A-Za-z]{25,}", enabled=False),
    Rule("many-lines", "warning", "slop", "$value lines in a file", metric="file_lines", threshold=30, min_lines=10),
    Rule("mostly-remarks", "warning", "slop", "Remarks make up $value of this file", metric="comment_ratio", threshold=0.4, min_lines=5),
)

#: Rewrites of prose that are repeated until nothing changes.
FIX_RULES = (
    *(r for r in TEXT_RULES if r.replacement is not None),
    Rule("digit-run", "warning", "slop", "Four digits in a row", pattern=r"[0-9]{4}", replacement="0", ignores=("**/es/**",)),
    Rule("symbol-pair", "warning", "slop", "Symbols side by side", pattern=r"[#*$%&]{2}", replacement="#"),
    Rule("bang-pair", "warning", "slop", "Exclamation marks side by side", pattern=r"!!", replacement="!"),
    Rule("doubled-the", "warning", "slop", "The same article twice", pattern=r"\b[Tt]he the\b", replacement="the", unsafe=True),
)
