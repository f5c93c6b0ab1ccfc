"""URL filters: rules by host and path, and an empirical-Bayes reputation of hosts for what
no rule covers; DataFrame functions only.

Pages with a known outcome are counted per host. A host's rate of bad pages is
beta-binomial: its prior has the mean of its registered domain, the domain's that of its
suffix, the suffix's that of all pages. How strong a level's prior is, is learned
from the outcomes: the variance of the children's rates around their parent's, beyond what
their numbers of pages explain, gives the correlation rho of pages with one parent, and the
prior counts as (1 - rho) / rho pages. A host is blocked if its rate lies above ``limit``, or above the
rate of all pages if none is given, by more than ``z`` deviations of the posterior: hosts of
which little is known stay.

Outcomes are summed per host before anything else, so pages move once at most, to meet
their host's posterior, in a join that Spark can split for a hot host. All terms are rounded
down to whole millionths before they are added, so that sums don't depend on their order.

Defined cases: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
lowered in A-Z; the path then up to ``?``, ``#`` or the end; a null URL, or one without
``://``, has neither, and belongs to no domain or suffix but the empty one; repeated rows
count once each; without any outcome all rates are one half; an empty table gives an empty
result; other columns pass through ``judged`` unless they bear a name of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.names import columns, fresh, quoted
from corpusmill.shared import written

#: Suffixes of several labels under which names are registered. Fixed values; more can be given.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The correlation of a level's pages is kept between these, in millionths.
LEAST_RHO, MOST_RHO = 1_000, 500_000


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: UrlRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def ruled(rules: Sequence[UrlRule], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, or null: one expression for a rule list."""
    tell = lambda r: F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*[F.when(_fits(r, host, path), tell(r)) for r in sorted(rules, key=lambda r: (-len(r.name), r.name))], none)


def _bare(host: Column) -> Column:
    """Without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: one label before the suffix. A host that is no more than a suffix,
    or an address in digits, is its own."""
    bare = _bare(host)
    several = F.lit(False)
    for s in suffixes:
        several = several | bare.endswith("." + s)
    return F.when(bare.rlike(r"^[0-9.]*$|^\["), bare).when(several, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def suffix_of(domain: Column) -> Column:
    """What follows the first label of a registered domain."""
    return F.when(domain.rlike(r"^[0-9.]*$|^\["), F.lit("")).otherwise(F.regexp_replace(domain, r"^[^.]*\.", ""))


def outcomes(pages: DataFrame, host: str, bad: str) -> DataFrame:
    """(host, n, k): the pages of known outcome (``bad`` isn't null), and how many are bad."""
    known = F.col(quoted(bad))
    return pages.groupBy(F.col(quoted(host)).alias("host")).agg(F.count(known).alias("n"), F.count_if(known).alias("k"))


def _correlation(met: DataFrame) -> float:
    """In millionths, the correlation of pages with one parent, of rows (n, k, prior): by the excess
    of the squared differences from the parents' rates over what chance explains."""
    p, n, k = F.col("prior") / F.lit(1e6), F.col("n"), F.col("k")
    terms = ((k - n * p) * (k - n * p) / n, p * (F.lit(1.0) - p), (n - 1) * p * (F.lit(1.0) - p))
    a, b, c = met.where("n > 0").agg(*[F.sum(F.floor(t * F.lit(1e6)).cast("decimal(20,0)")) for t in terms]).first()
    return min(MOST_RHO, max(LEAST_RHO, math.floor((float(a) - float(b)) * 1e6 / float(c)))) if c else MOST_RHO


def _shrunk(children: DataFrame, by: str, rates: DataFrame, above: str) -> DataFrame:
    """``children`` (by, above, n, k) with their parents' rate as ``prior``, the prior's strength ``s``
    in millionths of a page, and their own ``rate``; rates are in millionths. What is learned
    about a level is one number."""
    met = written(children.join(rates.select(above, F.col("rate").alias("prior")), above))
    rho = _correlation(met)
    s = math.floor((1e6 - rho) * 1e6 / rho)
    rate = (F.col("k") * F.lit(1e6) + F.lit(s) * F.col("prior") / F.lit(1e6)) / (F.col("n") * F.lit(1e6) + F.lit(s)) * F.lit(1e6)
    return met.select("*", F.lit(s).cast("long").alias("s"), F.floor(rate).cast("long").alias("rate"))


def reputation(hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, domain, suffix, n, k, alpha, beta, average) per host of ``hosts`` (host, n, k): the posterior
    of its rate of bad pages, alpha and beta in pages, and the rate of all pages."""
    own = hosts.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("domain", domain_of(F.col("host"), suffixes))
    own = written(own.withColumn("suffix", suffix_of(F.col("domain"))).withColumn("root", F.lit(0)))
    domains = written(own.groupBy("domain", "suffix", "root").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    tops = written(domains.groupBy("suffix", "root").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    all_ = written(tops.groupBy("root").agg(F.floor((F.sum("k") + 1) * F.lit(1e6) / (F.sum("n") + 2)).cast("long").alias("rate")))
    average = F.lit((all_.first() or {"rate": 500_000})["rate"]) / F.lit(1e6)
    at_top = written(_shrunk(tops, "suffix", all_, "root"))
    at_domain = written(_shrunk(domains.drop("root"), "domain", at_top, "suffix"))
    at_host = _shrunk(own.drop("root", "suffix"), "host", at_domain, "domain")
    mean, s = F.col("prior") / F.lit(1e6), F.col("s") / F.lit(1e6)
    return at_host.select("host", "domain", suffix_of(F.col("domain")).alias("suffix"), "n", "k", (F.col("k") + s * mean).alias("alpha"), (F.col("n") - F.col("k") + s * (F.lit(1.0) - mean)).alias("beta"), average.alias("average"))


def above(limit: Column, z: float) -> Column:
    """Whether the rate lies above ``limit`` by ``z`` deviations of its posterior (alpha, beta)."""
    a, b = F.col("alpha"), F.col("beta")
    mean = a / (a + b)
    return (mean > limit) & ((mean - limit) * (mean - limit) > F.lit(z * z) * (a * b) / ((a + b) * (a + b) * (a + b + F.lit(1.0))))


def judged(pages: DataFrame, rules: Sequence[UrlRule], url: str = "url", bad: str | None = None, limit: float | None = None, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block): the rule's, else by the host's
    reputation. ``bad`` names a boolean column with the known outcomes; without one they are
    the verdicts of the rules."""
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    taken = [*keep, "host", "path", "rule", "verdict"]
    u, at, known, reputed = F.col(quoted(url)).cast("string"), fresh(taken, "ruled"), fresh(taken, "known"), fresh(taken, "reputed")
    fitting = ruled(rules, F.col("host"), F.col("path")).alias(at)
    named = pages.select(*columns(keep), host_of(u).alias("host"), path_of(u).alias("path"), (F.col(quoted(bad)) if bad else F.lit(None).cast("boolean")).alias(known)).select("*", fitting)
    outcome = F.col(known) if bad else F.col(f"{at}.verdict") == "block"
    hosts = reputation(outcomes(named.select("host", outcome.alias("bad")), "host", "bad"), suffixes)
    verdict = F.when(above(F.col("average") if limit is None else F.lit(limit), z), "block").otherwise("allow")
    # Written, so that the join's sides are plain shuffles and Spark can split a hot host's pages.
    told = named.join(written(hosts.select(F.struct("host", verdict.alias("verdict")).alias(reputed))), F.col("host") == F.col(f"{reputed}.host"))
    return told.select(*columns(keep), "host", "path", F.col(f"{at}.rule").alias("rule"), F.coalesce(F.col(f"{at}.verdict"), F.col(f"{reputed}.verdict")).alias("verdict"))
