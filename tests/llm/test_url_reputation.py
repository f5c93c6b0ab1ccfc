import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpusmill.llm import queries
from corpusmill.llm.url_reputation import UrlRule, domain_of, host_of, judged, path_of, ruled, suffix_of


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def plain_rule(rules, host, path):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def plain_level(children, rates):
    """children: key -> (parent, n, k); gives key -> rate, and the strength; in millionths."""
    a = b = c = 0
    for parent, n, k in children.values():
        p = rates[parent] / 1e6
        if n:
            a += math.floor((k - n * p) * (k - n * p) / n * 1e6)
            b += math.floor(p * (1 - p) * 1e6)
            c += math.floor((n - 1) * p * (1 - p) * 1e6)
    rho = min(500000, max(1000, math.floor((a - b) * 1e6 / c))) if c else 500000
    s = math.floor((1e6 - rho) * 1e6 / rho)
    return {x: math.floor((k * 1e6 + s * rates[p] / 1e6) / (n * 1e6 + s) * 1e6) for x, (p, n, k) in children.items()}, s


def plain_verdicts(rows, limit=None, z=1.645):
    """rows: (host, bad or None); host -> verdict. Domains are the last two labels."""
    n, k = defaultdict(int), defaultdict(int)
    for host, bad in rows:
        n[host] += bad is not None
        k[host] += bool(bad)
    domain = {h: ".".join(h.split(".")[-2:]) for h in n}
    suffix = {d: d.split(".", 1)[1] if "." in d else d for d in domain.values()}
    summed = lambda of, keys: {x: (of[x], sum(n[h] for h in keys[x]), sum(k[h] for h in keys[x])) for x in keys}
    of_domain, of_suffix = defaultdict(list), defaultdict(list)
    for h, d in domain.items():
        of_domain[d].append(h)
        of_suffix[suffix[d]].append(h)
    average = math.floor((sum(k.values()) + 1) * 1e6 / (sum(n.values()) + 2))
    limit = average / 1e6 if limit is None else limit
    top, _ = plain_level(summed({s: 0 for s in of_suffix}, of_suffix), {0: average})
    mid, _ = plain_level(summed(suffix, of_domain), top)
    _, s = plain_level({h: (domain[h], n[h], k[h]) for h in n}, mid)
    out = {}
    for h in n:
        p = mid[domain[h]] / 1e6
        a, b = k[h] + s / 1e6 * p, n[h] - k[h] + s / 1e6 * (1 - p)
        mean = a / (a + b)
        out[h] = "block" if mean > limit and (mean - limit) ** 2 > z * z * a * b / ((a + b) ** 2 * (a + b + 1)) else "allow"
    return out


def random_urls(seed, n):
    r = random.Random(seed)
    hosts = [f"{r.choice(['', 'www.', 'm.', 'Blog.'])}{x}.{y}" for x in ("one", "two", "three.one", "example", "EXAMPLE") for y in ("org", "com", "net", "example.org", "example.com")]
    return [f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{r.choice(['', '/', '/es/', '/en/1', '/en/2', '/fr/x', '/de/', '/de'])}{r.choice(['', '?a=/b', '#c://d/e', '?x#y'])}" for _ in range(n)]


def test_parts_and_rules(spark):
    urls = [*random_urls(1, 400), None, "", "no scheme", "://", "a://b", "x://A.B/C?d", "u://v?w://x/y", "http://Ä.Org/é?q", "h://a\nb/c\nd#e"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = df.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select("*", ruled(queries.URL_RULES, F.col("host"), F.col("path")).alias("r")).collect()
    for r in got:
        host, path = plain_parts(r["url"])
        rule = plain_rule(queries.URL_RULES, host, path)
        assert (r["host"], r["path"]) == (host, path)
        assert (r["r"] and r["r"]["rule"]) == (rule and rule.name)
        assert (r["r"] and r["r"]["verdict"]) == (rule and rule.verdict)


def test_domains(spark):
    cases = {
        "a.b.example.com": ("example.com", "com"), "example.com": ("example.com", "com"), "com": ("com", "com"), "": ("", ""), "x.y.co.uk:80": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"),
        "u@h.org": ("h.org", "org"), "10.0.0.1:8080": ("10.0.0.1", ""), "[::1]": ("[::1]", ""),
    }
    df = spark.createDataFrame([(h,) for h in cases], "h string").select("h", domain_of(F.col("h")).alias("d")).select("*", suffix_of(F.col("d")).alias("s"))
    assert {r["h"]: (r["d"], r["s"]) for r in df.collect()} == cases


def test_reputation_like_plain(spark):
    r = random.Random(4)
    rates = {f"h{i}.d{i % 7}.{('com', 'org', 'net')[i % 3]}": r.random() ** 2 for i in range(60)}
    rows = []
    for h, rate in rates.items():
        for _ in range(r.choice([0, 1, 3, 20, 200])):
            rows.append((f"https://{h}/p", None if r.random() < 0.3 else r.random() < rate))
        rows.append((f"https://{h}/q", None))
    rows += [("https://h1.d1.org/x", True)] * 500
    df = spark.createDataFrame(rows, "url string, bad boolean").repartition(4)
    for limit in (None, 0.5):
        got = {(x["host"], x["verdict"]) for x in judged(df, [UrlRule("none.example", "/", "allow")], bad="bad", limit=limit).collect()}
        want = plain_verdicts([(plain_parts(u)[0], b) for u, b in rows], limit)
        assert got == set(want.items())
        assert set(want.values()) == {"allow", "block"}


def test_odd_input(spark):
    df = spark.createDataFrame([(1, None, "h"), (2, "", "h"), (3, "https://x.org/a", None), (3, "https://x.org/a", None), (None, "https://y.org", "h")], "page_id long, url string, host string")
    df = df.selectExpr("*", "1 as verdict", "'k' as `a.b`", "'r' as ruled", "'e' as reputed", "true as known", "0 as n")
    out = judged(df, queries.URL_RULES)
    assert out.columns == ["page_id", "url", "a.b", "ruled", "reputed", "known", "n", "host", "path", "rule", "verdict"]
    assert sorted((r["page_id"] or 0, r["host"], r["rule"], r["verdict"]) for r in out.collect()) == [
        (0, "y.org", None, "allow"), (1, "", None, "allow"), (2, "", None, "allow"), (3, "x.org", "org/", "allow"), (3, "x.org", "org/", "allow"),
    ]
    assert judged(df.limit(0), queries.URL_RULES).count() == 0


def test_no_python_workers(spark):
    plan = judged(spark.createDataFrame([("https://a.org/",)], "url string"), queries.URL_RULES)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
