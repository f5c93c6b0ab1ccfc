"""The registered queries of this folder, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import chunk_store, iso_media, langid, line_frequency, mixing, periodic_runs, phrases, pipeline, rollups, rule_ensemble, simhash, unigram, url_reputation, warc
from corpusmill.shared import shared_dir, written
from corpusmill.sources.tables import spread
from corpusmill.llm.tokenizer_files import BYTE_BPE, PIECES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_frequency.line_quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_lines", "removed_words")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce('i' || doc_id, 't' || md5(text)) AS document, coalesce('h:' || source, 'none') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, document, host, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 4),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, document, host, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS lw
      FROM (SELECT doc_id, document, host, unnest(ls) AS x FROM w)),
m AS (SELECT doc_id, document, host, lower(array_to_string(lw, ' ')) AS line, len(lw) AS words FROM l),
h AS (SELECT host, count(DISTINCT document) AS host_docs FROM d GROUP BY host),
f AS (SELECT host, line, count(DISTINCT document) AS docs FROM m GROUP BY host, line HAVING count(DISTINCT document) > 20),
x AS (SELECT f.host, f.line FROM f JOIN h USING (host) WHERE f.docs > 0.02 * h.host_docs),
c AS (SELECT m.doc_id, count(*) AS removed_lines, sum(m.words) AS removed_words FROM m JOIN x ON m.host = x.host AND m.line = x.line GROUP BY m.doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             coalesce(c.removed_lines, 0)::BIGINT AS removed_lines, coalesce(c.removed_words, 0)::BIGINT AS removed_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN c ON w.doc_id = c.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND removed_words <= 0.5 * n_words AND n_words - removed_words >= 50 AS kept, removed_lines, removed_words
FROM v
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 1000
"""


def op3_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = chunk_store.write_store(_table(spark, sf_dir, "documents"), BYTE_BPE)
    chunk_store.check_manifest(store)
    return chunk_store.digests(store).select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks")


def op4_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = iso_media.features(iso_media.stored_media(_table(spark, sf_dir, "documents")))
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("-", k["start"].cast("string"), k["end"].cast("string"))), ",")
    feature = F.concat(F.lit("codec="), "codec", F.lit(";duration="), F.col("duration_s").cast("string"), F.lit(";keyframes="), ranges)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op5_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.checked(_table(spark, sf_dir, "documents"), PIECES)


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: The mixture that op7 makes: half as many tokens as there are, at most two
#: epochs of a leaf, English at double and one domain at triple weight.
MIX = {"budget": 0.5, "max_epochs": 2, "weights": {"lang": {"en": 2.0}, "domain": {"domain1": 3.0}}}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixture(_table(spark, sf_dir, "documents"), **MIX)
    return out.select(F.col("id").alias("doc_id"), "domain", "lang", "source", "epoch", "n_tokens", "take_tokens")


def _filled_sql(name: str, nodes: str, above: str, level: str) -> str:
    """Water filling at a level in whole tokens, as common table expressions."""
    by = f"PARTITION BY {above}" if above else ""
    rows = f"OVER ({by} ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
{name}_w AS (SELECT *, coalesce(sum(capacity) {rows}, 0)::HUGEINT AS cb, coalesce(sum(weight) {rows}, 0)::HUGEINT AS wb, (sum(weight) OVER ({by}))::HUGEINT AS ws FROM {nodes}),
{name}_e AS (SELECT *, capacity::HUGEINT * (ws - wb) <= (share - cb) * weight AS filled FROM {name}_w),
{name}_f AS (SELECT *, min(CASE WHEN NOT filled THEN struct_pack(r := capacity / weight, k := {level}, cb := cb, wb := wb) END) OVER ({by}) AS e FROM {name}_e),
{name} AS (SELECT *, CASE WHEN filled THEN capacity ELSE
    ((share - e.cb) * (wb + weight - e.wb)) // (ws - e.wb) - ((share - e.cb) * (wb - e.wb)) // (ws - e.wb) END::BIGINT AS budget FROM {name}_f),
"""


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, text, coalesce('domain' || (TRY_CAST(nullif(regexp_extract(source, '([0-9])$', 1), '') AS INT) % 4), 'other') AS domain,
                  coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
                  len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
p AS (SELECT * FROM d WHERE n_tokens > 0),
s AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS leaf_tokens, (sum(n_tokens) * 2)::BIGINT AS capacity, 1000000::BIGINT AS weight FROM p GROUP BY ALL),
l AS (SELECT domain, lang, sum(capacity)::BIGINT AS capacity, CASE WHEN lang = 'en' THEN 2000000 ELSE 1000000 END::BIGINT AS weight FROM s GROUP BY domain, lang),
t AS (SELECT domain, sum(capacity)::BIGINT AS capacity, CASE WHEN domain = 'domain1' THEN 3000000 ELSE 1000000 END::BIGINT AS weight FROM l GROUP BY domain),
b AS (SELECT floor(sum(n_tokens) * 0.5)::BIGINT AS total FROM p),
{_filled_sql("top", "(SELECT t.*, total AS share FROM t, b)", "", "domain")}
{_filled_sql("mid", "(SELECT l.*, top.budget AS share FROM l JOIN top USING (domain))", "domain", "lang")}
{_filled_sql("low", "(SELECT s.*, mid.budget AS share FROM s JOIN mid USING (domain, lang))", "domain, lang", "source")}
q AS (SELECT domain, lang, source, (budget // leaf_tokens)::BIGINT AS whole, (budget % leaf_tokens)::BIGINT AS left_over FROM low),
o AS (SELECT p.*, whole, left_over, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5(concat_ws('/', '42', whole, doc_id)), md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM p JOIN q USING (domain, lang, source))
SELECT doc_id, domain, lang, source, unnest(range(whole))::BIGINT AS epoch, n_tokens, n_tokens AS take_tokens FROM o WHERE whole > 0
UNION ALL
SELECT doc_id, domain, lang, source, whole AS epoch, n_tokens, least(n_tokens, left_over - begun)::BIGINT AS take_tokens FROM o WHERE begun < left_over
"""


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.fit(docs))


def op10_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: counts under two tokenizer versions, the
    second's revised (words without a letter or digit don't count), and deletes
    of exact copies of a document with a smaller id; then each batch once more,
    as after a broken run."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    words = docs.select("doc_id", "source", "lang", F.sha2("text", 256).alias("text_key"), F.array_remove(F.split("text", mixing.SPACE), "").alias("words"))
    counts = words.select("doc_id", "source", "lang", "text_key", F.size("words").alias("n1"), F.size(F.filter("words", lambda w: w.rlike(r"[\p{L}\p{N}]"))).alias("n2"))
    path = shared_dir(spark)
    counts = written(counts, f"{path}/counts")
    under = lambda rows, version, n: rows.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(n).alias("n_tokens"))
    first = counts.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, f"{path}/first")  # so that the join's sides are plain shuffles, of which Spark can split a hot text's
    copies = written(counts.join(first, "text_key").where("doc_id != first"), f"{path}/copies")
    wrong = counts.where("n1 != n2")
    batches = {
        "load-1": rollups.inserts(under(counts, "words-1", "n1")),
        "load-2": rollups.inserts(under(counts, "words-2", "n1")),
        "revise-2": rollups.revisions(under(wrong, "words-2", "n1"), under(wrong, "words-2", "n2")),
        "drop-copies": rollups.deletes(under(copies, "words-1", "n1").unionByName(under(copies, "words-2", "n2"))),
    }
    rollup = rollups.Rollup(spark, f"{path}/rollup")
    for name, changes in [*batches.items(), *batches.items()]:
        rollup.commit(name, changes)
    return rollup.totals()


OP10_SQL = r"""
WITH c AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT * FROM c QUALIFY doc_id = min(doc_id) OVER (PARTITION BY t)),
n AS (SELECT source, lang, 'words-1' AS tokenizer, len(ws) AS n FROM k UNION ALL
      SELECT source, lang, 'words-2', len(list_filter(ws, lambda x: regexp_matches(x, '[\p{L}\p{N}]'))) FROM k)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM n GROUP BY ALL
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w UNION ALL
      SELECT lang, 2, unnest([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) FROM w UNION ALL
      SELECT lang, 3, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) FROM w),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
u AS (SELECT lang, phrase, k, a, unnest(range(1, k)) AS cut, ws FROM c),
v AS (SELECT u.*, x.a AS l, y.a AS r, (1000000::HUGEINT * u.a * u.a) // (x.a::HUGEINT * y.a) AS score FROM u
      JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.ws[1:cut], ' ')
      JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.ws[cut + 1:], ' ')),
m AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
b AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL),
q AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, m.a DESC, m.phrase) AS rank FROM m LEFT JOIN b ON m.lang = b.lang AND m.phrase = b.phrase
      WHERE longest IS NULL OR 2 * longest < m.a)
SELECT q.lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM q JOIN t USING (lang) WHERE rank <= 2000
"""


def _with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, told by a checksum of the id, the words from
    one on repeat with a period; both follow from the checksum and the number of words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).alias("ws"))
    n, g = F.size("ws").cast("long"), F.floor(F.col("h") / 10)
    at = words.select("doc_id", "text", "ws", F.when(n > 0, g % n).alias("a"), n.alias("n"), g.alias("g"))
    told = at.select("doc_id", "text", "ws", "a", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).alias("p"))
    repeated = F.transform("ws", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("ws", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return told.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(_with_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  a later run only if its exponent is greater
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda s, x: F.when(better(x, s), x).otherwise(s))
    told = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")])), "\n")
    told = F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("")
    found = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(F.lit(1000) * F.col("b.length") / F.col("b.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: What op13 judges by, as given.
URL_RULES = [
    url_reputation.UrlRule("org", "/", "allow"),
    url_reputation.UrlRule("example.org", "/es/", "block"),
    url_reputation.UrlRule("example.org", "/en/1", "block"),
    url_reputation.UrlRule("com", "/fr/", "allow"),
    url_reputation.UrlRule("com", "/de/", "block"),
]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_reputation.judged(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def _level_sql(name: str, children: str, parent: str, above: str) -> str:
    """A level of the hierarchy: its parents' rates as priors, the strength of these, and its rates."""
    return f"""
{name}_m AS (SELECT c.*, q.rate AS prior, q.rate / 1e6 AS p FROM {children} c JOIN {parent} q USING ({above})),
{name}_t AS (SELECT sum(floor((k - n * p) * (k - n * p) / n * 1e6)::HUGEINT)::DOUBLE AS a, sum(floor(p * (1.0::DOUBLE - p) * 1e6)::HUGEINT)::DOUBLE AS b,
                    sum(floor((n - 1) * p * (1.0::DOUBLE - p) * 1e6)::HUGEINT)::DOUBLE AS c FROM {name}_m WHERE n > 0),
{name}_s AS (SELECT floor((1e6 - rho) * 1e6 / rho) AS s FROM (SELECT CASE WHEN c > 0 THEN least(500000, greatest(1000, floor((a - b) * 1e6 / c))) ELSE 500000 END AS rho FROM {name}_t)),
{name} AS (SELECT m.*, s, floor((k * 1e6 + s * prior / 1e6) / (n * 1e6 + s) * 1e6)::BIGINT AS rate FROM {name}_m m, {name}_s),
"""


def _fits_sql(rule: url_reputation.UrlRule) -> str:
    return f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"


_LONGEST = sorted(URL_RULES, key=lambda r: (-len(r.name), r.name))
OP13_SQL = rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT *, CASE {" ".join(f"WHEN {_fits_sql(r)} THEN '{r.name}'" for r in _LONGEST)} END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ({", ".join(f"'{r.name}'" for r in URL_RULES if r.verdict == "block")}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS told FROM j),
h AS (SELECT host, count(told)::BIGINT AS n, count_if(told = 'block')::BIGINT AS k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM v GROUP BY host),
e AS (SELECT *, CASE WHEN regexp_matches(bare, '^[0-9.]*$|^\[') THEN bare
                     WHEN regexp_matches(bare, '\.(ac\.uk|co\.jp|co\.nz|co\.uk|com\.au|com\.br|org\.uk)$') THEN regexp_extract(bare, '([^.]*\.)?[^.]*\.[^.]*$')
                     ELSE regexp_extract(bare, '([^.]*\.)?[^.]*$') END AS domain FROM h),
o AS (SELECT host, n, k, domain, CASE WHEN regexp_matches(domain, '^[0-9.]*$|^\[') THEN '' ELSE regexp_replace(domain, '^[^.]*\.', '') END AS suffix, 0 AS root FROM e),
d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM o GROUP BY ALL),
s AS (SELECT suffix, 0 AS root, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM d GROUP BY ALL),
a AS (SELECT root, floor((sum(k) + 1) * 1e6 / (sum(n) + 2))::BIGINT AS rate FROM s GROUP BY root),
{_level_sql("top", "s", "a", "root")}
{_level_sql("mid", "d", "top", "suffix")}
{_level_sql("low", "(SELECT host, domain, n, k FROM o)", "mid", "domain")}
x AS (SELECT host, k + (s / 1e6) * p AS alpha, n - k + (s / 1e6) * (1.0::DOUBLE - p) AS beta FROM low),
y AS (SELECT host, alpha / (alpha + beta) AS mean, alpha, beta FROM x),
z AS (SELECT host, mean > a.rate / 1e6 AND (mean - a.rate / 1e6) * (mean - a.rate / 1e6) > {1.645 * 1.645!r}::DOUBLE * (alpha * beta) / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1.0)) AS bad FROM y, a)
SELECT page_id, v.host, path, rule, coalesce(told, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM v JOIN z ON v.host = z.host
"""


QUERIES = {
    "op1_warc": op1_warc,
    "op2_quality_rules": op2_quality_rules,
    "op3_chunk_store": op3_chunk_store,
    "op4_iso_media": op4_iso_media,
    "op5_unigram": op5_unigram,
    "op6_rule_ensemble": op6_rule_ensemble,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_language": op9_language,
    "op10_rollups": op10_rollups,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_url_filter": op13_url_filter,
    "pipeline": pipeline.run,
}

ORACLES = {"op1_warc": OP1_SQL, "op2_quality_rules": OP2_SQL, "op7_mixing": OP7_SQL, "op10_rollups": OP10_SQL, "op11_collocations": OP11_SQL, "op13_url_filter": OP13_SQL}
