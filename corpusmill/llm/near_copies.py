"""Near copies, on DataFrame functions only: texts whose sets of five-word shingles
have a Jaccard similarity of at least 0.8, and the components that such pairs make.

SimHash fingerprints of near copies differ in up to some 11 of 64 bits, and a
covering of that radius compares a share of all pairs. Candidates come from
``BANDS`` keys of ``ROWS`` min-hashes each instead. The min-hashes of a set are the
elements that follow ``POINTS`` places, evenly spread over the range of the hash, so
that one pass over the sorted set finds them all; each is equal for two sets with the
probability of their similarity. A pair at 0.8 has two keys in common with a
probability of 0.9999 if the places were independent; neighbouring ones of a small
set aren't. Every candidate is then decided by its exact similarity.

No bucket is capped. First each text of a bucket meets the bucket's ``CENTRES`` most central ones,
which share buckets with most texts: of a group of edited copies those with the fewest edits, to
which nearly all that belong to the group are linked. A pair is left out if fewer than ``LIKE`` of their 96 min-hashes are equal (a pair at 0.8 has 77 on
average; of 4000 random pairs each of 10, 18, 46, 92 and 300 shingles, 5 of 10 shingles had
fewer, and none had less than two keys in common). Texts which that leaves in different components though they share two
buckets are then joined exactly, by the prefix filter: of a
set in order of the shingles' frequency among these texts, rarest first, two sets at
0.8 have a shingle in common within the first fifth (and one) of either, and their
first common one leaves enough after it. Passages that many texts share come last
in that order and make no pairs; what meets are components that share a rare shingle and
have texts there of which enough is left, so pairs grow with the square of the components at
one, not of a bucket. Of these pairs, too, only those with ``LIKE`` equal min-hashes are decided by their sets.

Defined cases: words are told apart by ASCII white space and compared in lower
case; a text of fewer than five words is one shingle; null counts as empty; texts
with equal shingle sets are one node. Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.components import connected
from corpusmill.shared import scratch, shared_dir, written

SPACE = r"[\x20\x09-\x0D]+"
BANDS, ROWS, LIKE = 24, 4, 32
POINTS = BANDS * ROWS
CENTRES = 2


def text_key(text: Column) -> Column:
    """16 bytes that tell texts apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _with_shingles(rows: DataFrame) -> DataFrame:
    """``rows`` with the text ``t`` replaced by its set of shingles."""
    rest = [c for c in rows.columns if c != "t"]
    words = rows.select(*rest, F.array_remove(F.split(F.lower("t"), SPACE), "").alias("words"))
    coded = words.select(*rest, F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
    n = F.size("codes")
    threes = F.zip_with(F.zip_with("codes", F.slice("codes", 2, n), lambda a, b: F.xxhash64(a, b)), F.slice("codes", 3, n), lambda a, b: F.xxhash64(a, b))
    three = coded.select(*rest, "codes", threes.alias("threes"))
    fives = F.slice(F.zip_with("threes", F.slice("threes", 3, n), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(n - 4, F.lit(1)))
    return three.select(*rest, F.array_distinct(F.when(n >= 5, fives).otherwise(F.array(F.xxhash64("codes")))).alias("set"))


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(text_key(F.col(text)).alias("text_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))


def _place(x: Column) -> Column:
    """The last of the points, numbered from -POINTS / 2 on, that ``x`` isn't below."""
    return F.shiftright(F.shiftright(x, 32) * POINTS, 32)


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text_key, node, n, bands, marks) per row: the set's name and size, and the keys and marks of its min-hashes,
    which take 288 bytes where the min-hashes themselves would take 768."""
    ordered = _with_shingles(_texts(docs, text)).select("text_key", F.sort_array("set").alias("set"))
    n = F.size("set")
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice("set", F.lit(1), n - 1))
    first = F.zip_with(before, "set", lambda a, b: F.when(a.isNull() | (_place(a) != _place(b)), b))
    firsts = ordered.select("text_key", F.xxhash64("set").alias("node"), n.alias("n"), F.filter(first, lambda x: x.isNotNull()).alias("firsts"))
    # Each stands for the places after the one before it, and the first also for those after the last.
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice("firsts", F.lit(1), F.size("firsts") - 1))
    own = F.zip_with(before, "firsts", lambda a, b: F.array_repeat(b, (_place(b) - F.coalesce(_place(a), F.lit(-POINTS // 2 - 1))).cast("int")))
    after = F.array_repeat(F.get("firsts", F.lit(0)), (F.lit(POINTS // 2 - 1) - _place(F.element_at("firsts", -1))).cast("int"))
    hashed = firsts.select("text_key", "node", "n", F.concat(F.flatten(own), after).alias("hashes"))
    bands = F.array(*[F.xxhash64(F.lit(k), *[F.get("hashes", F.lit(k * ROWS + i)) for i in range(ROWS)]) for k in range(BANDS)])
    return hashed.select("text_key", "node", "n", bands.alias("bands"), _marks(F.col("hashes")).alias("marks"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of nodes (a, b) that are near copies; J >= 0.8 is 9 * common >= 4 * (both sizes)."""
    a, b = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    # Written before each join, so that its sides are plain shuffles, of which Spark can split a hot node's.
    one = written(written(pairs).join(b, "b"))
    return one.join(a, "a").where(9 * F.size(F.array_intersect("set_a", "set_b")) >= 4 * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def _marks(hashes: Column) -> Column:
    return F.transform(hashes, lambda h: (h.bitwiseAND(F.lit(255)) - 128).cast("tinyint"))


def marked(nodes: DataFrame) -> DataFrame:
    """(node, n, marks): a byte of each min-hash, so that a pair carries few bytes. Different
    min-hashes have one mark in 256 cases, which only adds pairs to those that are decided exactly."""
    return nodes.select("node", "n", _marks(F.col("hashes")).alias("marks"))


def alike(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The ``pairs`` of nodes (a, b) whose sizes and min-hashes leave a similarity of 0.8 open: of as many
    min-hashes as there are, ``LIKE`` in ``POINTS`` have to be equal."""
    a, b = (marks.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("marks").alias(f"{x}_marks")) for x in "ab")
    sizes = (5 * F.col("a_n") >= 4 * F.col("b_n")) & (5 * F.col("b_n") >= 4 * F.col("a_n"))
    equal = F.size(F.filter(F.zip_with("a_marks", "b_marks", lambda x, y: x == y), lambda x: x))
    # Written before each join, as in ``similar``.
    return written(written(pairs).join(b, "b")).join(a, "a").where(sizes & (POINTS * equal >= LIKE * F.size("a_marks"))).select("a", "b")


def prefixes(sets: DataFrame) -> DataFrame:
    """(shingle, node, root, n, place): of each set (node, root, set) the shingles among the
    first n - ceil(4 n / 5) + 1 by frequency in ``sets``, and their places in that order,
    from 0. Shingles of one set alone hold the first places and are left out."""
    each = sets.select("node", "root", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    often = written(each.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1"))
    known = each.join(often, "shingle").groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("known"))
    alone = F.col("n") - F.size("known")
    length = F.greatest(F.floor(F.col("n") / 5) + 1 - alone, F.lit(0)).cast("int")
    cut = known.select("node", "root", "n", alone.alias("alone"), F.posexplode(F.slice("known", F.lit(1), length)).alias("i", "x"))
    return cut.select(F.col("x.shingle").alias("shingle"), "node", "root", "n", (F.col("alone") + F.col("i")).alias("place"))


def across(sets: DataFrame) -> DataFrame:
    """The pairs of nodes (a, b; a < b) of different roots that the prefix filter leaves, of ``sets``
    (node, root, set). The smaller set of a pair has the shingle within its first ninth, and
    the larger is of the same class of sizes or the next. Roots meet first, so that nodes of
    one root don't."""
    keys = written(prefixes(sets).withColumn("class", F.floor(F.log("n") / F.log(F.lit(1.25)))))
    a, b = (keys.select("shingle", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "root", "n", "place", "class")]) for x in "ab")
    a = a.where("9 * a_place <= a_n").withColumn("b_class", F.explode(F.array(F.col("a_class"), F.col("a_class") + 1))).drop("a_class")
    # Of a root's nodes at a shingle the most that one has left there and the least size: if these don't reach, no node does.
    best = [F.max(F.col(f"{c}_n") - F.col(f"{c}_place")) for c in "ab"]
    own = [x.groupBy("shingle", f"{c}_root", "b_class").agg(m.alias(f"{c}_most"), F.min(f"{c}_n").alias(f"{c}_low")) for c, x, m in (("a", a, best[0]), ("b", b, best[1]))]
    reach = lambda left, other, n, m: 9 * F.least(left, F.col(other)) >= 4 * (F.col(n) + F.col(m))
    meet = written(own[0].join(written(own[1]), ["shingle", "b_class"]).where(F.col("a_root") != F.col("b_root")).where(reach(F.col("a_most"), "b_most", "a_low", "b_low")))
    meet = meet.drop("a_most", "a_low")
    left_a, left_b = (F.col(f"{c}_n") - F.col(f"{c}_place") for c in "ab")
    one = meet.join(a, ["shingle", "a_root", "b_class"]).where(reach(left_a, "b_most", "a_n", "b_low")).drop("b_most", "b_low")
    order = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_node") < F.col("b_node")))
    found = one.join(b, ["shingle", "b_root", "b_class"]).where(order & (9 * F.least(left_a, left_b) >= 4 * (F.col("a_n") + F.col("b_n"))))
    return found.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def centres(met: DataFrame) -> DataFrame:
    """(band, centre) of the ``CENTRES`` nodes of each bucket that share buckets with most nodes, of rows
    (band, node, size): by the sum of their buckets' sizes, ties to the largest. A task keeps as many rows
    of a bucket at most before they are shuffled."""
    shares = written(met.groupBy("node").agg(F.sum("size").alias("shares")))
    order = Window.partitionBy("band").orderBy(F.desc("shares"), F.desc("node"))
    return written(met.join(shares, "node").select("band", "node", "shares").withColumn("i", F.row_number().over(order)).where(F.col("i") <= CENTRES).select("band", F.col("node").alias("centre")))


def twice_met(named: DataFrame) -> DataFrame:
    """(node, root) of the nodes that share two bands with a node of another root, of rows (band, node, root).
    Both bands then hold several roots, so only such bands are paired."""
    several = lambda rows, key: written(rows.groupBy(key).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select(key))
    own = named.join(several(named, "band"), "band").groupBy("node", "root").agg(F.sort_array(F.collect_set("band")).alias("bands")).where(F.size("bands") > 1)
    later = lambda i: F.slice("bands", i + 2, F.size("bands"))
    keys = F.flatten(F.transform("bands", lambda x, i: F.transform(later(i), lambda y: F.xxhash64(x, y))))
    pairs = written(own.select("node", "root", F.explode(keys).alias("key")))
    return pairs.join(several(pairs, "key"), "key").select("node", "root").distinct()


def roots(rows: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, root) of the nodes that have near copies with other shingle sets."""
    nodes = written(rows.groupBy("node").agg(F.first("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("n", "bands", "marks")]))
    buckets = nodes.select(F.explode("bands").alias("band"), "node")
    shared = written(buckets.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"))
    met = written(buckets.join(shared, "band"))
    which = written(nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "text_key"))
    sets = written(_with_shingles(written(_texts(docs, text).join(which, "text_key").select("node", "t").dropDuplicates(["node"]))))
    marks = nodes.select("node", "n", "marks")
    first = met.join(centres(met), "band").where("node != centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    links = written(similar(alike(first, marks), sets))
    # What the first step left apart.
    named = written(met.join(connected(links), "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")))
    apart = written(twice_met(named))
    more = written(similar(alike(across(written(apart.join(sets, "node").select("node", "root", "set"))), marks), sets))
    return connected(links.unionByName(more))


def groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text_key, near) per different text; texts with one ``near`` are near copies,
    or are joined by a chain of them."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/groups"
    with scratch(spark):
        rows = written(sketches(docs, text).dropDuplicates(["text_key"]))
        named = written(roots(rows, docs, text))
        return written(rows.select("text_key", "node").join(named, "node", "left").select("text_key", F.coalesce("root", "node").alias("near")), path)
