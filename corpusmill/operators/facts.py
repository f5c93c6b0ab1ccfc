"""What sources say, from sequences of tokens: messages of errors, calls, functions, imports.

Each function cuts facts out of a file's token array by the neighbours of a token, within the file's
row, and gives a row per fact. ``pre`` is the place of the fact's token, by which facts
meet the blocks around them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import glob_regex, let
from corpusmill.operators.blocks import innermost, tree_array
from corpusmill.operators.crossfile import reaching
from corpusmill.operators.tokens import code_only, neighbours

#: Macros that build or return an error, by their last name.
ERROR_MACROS = ("anyhow", "bail", "ensure", "eyre", "format_err")
#: Keywords that a bracket may follow without a call.
KEYWORDS = ("as", "catch", "else", "fn", "for", "function", "if", "impl", "in", "let", "loop", "match", "move", "mut", "pub", "ref", "return", "switch", "unsafe", "use", "where", "while")


def _rows(t: DataFrame, facts: Column) -> DataFrame:
    return t.select("path", F.explode_outer(facts).alias("f")).where("f is not null").select("path", "f.*")


def _near(t: DataFrame, before: int, after: int) -> DataFrame:
    """``t`` with the arrays ``code``, without blanks and comments, and ``near``, each token of it with its neighbours."""
    return t.withColumn("code", code_only(F.col("tokens"))).withColumn("near", neighbours(F.col("code"), before=before, after=after))


def _inner(text: Column) -> Column:
    """Without the first and the last character."""
    return F.substring(text, F.lit(2), F.length(text) - 2)


def error_messages(t: DataFrame, least: int = 10, macros: Sequence[str] = ERROR_MACROS) -> DataFrame:
    """(path, pre, line, column, text): strings of ``least`` characters or more anywhere inside the brackets of
    an error macro; raw strings don't count."""
    opened = F.filter("near", lambda x: x["t"]["text"].isin("(", "[", "{") & (x["b1"] == "!") & x["b2"].isin(*macros) & (x["t"]["pair"] >= 0))
    spans = F.transform(opened, lambda x: F.struct(x["t"]["i"].alias("i"), x["t"]["pair"].alias("end")))
    held = lambda x, spans: F.exists(spans, lambda s: (s["i"] < x["i"]) & (x["i"] < s["end"]))
    strings = let(spans, lambda sp: F.filter("code", lambda x: (x["kind"] == "string") & x["text"].startswith('"') & (F.length(x["text"]) >= least + 2) & held(x, sp)))
    return _rows(_near(t, 2, 0), F.transform(strings, lambda x: F.struct(x["i"].alias("pre"), x["line"].alias("line"), x["column"].alias("column"), _inner(x["text"]).alias("text"))))


def call_array(code: Column) -> Column:
    """The calls among a file's tokens, without blanks and comments, as structs, see ``calls``."""

    def is_call(x: Column, i: Column) -> Column:
        at = lambda k: F.get(code, i + k)["text"]
        plain = (at(1) == "(") & ~at(-1).eqNullSafe("fn") & ~at(-1).eqNullSafe("function")
        typed = (at(1) == ":") & (at(2) == ":") & (at(3) == "<") & (at(5) == ">") & (at(6) == "(")
        macro = (at(1) == "!") & at(2).isin("(", "[", "{")
        return (x["kind"] == "word") & F.coalesce(plain | typed | macro, F.lit(False)) & ~x["text"].isin(*KEYWORDS) & ~x["text"].rlike("^[0-9]")

    return F.transform(F.filter(code, is_call), lambda x: F.struct(x["i"].alias("pre"), x["line"].alias("line"), x["text"].alias("name")))


def calls(t: DataFrame) -> DataFrame:
    """(path, pre, line, name): functions and methods that are called, by their last names, with or without
    type arguments, and macros that are invoked."""
    return _rows(t, let(code_only(F.col("tokens")), call_array))


FUNCTION = r"\bfn (\w+)"


def _is_test(head: Column) -> Column:
    return head.rlike(r"#\[(?:\w+::)*\w*test\w*(?:\(|\])") & ~head.rlike(r"#\[should_panic")


def functions(blocks: DataFrame) -> DataFrame:
    """(path, name, is_test, pre, post, line): Rust functions and their bodies, by the heads of blocks; a test has an
    attribute whose last name says so."""
    head = F.col("head")
    return blocks.where(head.rlike(FUNCTION)).select("path", F.regexp_extract(head, FUNCTION, 1).alias("name"), _is_test(head).alias("is_test"), "pre", "post", "line")


def file_facts(t: DataFrame) -> DataFrame:
    """(path, blocks, functions, calls) per file: arrays of what ``block_tree``, ``functions`` and ``calls`` give rows of,
    each call with its ``owner`` (name, pre), the innermost function around it, or null. They meet within
    the file's row; nothing is shuffled, and the tokens are read once."""
    function = lambda b: F.struct(F.regexp_extract(b["head"], FUNCTION, 1).alias("name"), _is_test(b["head"]).alias("is_test"), b["pre"].alias("pre"), b["post"].alias("post"), b["line"].alias("line"))

    def owned(c: Column, functions: Column) -> Column:
        around = F.filter(functions, lambda f: (f["pre"] < c["pre"]) & (c["pre"] < f["post"]))
        owner = F.transform(F.slice(around, -1, 1), lambda f: F.struct(f["name"].alias("name"), f["pre"].alias("pre")))
        return F.struct(c["pre"].alias("pre"), c["line"].alias("line"), c["name"].alias("name"), F.get(owner, F.lit(0)).alias("owner"))

    def facts(blocks: Column, code: Column) -> Column:
        functions = F.transform(F.filter(blocks, lambda b: b["head"].rlike(FUNCTION)), function)
        return let(functions, lambda fs: F.struct(blocks.alias("blocks"), fs.alias("functions"), F.transform(call_array(code), lambda c: owned(c, fs)).alias("calls")))

    tokens = F.col("tokens")
    return t.select("path", let(tree_array(tokens), lambda b: let(code_only(tokens), lambda c: facts(b, c))).alias("f")).select("path", "f.*")


def each(files: DataFrame, name: str) -> DataFrame:
    """A row per entry of one of the arrays of ``file_facts``, with the path."""
    return _rows(files, F.col(name))


def owned_calls(t: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(path, owner, owner_pre, name, line): each call with the innermost function around it; calls outside of
    functions are left out. The functions are those of the files themselves, or of ``blocks``, which a join brings."""
    if blocks is None:
        return owned_rows(file_facts(t))
    met = innermost(calls(t), functions(blocks), "name", "pre")
    return met.where("outer_pre is not null").select("path", F.col("outer_name").alias("owner"), F.col("outer_pre").alias("owner_pre"), "name", "line")


def owned_rows(files: DataFrame) -> DataFrame:
    """``owned_calls`` of ``file_facts``."""
    return each(files, "calls").where("owner is not null").select("path", F.col("owner.name").alias("owner"), F.col("owner.pre").alias("owner_pre"), "name", "line")


def rust_uses(t: DataFrame) -> DataFrame:
    """(path, line, root, name, glob): a row per name that a ``use`` binds, an alias before the name it stands for, and
    ``self`` as the name before its brackets; a glob binds no name. ``root`` is the path's first
    name, null for a list without one."""
    near = _near(t, 3, 3)
    begins = F.filter("near", lambda n: (n["t"]["text"] == "use") & (n["t"]["kind"] == "word") & ~n["a1"].isin("<", "(", ".", "="))
    root = lambda n: F.when(n["a1"] == ":", n["a3"]).when(n["a1"] != "{", n["a1"])
    stops = F.transform(F.filter("code", lambda x: (x["text"] == ";") & (x["kind"] == "sign")), lambda x: x["i"])
    end = lambda n, stops: F.array_min(F.filter(stops, lambda s: s > n["t"]["i"]))
    uses = let(stops, lambda st: F.transform(begins, lambda n: F.struct(n["t"]["i"].alias("i"), n["t"]["line"].alias("line"), root(n).alias("root"), end(n, st).alias("end"))))
    of_list = lambda n: F.get(F.filter("near", lambda m: m["t"]["i"] == n["t"]["parent"]), F.lit(0))["b3"]
    name = lambda n: F.when(n["t"]["text"] == "self", of_list(n)).when(n["t"]["text"] != "*", n["t"]["text"])

    def names(u: Column) -> Column:
        own = F.filter("near", lambda n: (n["t"]["i"] > u["i"]) & (n["t"]["i"] < u["end"]) & n["a1"].isin(",", "}", ";") & ((n["t"]["kind"] == "word") | (n["t"]["text"] == "*")))
        return F.transform(own, lambda n: F.struct(u["line"].alias("line"), u["root"].alias("root"), name(n).alias("name"), (n["t"]["text"] == "*").alias("glob")))

    return _rows(near, F.flatten(F.transform(uses, names)))


def script_imports(t: DataFrame) -> DataFrame:
    """(path, line, column, specifier): modules that a TypeScript file imports, at the import, or requires, at the
    string. Imports of types alone and exports from elsewhere don't count."""
    starts = F.filter("near", lambda n: (n["t"]["text"] == "import") & (n["t"]["kind"] == "word"))
    starts = F.transform(starts, lambda n: F.struct(n["t"]["i"].alias("i"), n["t"]["line"].alias("line"), n["t"]["column"].alias("column"), n["a1"].alias("next")))
    strings = F.transform(F.filter("code", lambda x: x["kind"] == "string"), lambda x: x["i"])
    fact = lambda place, n: F.struct(place["line"].alias("line"), place["column"].alias("column"), _inner(n["t"]["text"]).alias("specifier"))

    def told(n: Column, starts: Column, strings: Column) -> Column:
        begun = F.try_element_at(F.filter(starts, lambda s: s["i"] < n["t"]["i"]), F.lit(-1))
        between = lambda s: F.exists(strings, lambda k: (k > s["i"]) & (k < n["t"]["i"]))
        imported = let(begun, lambda s: F.when((s["next"] != "type") & ~between(s), fact(s, n)))
        return F.when(n["t"]["kind"] != "string", None).when(n["b1"].isin("from", "import"), imported).when((n["b1"] == "(") & (n["b2"] == "require"), fact(n["t"], n))

    found = let(starts, lambda st: let(strings, lambda ss: F.transform("near", lambda n: told(n, st, ss))))
    return _rows(_near(t, 2, 1), F.filter(found, lambda x: x.isNotNull()))


def asserting(helpers: DataFrame, calls: DataFrame, globs: Sequence[str] = ()) -> DataFrame:
    """(scope, name) of the helpers that assert something. ``helpers``: (scope, name, asserts); ``calls``: (scope, name,
    callee_scope, callee), the callee's scope as the call resolves. A helper asserts itself, calls a
    function that one of ``globs`` names, or calls a helper that asserts; only what the last
    round added is looked at in the next."""
    key = lambda *c: F.concat_ws("\0", *c)
    own = helpers.where("asserts").select(key("scope", "name").alias("node"))
    if globs:
        told = calls.where(F.col("callee").rlike("|".join(map(glob_regex, globs)))).select(key("scope", "name").alias("node"))
        own = own.unionByName(told.join(helpers.select(key("scope", "name").alias("node")), "node", "left_semi"))
    # A call that resolves nowhere leads to no helper.
    edges = calls.where("callee_scope is not null").select(key("scope", "name").alias("caller"), key("callee_scope", "callee").alias("callee"))
    known = helpers.select(key("scope", "name").alias("caller"))
    found = reaching(edges.join(known, "caller", "left_semi"), own.distinct())
    return found.select(F.split_part("node", F.lit("\0"), F.lit(1)).alias("scope"), F.split_part("node", F.lit("\0"), F.lit(2)).alias("name"))


def resolved_calls(calls: DataFrame, helpers: DataFrame, imports: DataFrame) -> DataFrame:
    """``calls`` (path, root, owner, name) with the scope in which each name is found: the file itself before an import
    (path, name, scope) before the file's root; null if nowhere. ``helpers``: (scope, name), a scope being
    a file or a root."""
    known = helpers.select("scope", "name").distinct()
    brought = imports.join(known, ["scope", "name"], "left_semi").groupBy("path", "name").agg(F.min("scope").alias("brought"))
    own, above = (known.select(F.col("scope").alias(k), "name", F.col("scope").alias(c)) for k, c in (("path", "own"), ("root", "above")))
    met = calls.join(own, ["path", "name"], "left").join(brought, ["path", "name"], "left").join(above, ["root", "name"], "left")
    return met.select("path", "name", *[c for c in calls.columns if c not in ("path", "name")], F.coalesce("own", "brought", "above").alias("callee_scope"))
