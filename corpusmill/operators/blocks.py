"""Pairs of brackets of source files as a tree, told by nested sets.

A block's ``pre`` and ``post`` are the places of its brackets among the file's tokens, so that one
block lies inside another if its interval does, and ``parent`` names the innermost one
around it. Relations are joins on the file and an interval or the parent; a file's rows meet in
one task, files are spread. ``head`` is what stands before an opening brace since the last
item ended at its level: the name and attributes of the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _told(token: Column) -> Column:
    """A token's text; a comment counts as a blank."""
    return F.when(token["kind"].isin("comment", "doc_comment"), " ").otherwise(token["text"])


def tree_array(tokens: Column) -> Column:
    """The blocks of a file's tokens as structs, see ``block_tree``, in order of ``pre``."""
    opened = F.filter(tokens, lambda x: x["text"].isin("{", "(", "[") & (x["kind"] == "sign") & (x["pair"] >= 0))
    words = lambda x: F.transform(F.slice(tokens, x["head"] + 1, x["i"] - x["head"]), _told)
    head = lambda x: F.when(x["text"] == "{", F.trim(F.regexp_replace(F.array_join(words(x), ""), r"\s+", " "))).otherwise("")

    def block(x: Column) -> Column:
        end = F.get(tokens, x["pair"])
        return F.struct(
            x["text"].alias("kind"), x["parent"].alias("parent"), x["i"].alias("pre"), x["pair"].alias("post"), x["level"].alias("level"), x["line"].alias("line"),
            x["column"].alias("column"), end["line"].alias("end_line"), (end["column"] + 1).alias("end_column"), head(x).alias("head"),
        )

    return F.transform(opened, block)


def block_tree(t: DataFrame) -> DataFrame:
    """(path, lang, kind, parent, pre, post, level, line, column, end_line, end_column, head) of token arrays ``t``:
    a row per matched pair; ``kind`` is the opening bracket, ``parent`` the ``pre`` of the block around
    it, or -1, ``level`` the number of blocks around it."""
    return t.select("path", "lang", F.explode_outer(tree_array(F.col("tokens"))).alias("b")).where("b is not null").select("path", "lang", "b.*")


def _within(inner: DataFrame, outer: DataFrame, how: str, neighbour: bool) -> DataFrame:
    o = outer.select(F.col("path").alias("o_path"), F.col("pre").alias("o_pre"), F.col("post").alias("o_post"))
    end = F.col("post") if "post" in inner.columns else F.col("pre")
    on = (F.col("path") == F.col("o_path")) & ((F.col("parent") == F.col("o_pre")) if neighbour else (F.col("o_pre") < F.col("pre")) & (end < F.col("o_post")))
    return inner.join(o, on, how)


def inside(rows: DataFrame, outer: DataFrame, neighbour: bool = False) -> DataFrame:
    """The ``rows`` (path, pre, and post if they are blocks, parent) that lie inside one of ``outer``;
    with ``neighbour`` only those right inside."""
    return _within(rows, outer, "left_semi", neighbour)


def not_inside(rows: DataFrame, outer: DataFrame, neighbour: bool = False) -> DataFrame:
    return _within(rows, outer, "left_anti", neighbour)


def has(blocks: DataFrame, inner: DataFrame, neighbour: bool = False, negate: bool = False) -> DataFrame:
    """The ``blocks`` that have one of ``inner`` (path, pre, parent) inside, or none if ``negate``."""
    i = inner.select(F.col("path").alias("i_path"), F.col("pre").alias("i_pre"), F.col("parent").alias("i_parent"))
    on = (F.col("path") == F.col("i_path")) & ((F.col("i_parent") == F.col("pre")) if neighbour else (F.col("pre") < F.col("i_pre")) & (F.col("i_pre") < F.col("post")))
    return blocks.join(i, on, "left_anti" if negate else "left_semi")


def innermost(rows: DataFrame, outer: DataFrame, *columns: str) -> DataFrame:
    """``rows`` (path, pre) with ``columns`` of the innermost block of ``outer`` around each, or null."""
    o = outer.select(F.col("path").alias("o_path"), F.col("pre").alias("o_pre"), F.col("post").alias("o_post"), *[F.col(c).alias(f"o_{c}") for c in columns if c not in ("path", "pre", "post")])
    held = lambda c: F.col(f"o_{c}")
    met = rows.join(o, (F.col("path") == F.col("o_path")) & (F.col("o_pre") < F.col("pre")) & (F.col("pre") < F.col("o_post")), "left")
    best = met.groupBy(*rows.columns).agg(F.max_by(F.struct(*[held(c).alias(c) for c in columns]), "o_pre").alias("best"))
    return best.select(*rows.columns, *[F.col(f"best.{c}").alias(f"outer_{c}") for c in columns])


def siblings(blocks: DataFrame) -> DataFrame:
    """``blocks`` with their place among those of one parent, from 1 on, and the heads before and after."""
    w = Window.partitionBy("path", "parent").orderBy("pre")
    return blocks.select("*", F.row_number().over(w).alias("nth"), F.lag("head").over(w).alias("before_head"), F.lead("head").over(w).alias("after_head"))
