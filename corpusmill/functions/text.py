"""Scalar functions on columns: lines, positions, paths, hashes, escapes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_lines(text: Column) -> Column:
    """Lines without their ends; a last line end opens no further line."""
    parts = F.split(text, "\r?\n")
    n = F.size(parts)
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, 1, n - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(newlines + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")


def byte_column(line: Column, char_column: Column) -> Column:
    """The 1-based byte column of a 1-based character column."""
    return (F.octet_length(F.substring(line, F.lit(1), char_column - 1)) + 1).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def matches(line: Column, pattern: Column) -> Column:
    """All matches in a line, of a pattern that may differ from row to row, as structs (at, text), ``at`` in characters from 1 on; null
    if there are none. What lies between the matches gives their places, so that
    patterns may look around them."""

    def placed(found: Column) -> Column:
        between = F.slice(F.split(line, pattern, -1), F.lit(1), F.size(found))
        parts = F.zip_with(between, found, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("text")))
        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,text:string>>").alias("out"))
        step = lambda s, p: F.struct(
            (s["next"] + p["gap"] + F.length(p["text"])).alias("next"),
            F.concat(s["out"], F.array(F.struct((s["next"] + p["gap"]).alias("at"), p["text"].alias("text")))).alias("out"),
        )
        return F.aggregate(parts, start, step, lambda s: s["out"])

    return let(F.regexp_extract_all(line, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1)), lambda found: F.when(F.size(found) > 0, placed(found)))


def glob_regex(glob: str) -> str:
    """A whole-path pattern: ``**`` crosses folders, ``*`` and ``?`` do not, ``{a,b}`` is either."""
    out, depth, i = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


#: Names of folders and endings of stems that stand for tests.
TEST_PATHS = (
    r"(^|/)(tests|benches|examples|fixtures|__tests__|[^/]*_tests?|test_[^/]*)/",
    r"(^|/)([^/]*_tests?|tests?|[^/]*\.(spec|test))\.[^./]+$",
    r"(^|/)test_[^/]*$",
)


def test_path(path: Column) -> Column:
    """Whether a path looks like that of a test: a folder named for tests, or a
    file whose stem ends like one."""
    return reduce(lambda a, b: a | b, [path.rlike(x) for x in TEST_PATHS])


def ancestors(path: Column) -> Column:
    """The folders above a path, the nearest last; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def keyed(*parts: Column) -> Column:
    """SHA-256 of NUL-joined parts."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def hmac_sha256(key: Column, message: Column) -> Column:
    """The HMAC-SHA256 of a message under a key, both strings or binary, in lower-case hex. A key of more than 64
    bytes is hashed first; it is padded to 64, and each byte is combined with the two fixed ones."""
    raw = key.cast("binary")
    short = F.when(F.octet_length(raw) > 64, F.sha2(raw, 256)).otherwise(F.hex(raw))
    padded = F.rpad(short, 128, "0")

    def with_each(byte: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(padded, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(byte)))
        return F.unhex(F.array_join(F.transform(each, lambda x: F.lpad(F.hex(x), 2, "0")), ""))

    inner = F.unhex(F.sha2(F.concat(with_each(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(with_each(0x5C), inner), 256)


def similarity(a: Column, b: Column) -> Column:
    """Normalised Levenshtein: 1 for equal strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def strip_control(text: Column, most: int = 500) -> Column:
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", ""), 1, most)


def interpolate(message: Column, **values: Column) -> Column:
    for name, value in values.items():
        message = F.replace(message, F.lit(f"${name}"), value)
    return message


def url_host(url: Column) -> Column:
    """The host, without credentials and port."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_extract(rest, r"^(?:.*@)?([^@:]*)(?::[0-9]*)?$", 1)


def package_root(specifier: Column) -> Column:
    """``@scope/name/x`` is of ``@scope/name``, ``name/x`` of ``name``."""
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])


def words_of(name: Column) -> Column:
    """The words of an identifier in any style, in lower case: cut at what is neither
    letter nor digit, before a capital after a small letter or digit, and before the
    last of several capitals that a small letter follows."""
    apart = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.array_remove(F.split(F.lower(apart), "[^a-z0-9]+"), "")


STYLES = ("snake_case", "kebab-case", "SCREAMING_SNAKE_CASE", "camelCase", "PascalCase", "Train-Case", "lowercase", "UPPERCASE", "Title Case")


def to_style(name: Column, style: str) -> Column:
    """An identifier written anew in a style."""
    words = words_of(name)
    titled = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    if style == "camelCase":
        return F.concat(F.coalesce(words[0], F.lit("")), F.array_join(F.slice(titled, F.lit(2), F.greatest(F.size(titled) - 1, F.lit(0))), ""))
    joint = {"snake_case": "_", "kebab-case": "-", "SCREAMING_SNAKE_CASE": "_", "Train-Case": "-", "Title Case": " "}.get(style, "")
    out = F.array_join(titled if style in ("PascalCase", "Train-Case", "Title Case") else words, joint)
    return F.upper(out) if style in ("SCREAMING_SNAKE_CASE", "UPPERCASE") else out


def style_of(name: Column) -> Column:
    """The first style in which a name of several words is written, or null."""
    out = F.lit(None).cast("string")
    for style in reversed(STYLES):
        out = F.when(to_style(name, style) == name, style).otherwise(out)
    return F.when(F.size(words_of(name)) > 1, out)


def utc(seconds: Column) -> Column:
    """Epoch seconds as a UTC time, without regard to the session's zone; a year of five digits or more has no sign."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    return F.concat(F.lpad(F.year(day).cast("string"), F.greatest(F.length(F.year(day).cast("string")), F.lit(4)), F.lit("0")), F.date_format(day, "-MM-dd"), F.format_string("T%02d:%02d:%02dZ", F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60, seconds % 60))
