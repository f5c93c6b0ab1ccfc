"""Strings that a pattern can't match without."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from re import _constants as sre
from re import _parser as parser

#: Places between characters, which part no literal.
BETWEEN = {sre.AT, sre.ASSERT, sre.ASSERT_NOT}
REPEATS = {sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT}
GROUPS = {sre.ATOMIC_GROUP: 0, sre.SUBPATTERN: 3}


def _better(a: tuple[str, ...] | None, b: tuple[str, ...] | None) -> tuple[str, ...] | None:
    worth = lambda x: (min(map(len, x)), -len(x)) if x else (0, 0)
    return a if worth(a) >= worth(b) else b


def _of(items: Iterable) -> tuple[str, ...] | None:
    best, run = None, ""
    for op, arg in items:
        if op is sre.LITERAL:
            run += chr(arg)
            continue
        if op in BETWEEN:
            continue
        best, run = _better(best, (run,) if run else None), ""
        if op in GROUPS:
            best = _better(best, _of(arg if GROUPS[op] == 0 else arg[3]))
        elif op in REPEATS and arg[0] > 0:
            best = _better(best, _of(arg[2]))
        elif op is sre.BRANCH:
            each = [_of(x) for x in arg[1]]
            if all(each):
                best = _better(best, tuple(dict.fromkeys(s for x in each for s in x)))
    return _better(best, (run,) if run else None)


@lru_cache(maxsize=4096)
def required(pattern: str) -> tuple[str, ...] | None:
    """Strings of which every match of ``pattern`` contains one; null if none are known, as for a
    pattern that ignores case or that only Java's dialect knows."""
    if "&&" in pattern or re.search(r"\[[^\]]*\[|\(\?[a-zA-Z]", pattern):
        return None
    try:
        return _of(parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return None


def one_of(strings: Iterable[str]) -> str:
    """A pattern of the longest of ``strings`` at a place, with common beginnings told once."""
    heads: dict[str, list[str]] = {}
    ends = False
    for s in sorted(set(strings)):
        if s:
            heads.setdefault(s[0], []).append(s[1:])
        else:
            ends = True
    if not heads:
        return ""
    quoted = lambda c: re.escape(c) if c.isascii() else c
    each = []
    for c, rest in heads.items():
        each.append(quoted(c) + one_of(rest))
    return ("(?:" + "|".join(each) + ")" if len(each) > 1 or ends else each[0]) + ("?" if ends else "")
