"""Literals that a pattern can't match without: a cheap test before the pattern itself.

`required` reads a pattern's structure and gives sets of strings, of each of which every matching text holds at least one. The
test costs a plain substring search a string; a text that holds none of a set is spared the pattern. It never makes
a match go missing: where nothing is certain (classes, optional parts), there is no set and the pattern is tried.

`joint` makes one pattern of many for RE2, whose automaton reads a text once for all of them: a text that it doesn't
match is matched by none in Java's engine either. It widens each pattern where the engines differ, and gives none if in doubt.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings in a set, and sets that are tested before one pattern, at most.
MOST, SETS = 16, 2


def _worth(found: frozenset[str]) -> tuple[int, int]:
    """The longer the shortest string and the fewer strings, the more a set is worth."""
    return min(map(len, found)), -len(found)


def _walk(items) -> list[frozenset[str]]:
    """Sets of strings, of each of which a matching text holds one; the best set first."""
    sets, text = [], ""
    for op, arg in [*items, (None, None)]:
        if op is C.LITERAL:
            text += chr(arg)
            continue
        if text:
            sets, text = [*sets, frozenset([text])], ""
        if op is C.IN and len(arg) <= 4 and all(o is C.LITERAL for o, _ in arg):
            sets.append(frozenset(chr(c) for _, c in arg))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            sets += _walk(arg[2])
        elif op is C.SUBPATTERN:
            sets += _walk(arg[3])
        elif op is C.ATOMIC_GROUP:
            sets += _walk(arg)
        elif op is C.BRANCH and all(each := [_walk(b) for b in arg[1]]):
            sets.append(frozenset().union(*(e[0] for e in each)))
    return sorted({s for s in sets if len(s) <= MOST}, key=lambda s: (_worth(s), sorted(s)), reverse=True)


def _folds(items) -> bool:
    """Whether a part of the pattern ignores case."""
    for op, arg in items:
        if op is C.SUBPATTERN and (arg[1] & re.IGNORECASE or _folds(arg[3])):
            return True
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and _folds(arg[2]):
            return True
        if op is C.BRANCH and any(_folds(b) for b in arg[1]):
            return True
        if op is C.ATOMIC_GROUP and _folds(arg):
            return True
    return False


def required(pattern: str) -> tuple[list[frozenset[str]], bool]:
    """(sets, fold): every text that the pattern matches holds a string of each set, in lower case if `fold`."""
    try:
        tree = P.parse(pattern)
    except re.error:
        return [], False  # a form of Java's own
    fold = bool(tree.state.flags & re.IGNORECASE) or _folds(tree)
    sets = [s for s in _walk(tree) if not fold or all(x.isascii() for x in s)]
    return [frozenset(x.lower() for x in s) if fold else s for s in sets[:SETS]], fold


def may_match(pattern: str, text: Column, lower: Column) -> Column | None:
    """The test on a text and its lower case, or None."""
    sets, fold = required(pattern)
    held = [reduce(lambda a, b: a | b, [(lower if fold else text).contains(s) for s in sorted(found)]) for found in sets]
    return reduce(lambda a, b: a & b, held) if held else None


#: What RE2 reads as Java does, or more widely: escapes of letters, and openings of groups.
_ESCAPES, _GROUP = set("sSwWdDtrnfx"), re.compile(r"(?<!\\)(?:\\\\)*\(\?(?!:|i:|i\))")


def widened(pattern: str) -> str | None:
    r"""A pattern of RE2 that matches wherever Java's engine matches `pattern`, or None: no word edges, \s with \x0B, `$` before any line terminator."""
    if _GROUP.search(pattern) or any(x in pattern for x in ("&&", "[]", "[^]")):
        return None
    out, i, inside, negated = "", 0, False, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1 : i + 2]
            if e.isalnum() and e not in _ESCAPES and (e not in "bB" or inside) or (e == "S" and negated):
                return None
            if e == "s" and not negated:
                out += r"\s\x0b" if inside else r"[\s\x0b]"
            elif e not in ("b", "B"):
                out += c + e
            i += 2
            continue
        if inside and c == "[":
            return None  # Java's classes nest
        if c == "[":
            inside, negated = True, pattern[i + 1 : i + 2] == "^"
        elif c == "]":
            inside = negated = False
        out += r"(?:[\r\x{85}\x{2028}\x{2029}]?$)" if c == "$" and not inside else c
        i += 1
    return f"(?:{out})"


def joint(patterns: list[str]) -> str | None:
    """One pattern of RE2 for all, or None where one of them has no sure form."""
    import pyarrow as pa
    import pyarrow.compute as pc

    wide = [widened(p) for p in patterns]
    if not wide or None in wide:
        return None
    try:
        pc.match_substring_regex(pa.array([""]), "|".join(wide))
    except pa.ArrowInvalid:
        return None
    return "|".join(wide)


def may_match_any(pattern: str, text: Column) -> Column:
    """Whether a pattern of joint() matches a text; texts that aren't UTF-8 may. Equal texts of a batch are read once."""

    def match(texts):
        import pyarrow.compute as pc

        coded = texts.dictionary_encode()
        return pc.match_substring_regex(coded.dictionary, pattern).take(coded.indices)

    return F.arrow_udf(match, "boolean")(text) | ~F.is_valid_utf8(text)


def readable(pattern: str) -> bool:
    """Whether RE2 takes the pattern."""
    import pyarrow as pa
    import pyarrow.compute as pc

    try:
        pc.count_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return False
    return True


def pattern_counts(text: Column, patterns: list[str]) -> Column:
    """Array of each pattern's matches in a text that isn't null, by RE2."""

    def count(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        each = [pc.cast(pc.count_substring_regex(texts, p), pa.int32()).to_numpy(zero_copy_only=False) for p in patterns]
        flat = np.stack(each, axis=1).ravel() if each else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(patterns), flat.astype(np.int32))

    return F.arrow_udf(count, "array<int>")(text)
