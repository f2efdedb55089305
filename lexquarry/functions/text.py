"""Column functions on text that several operators share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space, as a set of ranges for patterns (of Java and of RE2 alike), and as characters.
WHITE_RANGES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


#: White space for Java's patterns only, which letters of ASCII leave after two tests.
WHITE_SOON = rf"[\t-\x20\x{{85}}-\x{{3000}}&&[{WHITE_RANGES}]]"


def white(pattern: str) -> str:
    r"""A pattern whose \s and \S mean all white space, not that of ASCII only."""
    out, inside, k = [], False, 0
    pattern = pattern.replace(r"[^\S\n]", "[" + WHITE_RANGES.replace(r"\t-\r", r"\t\x0b-\r") + "]")
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(WHITE_RANGES if inside else f"[{WHITE_RANGES}]")
        elif two == r"\S":
            if inside:
                raise ValueError("what isn't white space within a set")
            out.append(f"[^{WHITE_RANGES}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            k -= 1
        k += 2
    return "".join(out)


def white_sql(sql: str) -> str:
    """SQL with white() of each quoted text."""
    return re.sub(r"'[^']*'", lambda m: white(m[0]) if r"\s" in m[0] or r"\S" in m[0] else m[0], sql)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """The text without white space at its ends; null as empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))


def words(text: Column) -> Column:
    """What stands between white space."""
    return F.array_remove(F.split(text, WHITE_SOON + "+"), "")
