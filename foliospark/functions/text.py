"""Column helpers that give Python's string semantics on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python has it: Unicode's, and the four separators that Java's (?U)\\s leaves out. The class lists
#: the characters, as Java tests a listed one many times faster than a Unicode property.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANK = r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_END = r"[\n\x0b\f\x1c-\x1e\x85\u2028\u2029]|\r\n?"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of c, with c computed once: what a lambda holds besides its arguments is computed for each element."""
    return F.get(F.transform(F.array(c), body), 0)


def rx(pattern: str, fold: bool = True) -> str:
    """pattern with Unicode classes, and with Unicode case folding unless fold is False."""
    return ("(?iU)" if fold else "(?U)") + pattern


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    # Most texts hold no blanks but lone spaces: looking for the others is many times faster than the pattern.
    one = lambda x: F.when(F.contains(x, F.lit("  ")) | holds(x, SPACES.replace(" ", "")), F.regexp_replace(x, f"{BLANK}+", " ")).otherwise(x)
    return strip(let(c, one))


def lines(c: Column) -> Column:
    """array<string>: as str.splitlines()."""
    ends = lambda x: F.when(holds(x, "\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029"), F.split(x, LINE_END, -1)).otherwise(F.split(x, "\n", -1))
    return let(let(c, ends), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def tokens(c: Column) -> Column:
    """array<string>: lower case, split at white space."""
    return F.filter(F.split(squeeze(F.lower(c)), " "), lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    """array<string>: runs of n words, joined by a space (words hold none)."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(words, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.array().cast("array<string>")))


def or_else(c: Column, other: Column) -> Column:
    """c, or other where c is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def either(c: Column, patterns: list[str]) -> Column:
    out = c.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | c.rlike(p)
    return out


def either_of(c: Column, parts: list[str]) -> Column:
    """Whether c holds one of the parts."""
    out = F.contains(c, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(c, F.lit(p))
    return out


def holds(c: Column, chars: str) -> Column:
    """Whether c holds one of the characters, of ASCII and others; texts in ASCII aren't searched for the latter."""
    plain, wide = [x for x in chars if x < "\x80"], [x for x in chars if x >= "\x80"]
    return either_of(c, plain) | ((F.octet_length(c) > F.length(c)) & either_of(c, wide))
