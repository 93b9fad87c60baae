"""Boolean trigram queries derived from regular expressions.

A query is in disjunctive form: a list of clauses, each a frozenset of trigrams that a
matching text must all contain; None means that no trigram is mandatory. Letters are
lower-cased, as the index is, so a query never excludes a text that matches.
"""

from __future__ import annotations

import re
from itertools import product

try:
    from re import _constants as codes
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as codes
    import sre_parse as parser

MOST_STRINGS = 64
MOST_CHARS = 4

Clauses = list[frozenset[str]] | None


def _of_strings(strings: set[str]) -> Clauses:
    """The query of: the text contains one of these strings."""
    if any(len(s) < 3 for s in strings):
        return None
    return _least([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _least(clauses: list[frozenset[str]]) -> list[frozenset[str]]:
    """Without clauses that another one implies."""
    once = sorted(set(clauses), key=lambda c: (len(c), sorted(c)))
    return [c for i, c in enumerate(once) if not any(d < c or d == c for d in once[:i])]


def _and(a: Clauses, b: Clauses) -> Clauses:
    if a is None or b is None:
        return b if a is None else a
    return _least([x | y for x, y in product(a, b)]) if len(a) * len(b) <= MOST_STRINGS else a


def _or(parts: list[Clauses]) -> Clauses:
    return None if any(p is None for p in parts) else _least([c for p in parts for c in p])


def _class(items) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if op is codes.LITERAL:
            found.add(chr(arg).lower())
        elif op is codes.RANGE and arg[1] - arg[0] < 2 * MOST_CHARS:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_CHARS else None


def _one(op, arg) -> tuple[set[str] | None, Clauses]:
    """Of one parsed item: the strings that it can match, if they're few, and else its query."""
    if op is codes.LITERAL:
        return {chr(arg).lower()}, None
    if op is codes.IN:
        return _class(arg), None
    if op is codes.SUBPATTERN:
        return _sequence(arg[-1])
    if op is codes.AT:
        return {""}, None
    if op is codes.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and len(joined := set().union(*(s for s, _ in parts))) <= MOST_STRINGS:
            return joined, None
        return None, _or([q if s is None else _of_strings(s) for s, q in parts])
    if op in (codes.MAX_REPEAT, codes.MIN_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, None
        if strings is not None and least == most and len(strings) ** least <= MOST_STRINGS:
            return {"".join(x) for x in product(strings, repeat=least)}, None
        return None, (query if strings is None else _of_strings(strings)) if least else None
    return None, None


def _sequence(items) -> tuple[set[str] | None, Clauses]:
    strings: set[str] = {""}
    query: Clauses = None
    whole = True
    for op, arg in items:
        s, q = _one(op, arg)
        if s is not None and len(strings) * len(s) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in s}
            continue
        query = _and(query, _of_strings(strings))
        whole, strings = False, s if s is not None else {""}
        query = _and(query, q)
    return (strings, None) if whole else (None, _and(query, _of_strings(strings)))


def query(pattern: str) -> Clauses:
    """The trigram query of a regular expression, or None: texts must be scanned fully."""
    strings, found = _sequence(parser.parse(pattern, re.ASCII))
    return found if strings is None else _of_strings(strings)
