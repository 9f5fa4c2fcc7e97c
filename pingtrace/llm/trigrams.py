"""Boolean trigram queries that every match of a regular expression must satisfy.

A query is a list of groups, all of which must hold; a group is a set of
alternatives, one of which must hold; an alternative is a set of trigrams that
must all occur in the lower-cased text. No group means: nothing is mandatory.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser

MOST_STRINGS = 64
_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)
Strings = frozenset[str]


def _product(a: Strings, b: Strings) -> Strings | None:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= MOST_STRINGS else None


def _of_class(items: list) -> Strings | None:
    """The strings of a small character class."""
    found = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(found) if len(found) <= 8 else None


def _of_node(kind, value) -> tuple[Strings | None, list[Strings]]:
    """All strings that a node matches if they are few, else the literal groups that its matches hold."""
    if kind is op.LITERAL:
        return frozenset([chr(value).lower()]), []
    if kind is op.IN:
        return _of_class(value), []
    if kind is op.SUBPATTERN:
        return _of_sequence(value[3])
    if kind is op.ATOMIC_GROUP:
        return _of_sequence(value)
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return frozenset([""]), []
    if kind is op.BRANCH:
        branches = [_of_sequence(b) for b in value[1]]
        if all(exact is not None for exact, _ in branches):
            union = frozenset().union(*(exact for exact, _ in branches))
            return (union, []) if len(union) <= MOST_STRINGS else (None, [])
        held = [groups or ([exact] if exact else []) for exact, groups in branches]
        return None, [frozenset().union(*(g[0] for g in held))] if all(held) else []
    if kind in _REPEATS:
        least, most, body = value
        exact, groups = _of_sequence(body)
        if (least, most) == (0, 1) and exact is not None:
            return exact | {""}, []
        if least == most == 1:
            return exact, groups
        return None, ([exact] if exact is not None else groups) if least else []
    return None, []


def _of_sequence(nodes) -> tuple[Strings | None, list[Strings]]:
    current, groups, whole = frozenset([""]), [], True
    for kind, value in nodes:
        exact, inner = _of_node(kind, value)
        longer = _product(current, exact) if exact is not None else None
        if longer is not None:
            current = longer
            continue
        whole = False
        groups.append(current)
        groups += inner
        current = exact if exact is not None else frozenset([""])
    return (current, []) if whole else (None, [*groups, current])


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Groups of alternatives of trigrams, as the module describes."""
    exact, groups = _of_sequence(_parser.parse(pattern))
    query = []
    for strings in [exact] if exact is not None else groups:
        if all(len(s) >= 3 for s in strings):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            # An alternative that asks for more than another is never needed.
            query.append(sorted((a for a in sets if not any(b < a for b in sets)), key=sorted))
    return query
