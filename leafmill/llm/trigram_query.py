"""Boolean trigram queries derived from regular expressions.

A query is a conjunction of clauses; a clause is a disjunction of alternatives; an alternative is a
set of trigrams that must all occur. Every text that the regex matches satisfies the query, so texts
that do not can be skipped. Trigrams are of the lower-cased text, which serves both case modes.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

Clause = list[frozenset[str]]

#: A literal set larger than this is not multiplied out any further.
MAX_STRINGS = 32


def _strings(item: tuple) -> set[str] | None:
    """The finite set of lower-cased strings that one parsed item matches, or None."""
    kind, arg = item
    if kind is op.LITERAL:
        return {chr(arg).lower()}
    if kind is op.IN:
        found: set[str] = set()
        for k, a in arg:
            if k is op.LITERAL:
                found.add(chr(a).lower())
            elif k is op.RANGE and a[1] - a[0] < MAX_STRINGS:
                found |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return found if len(found) <= MAX_STRINGS else None
    if kind is op.SUBPATTERN:
        return _product(arg[3])
    if kind is op.BRANCH:
        found = set()
        for branch in arg[1]:
            part = _product(branch)
            if part is None:
                return None
            found |= part
        return found
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, body = arg
        part = _product(body)
        if part is None or high is op.MAXREPEAT or high > 4:
            return None
        found, power = ({""} if low == 0 else set()), {""}
        for n in range(1, high + 1):
            power = {a + b for a in power for b in part}
            if n >= low:
                found |= power
        return found if len(found) <= MAX_STRINGS else None
    return None


def _product(items) -> set[str] | None:
    out = {""}
    for item in items:
        part = _strings(item)
        if part is None or len(out) * len(part) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _clause(strings: set[str]) -> Clause | None:
    """Some string of the set occurs; None where one of them is too short to have a trigram."""
    if any(len(s) < 3 for s in strings):
        return None
    sets = {_trigrams(s) for s in strings}
    # An alternative that asks for more than another one does adds nothing to the disjunction.
    return sorted((a for a in sets if not any(b < a for b in sets)), key=sorted)


def _query(items) -> list[Clause]:
    clauses: list[Clause] = []
    run = {""}

    def close() -> None:
        clause = _clause(run)
        if clause is not None:
            clauses.append(clause)

    for item in items:
        part = _strings(item)
        if part is not None and len(run) * len(part) <= MAX_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        close()
        run = part if part is not None else {""}
        if part is None:
            kind, arg = item
            if kind is op.SUBPATTERN:
                clauses += _query(arg[3])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] >= 1:
                clauses += _query(arg[2])
    close()
    return clauses


def trigram_query(pattern: str) -> list[Clause]:
    """The clauses that every match of ``pattern`` satisfies; an empty list means a full scan."""
    return _query(parser.parse(pattern, re.DOTALL))
