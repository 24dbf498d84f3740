"""Literals that every match of a pattern holds, so that a text without them needs no regular expression."""

from __future__ import annotations

from re import _constants as C
from re import _parser

#: Most literals that stand for one part of a pattern.
_MOST = 24


def _strings(op, arg) -> set[str] | None:
    """All strings that a part matches, in lower case, if they are few; else None."""
    if op is C.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is C.IN:
        found = {chr(x).lower() for kind, x in arg if kind is C.LITERAL and x < 128}
        return found if len(arg) <= 4 and all(kind is C.LITERAL and x < 128 for kind, x in arg) else None
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        return set().union(*parts) if all(parts) and sum(map(len, parts)) <= _MOST else None
    if op is C.MAX_REPEAT and arg[0] in (0, 1) and arg[1] == 1:
        found = _sequence(arg[2])
        return found | {""} if found and arg[0] == 0 else found
    return None


def _sequence(parsed) -> set[str] | None:
    out = {""}
    for op, arg in parsed:
        more = _strings(op, arg)
        if more is None or len(out) * len(more) > _MOST:
            return None
        out = {a + b for a in out for b in more}
    return out


def _best(parsed) -> set[str]:
    """The strings, one of which every match holds, whose shortest is longest; empty if there are none."""
    found, run = [], {""}
    for op, arg in parsed:
        more = _strings(op, arg)
        if more is not None and len(run) * len(more) <= _MOST:
            run = {a + b for a in run for b in more}
            continue
        found.append(run)
        run = more or {""}
        if more is None:
            if op is C.SUBPATTERN:
                found.append(_best(arg[3]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                found.append(_best(arg[2]))
            elif op is C.BRANCH:
                parts = [_best(p) for p in arg[1]]
                found.append(set().union(*parts) if all(parts) else set())
    found = [x for x in (*found, run) if x and "" not in x and len(x) <= 2 * _MOST]
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=set())


def literals(pattern: str) -> list[str]:
    """Strings in lower case, without those that hold another; every match of the pattern, in lower case, holds one. Empty if none can be told."""
    best = _best(_parser.parse(pattern))
    return sorted(x for x in best if not any(y != x and y in x for y in best))

