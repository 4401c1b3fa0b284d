"""Cheap literal guards for regex rules.

A rule like ``cursor\\.execute\\s*\\(`` can only match text that contains the
literal ``cursor.execute``.  ``contains`` is a byte search (memchr-like) and
far cheaper than a backtracking regex scan, so each rule is evaluated as
``contains(text, literal) AND rlike(text, rule)``.  The literal is derived
conservatively: the longest run of plain characters that every match must
contain; when unsure (top-level alternation, case-insensitive flag), no guard
is used and the rule runs as is.  Results are identical by construction.
"""

from __future__ import annotations

_CLASS_ESCAPES = set("sSwWdDbBAzZGhHvVRXNpPQEk0123456789")


def _skip_class(p: str, i: int) -> int:
    """p[i] == '['; return index after the matching ']'."""
    i += 1
    if i < len(p) and p[i] == "^":
        i += 1
    if i < len(p) and p[i] == "]":
        i += 1
    while i < len(p) and p[i] != "]":
        if p[i] == "\\":
            i += 1
        elif p[i] == "[":
            i = _skip_class(p, i) - 1
        i += 1
    return i + 1


def _skip_group(p: str, i: int) -> int:
    """p[i] == '('; return index after the matching ')'."""
    depth = 0
    while i < len(p):
        ch = p[i]
        if ch == "\\":
            i += 2
            continue
        if ch == "[":
            i = _skip_class(p, i)
            continue
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    raise ValueError("unbalanced group")


def _skip_quantifier(p: str, i: int) -> int:
    if i < len(p) and p[i] == "{":
        i = p.index("}", i) + 1
    elif i < len(p) and p[i] in "*?+":
        i += 1
    if i < len(p) and p[i] in "?+":  # lazy / possessive
        i += 1
    return i


def leading_literal(pattern: str) -> str:
    """Plain characters at the very start of ``pattern`` (before any operator).

    Java's regex engine scans for such a prefix with Boyer-Moore when it is
    at least 4 characters long, so those rules need no extra guard.
    """
    out = ""
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern) and not pattern[i + 1].isalnum():
            lit, j = pattern[i + 1], i + 2
        elif ch.isalnum() or ch in "_-@:=,;'\"<>/ ":
            lit, j = ch, i + 1
        else:
            break
        if j < len(pattern) and pattern[j] in "*?{+":
            break
        out += lit
        i = j
    return out


def guard_for(pattern: str) -> tuple[str, bool] | None:
    """(literal, lower_case) guard for a rule, or None when no safe literal
    exists.  Every guardable rule is guarded: ``rlike`` decodes the UTF-8
    text into a JVM string on each call, while ``contains`` scans the bytes
    in place, so a failed guard saves a full decode plus a regex scan."""
    if pattern.startswith("(?i)"):
        lit = required_literal(pattern[4:], min_len=3)
        return (lit.lower(), True) if lit else None
    lit = required_literal(pattern, min_len=1)
    return (lit, False) if lit else None


def required_literal(pattern: str, min_len: int = 3) -> str | None:
    """Longest literal every match of ``pattern`` must contain, or None."""
    if pattern.startswith("(?"):
        return None  # inline flags (e.g. case-insensitive) change literal meaning
    p = pattern
    best, cur = "", ""

    def flush():
        nonlocal best, cur
        if len(cur) > len(best):
            best = cur
        cur = ""

    i = 0
    while i < len(p):
        ch = p[i]
        if ch == "|":
            return None
        if ch == "(":
            flush()
            i = _skip_group(p, i)
            i = _skip_quantifier(p, i)
            continue
        if ch == "[":
            flush()
            i = _skip_quantifier(p, _skip_class(p, i))
            continue
        if ch in ".^$":
            flush()
            i = _skip_quantifier(p, i + 1)
            continue
        if ch == "\\":
            nxt = p[i + 1]
            if nxt in _CLASS_ESCAPES or nxt.isalpha():
                flush()
                i = _skip_quantifier(p, i + 2)
                continue
            lit, i = nxt, i + 2
        elif ch in "*?{+":
            return None  # quantifier without atom: not a pattern we reason about
        else:
            lit, i = ch, i + 1
        if i < len(p) and p[i] in "*?{":
            flush()  # this atom is optional
            i = _skip_quantifier(p, i)
            continue
        if i < len(p) and p[i] == "+":
            cur += lit
            flush()
            i = _skip_quantifier(p, i)
            continue
        cur += lit
    flush()
    return best if len(best) >= min_len else None
