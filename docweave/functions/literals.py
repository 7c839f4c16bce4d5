"""What an expression must hold: a plain text that stands in all its matches, for a search of many expressions at once."""

from __future__ import annotations

import re


class Folding(dict):
    """For str.translate: each character as case-insensitive expressions of Spark's engine compare it."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        upper = c.upper() if len(c.upper()) == 1 else c
        out = "i" if c == "İ" else upper.lower() if len(upper.lower()) == 1 else upper
        self[code] = out
        return out


FOLDED = Folding()


def folded(text: str) -> str:
    """The text with as many characters, those that differ in case only made equal."""
    return text.lower() if text.isascii() else text.translate(FOLDED)


def group_end(p: str, i: int) -> int:
    """The place behind the group that opens at i, -1 without an end."""
    depth = 0
    while i < len(p):
        if p[i] == "\\":
            i += 1
        elif p[i] == "[":
            i = class_end(p, i) - 1
            if i < 0:
                return -1
        elif p[i] in "()":
            depth += 1 if p[i] == "(" else -1
            if depth == 0:
                return i + 1
        i += 1
    return -1


def class_end(p: str, i: int) -> int:
    """The place behind the character class that opens at i, 0 where it is not plain to see."""
    depth, i = 1, i + 1
    if p[i : i + 1] == "^":
        i += 1
    if p[i : i + 1] == "]":
        return 0
    while i < len(p):
        if p[i] == "\\":
            i += 1
        elif p[i] in "[]":
            depth += 1 if p[i] == "[" else -1
            if depth == 0:
                return i + 1
        i += 1
    return 0


def required_literal(p: str) -> str:
    """A text that every match of the expression holds, but for case; empty where none is sure, as with alternatives."""
    found, run, i = [], "", 0
    while i < len(p):
        c, own, inner = p[i], "", ""
        if c == "\\":
            n = p[i + 1 : i + 2]
            if not n or n.isalnum() and n in "QExuUcNkoO0123456789":
                return ""
            i += 2
            if n in "pP":
                i = p.find("}", i) + 1 if p[i : i + 1] == "{" else i + 1
            own = "" if n.isalnum() else n
        elif c == "[":
            i = class_end(p, i)
        elif c == "(":
            end = group_end(p, i)
            if end < 0:
                return ""
            body = p[i + 1 : end - 1]
            if head := re.match(r"\?(?:P?<[A-Za-z]\w*>|([A-Za-z]*)(?:-[A-Za-z]*)?(?::|\Z))", body):
                if "x" in (head[1] or ""):
                    return ""
                body = body[head.end() :]
            inner, i = "" if body.startswith("?") else required_literal(body), end
        elif c in "|)*+?{":
            return ""
        else:
            own, i = ("" if c in ".^$" else c), i + 1
        if i == 0:
            return ""
        repeat = re.match(r"[*+?]|\{(\d+)(?:,\d*)?\}", p[i:])
        if repeat:
            i += repeat.end()
            i += p[i : i + 1] in ("?", "+")
        elif p[i : i + 1] == "{":
            return ""
        never = bool(repeat) and (repeat[0] in ("*", "?") or repeat[1] is not None and int(repeat[1]) == 0)
        if own and not never:
            run += own
        if not own or repeat:
            found.append(run)
            run = ""
        if inner and not never:
            found.append(inner)
    return max([*found, run], key=len)
