"""Literals in scripts: a scanner that finds where one ends and writes it as JSON."""

from __future__ import annotations

import json
import re

#: White space, comments, strings, brackets and marks, words and numbers, and any other character. Strings go before all that may stand in one.
TOKEN = re.compile(r"""\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[{}\[\],:]|[\w$.+-]+|.""", re.DOTALL)
NAME = re.compile(r"[A-Za-z_$][\w$]*\Z")
ESCAPE = re.compile(r'\\(.)|"', re.DOTALL)
CLOSES = {"}": "{", "]": "["}


def double_quoted(text: str) -> str:
    """A single-quoted string as a double-quoted one."""
    return '"' + ESCAPE.sub(lambda m: '\\"' if m[0] == '"' else "'" if m[1] == "'" else m[0], text[1:-1]) + '"'


def literal(text: str, at: int) -> str | None:
    """The object or array literal that begins at text[at], as JSON: without comments and trailing commas, keys and single-quoted strings in
    double quotes, undefined as null. Nothing inside a string is changed. None where a bracket doesn't match, the text ends before the literal
    does, or something stands in it that no literal holds."""
    out: list[str] = []
    open_: list[str] = []
    name = comma = None  # places in out of a word that may be a key, and of a comma that may be a trailing one
    for m in TOKEN.finditer(text, at):
        t = m[0]
        if t[0].isspace():
            out.append(t)
            continue
        if t.startswith(("//", "/*")):
            continue
        if name is not None:
            if t == ":":
                out[name] = f'"{out[name]}"'
            elif out[name] == "undefined":
                out[name] = "null"
            name = None
        if t in CLOSES:
            if not open_ or open_.pop() != CLOSES[t]:
                return None
            if comma is not None:
                out[comma] = ""
            out.append(t)
            if not open_:
                return "".join(out)
            comma = None
            continue
        comma = len(out) if t == "," else None
        if t in "{[":
            open_.append(t)
        elif t[0] == "'" and len(t) > 1:
            t = double_quoted(t)
        elif NAME.match(t):
            name = len(out)
        elif not (t in ",:" or (t[0] == '"' and len(t) > 1) or re.match(r"[\w.+-]", t)):
            return None
        out.append(t)
    return None


def strict(text: str) -> object:
    """The value of a JSON text; NaN and infinities are none."""

    def none(name: str) -> None:
        raise ValueError(name)

    return json.loads(text, parse_constant=none)


def embedded_json(text: str, pattern: re.Pattern) -> str | None:
    """The first JSON text, not empty, that a match of the pattern leads to: its first group as it stands, or else the literal that begins at
    the group's first bracket, however far it goes, as JSON."""
    for m in pattern.finditer(text):
        raw = m[1] or ""
        found = re.search(r"[{\[]", raw)
        for candidate in (lambda: raw, lambda: literal(text, m.start(1) + found.start()) if found else None):  # noqa: B023
            own = candidate()
            try:
                if own and strict(own):
                    return own
            except (ValueError, RecursionError):
                pass
    return None
