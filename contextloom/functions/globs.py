"""Globs and ignore patterns as regular expressions that Java, RE2 and Python agree on."""

from __future__ import annotations

from collections.abc import Iterable

_SPECIAL = set(".^$+(){}|\\[]*?")


def _translate(body: str, braces: bool) -> str:
    out, i, depth = [], 0, 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:[^/]*/)*")
            i += 3
            continue
        if body.startswith("/**", i) and i + 3 == len(body):
            out.append("/.*" if not braces else "(?:/.*)?")
            i += 3
            continue
        if body.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end
        elif braces and c == "{":
            out.append("(?:")
            depth += 1
        elif braces and c == "}" and depth:
            out.append(")")
            depth -= 1
        elif braces and c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(body):
            i += 1
            out.append("\\" + body[i] if body[i] in _SPECIAL else body[i])
        else:
            out.append("\\" + c if c in _SPECIAL else c)
        i += 1
    if depth:
        raise ValueError(f"unbalanced braces in glob: {body}")
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """A path glob: ``*`` and ``?`` stay within a segment, ``**`` crosses them, ``[..]`` and ``{a,b}`` choose; anchored."""
    return "^" + _translate(pattern, True) + "$"


def ignore_regex(pattern: str) -> str:
    """One line of an ignore file, without ``!``, relative to its directory; a match ignores the path or a directory above it."""
    dir_only = pattern.endswith("/")
    body = pattern.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    return ("^" if anchored else "(?:^|/)") + _translate(body, False) + ("/" if dir_only else "(?:/|$)")


def any_regex(patterns: Iterable[str]) -> str:
    """One alternation of several regexes."""
    return "|".join(f"(?:{p})" for p in patterns) or "(?!)"
