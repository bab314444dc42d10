"""Attribute files of repositories: globs as Java regular expressions, and the rules they state."""

from __future__ import annotations

import re

# The attributes by which repositories declare origins.
ATTRIBUTES = {"linguist-generated": "generated", "linguist-vendored": "vendored"}
_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"[ \t]*')
_ESCAPE = re.compile(r"\\([0-7]{3}|.)")
_PLAIN_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def attribute_glob_regex(pattern: str) -> str | None:
    """A pattern of an attribute file, relative to the file's directory, as an anchored regex; None if it matches no file.

    Without a slash the pattern is matched against the name at any depth; with one, against the path below
    the directory. ``*`` and ``?`` don't cross slashes, ``**`` does. A pattern that ends in a slash names a
    directory, and attributes are no directory's.
    """
    if not pattern or pattern.endswith("/"):
        return None
    deep = "/" not in pattern
    body = pattern.removeprefix("/")
    out, i = [], 0
    while i < len(body):
        c = body[i]
        at_start = i == 0 or body[i - 1] == "/"
        if at_start and body.startswith("**/", i):
            out.append("(?:[^/]*/)*")
            i += 3
            continue
        if at_start and body[i:] == "**":
            out.append(".+")
            break
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\" and i + 1 < len(body):
            i += 1
            out.append(re.escape(body[i]))
        elif c == "[" and (end := body.find("]", i + 2 + (body[i + 1 : i + 2] in ("!", "^")))) > 0:
            inner = body[i + 1 : end]
            negated = inner[0] in "!^"
            members = inner[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&").replace("^", "\\^")
            out.append("(?!/)[" + "^" * negated + members + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + ("(?:.*/)?" if deep else "") + "".join(out) + "$"


def _unquoted(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m.group(1), 8)) if len(m.group(1)) == 3 else _PLAIN_ESCAPES.get(m.group(1), m.group(1)), text)


def _settings(fields: list[str], macros: dict[str, list[tuple[str, bool | None]]]) -> list[tuple[str, bool | None]]:
    """``(attribute, value)`` in order; the value None takes a declaration back."""
    found = []
    for field in fields:
        name, _, value = field.lstrip("-!").partition("=")
        if name in ATTRIBUTES:
            found.append((ATTRIBUTES[name], None if field[0] == "!" else field[0] != "-" and value.lower() not in ("false", "0", "no")))
        elif field[0] not in "-!":
            found += macros.get(name, [])
    return found


def parse_attributes(text: str) -> list[tuple[int, str, str, bool | None]]:
    """``(line, regex, attribute, value)`` of each rule on generated or vendored paths; other lines are skipped.

    Patterns may stand in double quotes with escapes; ``[attr]name`` lines define macros; ``-attr`` and
    ``attr=false`` declare that a path is not, ``!attr`` leaves it undeclared. Negative patterns are not allowed
    in attribute files and are skipped.
    """
    rules: list[tuple[int, str, str, bool | None]] = []
    macros: dict[str, list[tuple[str, bool | None]]] = {}
    for n, line in enumerate(text.replace("\r\n", "\n").lstrip("\ufeff").split("\n")):
        line = line.strip(" \t")
        if not line or line[0] in "#!":
            continue
        quoted = _QUOTED.match(line)
        pattern, *fields = [_unquoted(quoted.group(1)), *line[quoted.end() :].split()] if quoted else line.split()
        if not quoted and pattern.startswith("[attr]"):
            macros[pattern[6:]] = _settings(fields, macros)
            continue
        regex = attribute_glob_regex(pattern)
        if regex is not None:
            rules += [(n, regex, attribute, value) for attribute, value in _settings(fields, macros)]
    return rules
