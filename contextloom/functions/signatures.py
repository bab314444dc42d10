"""Signature-only views of source and data files.

Source languages share one extractor: comments and strings are blanked out, functions are found with
their bodies, and what is left over at the top of the file or of a type is kept as it is. A body gives
way; everything that is kept is a verbatim slice of the source, in its order.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings

from contextloom.functions.code_spans import Source, _headers
from contextloom.functions.tables import SIGNATURE_PATTERNS

Signature = tuple[str, str, str, int, int]

_LEXER = {"go": "go", "rust": "rust", "java": "java", "c": "c", "cpp": "cpp", "typescript": "js", "javascript": "js"}
_TYPE = re.compile(
    r"^[ \t]*(?:(?:pub(?:\([^)]*\))?|export|default|declare|public|private|protected|static|final|abstract|sealed|typedef|template[ \t]*<[^>\n]*>|const|unsafe|async)[ \t]+)*"
    r"(?P<kind>class|interface|@interface|record|enum|struct|union|trait|impl|namespace|module|mod|type)\b[^\n;={]*",
    re.M,
)
_IMPORT = re.compile(r"^(?:import\b|package\b|use\b|extern\b|mod\b|#[ \t]*include\b|using\b|from\b|export[ \t]*(?:\*|\{)|pub use\b)", re.M)
_CONSTANT = re.compile(r"^(?:(?:export|pub(?:\([^)]*\))?|public|static|final)[ \t]+)*(?:const|var|let|static|#[ \t]*define)\b[^\n]*", re.M)
_KINDS = {"class": "class", "record": "class", "interface": "interface", "@interface": "interface", "trait": "interface", "struct": "struct", "union": "struct"}


def _statement(src: Source, at: int) -> int:
    """Where a top-level statement from ``at`` ends: its line, or the closing bracket of what it opens there."""
    end = src.code.find("\n", at)
    end = len(src.code) if end < 0 else end
    i = at
    while i < end:
        if src.code[i] in "([{" and i in src.pairs and src.pairs[i] >= end:
            i = src.pairs[i]
            end = src.code.find("\n", i)
            end = len(src.code) if end < 0 else end
        i += 1
    return end


def _braced(text: str, language: str) -> list[Signature]:
    src = Source(text, _LEXER[language])
    docs = {c.last: c for c in src.comments}
    found: dict[int, Signature] = {}
    bodies = []

    def keep(kind: str, name: str, start: int, end: int) -> None:
        first = src.line(start)
        begin = src.starts[docs[first - 1].first - 1] if first - 1 in docs else src.starts[first - 1]
        if first not in found:
            found[first] = (kind, name, text[begin:end].rstrip().strip("\n"), src.line(begin), src.line(max(begin, end - 1)))

    for name, at, head, end in _headers(src, _LEXER[language]):
        opened = next((b for b, c in ((b, src.pairs.get(b)) for b in (end - 1,)) if c), None)
        body = src.opened.get(end - 1, end) if opened is None else opened
        bodies.append((body, end))
        keep("function", name, head, body)
    inside = sorted(bodies)

    def buried(at: int) -> bool:
        return any(a < at < b for a, b in inside)

    for m in _TYPE.finditer(src.code):
        if not buried(m.start("kind")):
            brace = src.code.find("{", m.end())
            whole = src.pairs.get(brace, m.end()) + 1 if brace >= 0 and not src.code[m.end() : brace].strip() else _statement(src, m.start("kind"))
            holds = any(m.end() < a < whole for a, _ in inside)
            name = re.search(r"\b(?:class|interface|record|enum|struct|union|trait|impl|namespace|module|mod|type)\s+(?:<[^>]*>\s*)?([\w:]+)", m.group(0))
            keep(_KINDS.get(m.group("kind"), "type"), name.group(1) if name else "", m.start("kind"), brace + 1 if holds or whole - brace > 4000 else whole)
    for pattern, kind in ((_IMPORT, "import"), (_CONSTANT, "constant")):
        for m in pattern.finditer(src.code):
            if not buried(m.start()):
                keep(kind, "", m.start(), _statement(src, m.start()))
    return [found[k] for k in sorted(found)]


def _python(text: str) -> list[Signature]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text.lstrip("﻿"))
    lines = text.split("\n")
    out: list[Signature] = []

    def emit(kind: str, name: str, first: int, last: int) -> None:
        out.append((kind, name, "\n".join(lines[first - 1 : last]), first, last))

    def visit(body: list[ast.stmt]) -> None:
        for node in body:
            last = node.end_lineno or node.lineno
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                emit("import", "", node.lineno, last)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                opening = node.body[0]
                doc = isinstance(opening, ast.Expr) and isinstance(opening.value, ast.Constant) and isinstance(opening.value.value, str)
                end = (opening.end_lineno or opening.lineno) if doc else max(node.lineno, opening.lineno - 1)
                while end > node.lineno and not doc and not lines[end - 1].strip():
                    end -= 1
                emit("class" if isinstance(node, ast.ClassDef) else "function", node.name, first, end)
                if isinstance(node, ast.ClassDef):
                    visit(node.body)
            elif isinstance(node, ast.AnnAssign) or isinstance(node, ast.Assign) and all(isinstance(t, ast.Name) and (t.id.isupper() or t.id == "__all__") for t in node.targets):
                emit("constant", "", node.lineno, last)

    visit(tree.body)
    return out


_BY_PATTERN: dict[str, list[tuple[str, re.Pattern]]] = {}
for _language, _kind, _pattern in SIGNATURE_PATTERNS:
    _BY_PATTERN.setdefault(_language, []).append((_kind, re.compile(_pattern)))


def by_patterns(text: str, language: str) -> list[Signature]:
    """The simpler engine: lines that a declaration's pattern opens, with parameter lists that go on over lines."""
    lines, out, n = text.split("\n"), [], 0
    while n < len(lines):
        line = lines[n]
        bare = line.strip() if language == "python" else line
        kind = next((k for k, p in _BY_PATTERN.get(language, ()) if p.match(bare)), None) if line.strip() and (language == "python" or not line[0].isspace()) else None
        if kind is None:
            n += 1
            continue
        last = n
        if kind == "function":
            depth = line.count("(") - line.count(")")
            while depth > 0 and last + 1 < len(lines):
                last += 1
                depth += lines[last].count("(") - lines[last].count(")")
        out.append((kind, "", "\n".join(lines[n : last + 1]), n + 1, last + 1))
        n = last + 1
    return out


# How much of data files is kept.
JSON_DEPTH, LIST_ITEMS, JSON_STRING, SCALAR, BLOCK_LINES = 2, 5, 50, 80, 3


def _json_value(value, depth: int):
    if isinstance(value, dict):
        return f"/* object with {len(value)} keys */" if depth >= JSON_DEPTH else {k: _json_value(value[k], depth + 1) for k in sorted(value)}
    if isinstance(value, list):
        return f"/* {len(value)} items */" if depth >= JSON_DEPTH or len(value) > LIST_ITEMS else [_json_value(v, depth + 1) for v in value]
    return value[:JSON_STRING] + "..." if isinstance(value, str) and len(value) > JSON_STRING else value


def compressed_json(text: str) -> str:
    """The upper levels of a JSON text, keys in order; a text that isn't JSON stays as it is."""
    try:
        value = json.loads(text)
    except ValueError:
        return text
    return json.dumps(_json_value(value, 0), indent=2, ensure_ascii=False)


def compressed_yaml(text: str) -> str:
    """The upper levels of a YAML text, line by line: long lists, scalars and block scalars are cut."""
    out, items, block = [], {}, None
    for line in text.split("\n"):
        indent = len(line) - len(line.lstrip(" "))
        stripped = line.strip()
        if block is not None:
            if not stripped or indent > block[0]:
                block = (block[0], block[1] + 1)
                if block[1] <= BLOCK_LINES:
                    out.append(line)
                elif block[1] == BLOCK_LINES + 1:
                    out.append(" " * (block[0] + 2) + "# ...")
                continue
            block = None
        for deeper in [k for k in items if k > indent]:
            _close(out, items, deeper)
        if indent // 2 > 2:
            continue
        if stripped.startswith("- "):
            items[indent] = items.get(indent, 0) + 1
            if items[indent] > LIST_ITEMS:
                continue
        elif stripped:
            _close(out, items, indent)
        if re.search(r":\s*[|>][-+]?\s*$", line):
            block = (indent, 0)
        out.append(line if len(line.encode()) <= SCALAR + indent + 40 else line.encode()[: SCALAR + indent].decode("utf-8", "ignore") + "...")
    for deeper in sorted(items, reverse=True):
        _close(out, items, deeper)
    return "\n".join(out)


def _close(out: list[str], items: dict[int, int], indent: int) -> None:
    n = items.pop(indent, 0)
    if n > LIST_ITEMS:
        out.append(" " * indent + f"# ... ({n - LIST_ITEMS} more items)")


def compressed_toml(text: str) -> str:
    """A TOML text with long arrays, arrays over several lines and long strings cut."""
    out, depth, opened = [], 0, 0
    for line in text.split("\n"):
        if depth:
            depth += line.count("[") - line.count("]")
            opened += len([x for x in line.strip().rstrip("],").split(",") if x.strip()])
            if depth <= 0:
                out[-1] += f"[/* {opened} items */]"
                depth = 0
            continue
        m = re.match(r"^(\s*[\w.\"'-]+\s*=\s*)(.*)$", line)
        if m and m.group(2).startswith("[") and m.group(2).count("[") > m.group(2).count("]"):
            out.append(m.group(1))
            depth = m.group(2).count("[") - m.group(2).count("]")
            opened = len([x for x in m.group(2).strip("[ ").split(",") if x.strip()])
            continue
        if m and m.group(2).startswith("["):
            try:
                value = tomllib.loads("x = " + m.group(2))["x"]
            except tomllib.TOMLDecodeError:
                value = []
            out.append(m.group(1) + f"[/* {len(value)} items */]" if len(value) > LIST_ITEMS else line)
        elif m and len(m.group(2)) > SCALAR and m.group(2)[0] in "\"'":
            out.append(m.group(1) + m.group(2)[: SCALAR] + "..." + m.group(2)[0])
        else:
            out.append(line)
    return "\n".join(out)


_DATA = {"json": compressed_json, "yaml": compressed_yaml, "toml": compressed_toml}


def signatures(text: str, language: str, engine: str = "auto") -> tuple[str, list[Signature]]:
    """``(status, signatures)`` of a source text: ``ast``, or ``regex`` where that fails or is asked for."""
    if engine != "regex":
        try:
            return "ast", _python(text) if language == "python" else _braced(text, language)
        except (SyntaxError, ValueError, RecursionError, IndexError, KeyError):
            if engine == "ast":
                return "failed", []
    return "regex", by_patterns(text, language)


def compressed(text: str, language: str | None, engine: str = "auto") -> tuple[str, str, int]:
    """``(content, status, signatures)``: the compressed text; unsupported and failed texts stay whole as ``skipped`` or ``failed``."""
    if language in _DATA:
        return _DATA[language](text), "ast", 0
    if language not in _LEXER and language != "python":
        return text, "skipped", 0
    status, found = signatures(text, language, engine)
    if status == "failed":
        return text, status, 0
    return "\n\n".join(s[2] for s in found), status, len(found)


__all__ = ["by_patterns", "compressed", "compressed_json", "compressed_toml", "compressed_yaml", "signatures"]
