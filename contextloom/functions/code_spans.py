"""Comment spans and function spans of source files in eight languages, extracted independently.

Strings and comments are blanked out first, so that nothing inside them looks like code; what is left
keeps its offsets. Functions are then found by their headers and a body, comments by their places.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from typing import NamedTuple

# Path endings of the eight languages.
LANGUAGES = {
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "go": "go", "java": "java",
    "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "mts": "js", "cts": "js", "py": "python", "pyi": "python", "rs": "rust",
}

_KEYWORDS = frozenset(
    "if for while switch catch synchronized return else do try throw new sizeof typeof defer go select case default with function "
    "super assert await yield delete in of instanceof and or not alignof decltype static_assert using namespace operator import export "
    "match loop unsafe".split()
)


class Comment(NamedTuple):
    """A comment that stands alone on its lines; line comments on adjoining lines are one."""

    first: int
    last: int
    text: str


class Function(NamedTuple):
    """A function with a body. ``line`` holds the name, ``anchor`` is the line above which a comment belongs to it."""

    name: str
    line: int
    anchor: int
    start: int
    end: int
    doc: str | None = None


def _lexer(*parts: str) -> re.Pattern:
    return re.compile("|".join(parts), re.S)


_LINE, _BLOCK = r"(?P<line>//[^\n]*)", r"(?P<block>/\*.*?(?:\*/|\Z))"
_DOUBLE, _SINGLE = r"\"(?:\\.|[^\"\\\n])*\"?", r"'(?:\\.|[^'\\\n])*'"
_LEXERS = {
    "c": _lexer(_LINE, _BLOCK, _DOUBLE, _SINGLE),
    "cpp": _lexer(_LINE, _BLOCK, r"R\"(?P<mark>[^()\s\\]{0,16})\(.*?\)(?P=mark)\"", _DOUBLE, r"(?<![0-9a-fA-F])'(?:\\.|[^'\\\n])*'"),
    "go": _lexer(_LINE, _BLOCK, _DOUBLE, _SINGLE, r"`[^`]*`"),
    "java": _lexer(_LINE, _BLOCK, r"\"\"\".*?\"\"\"", _DOUBLE, _SINGLE),
    "js": _lexer(_LINE, _BLOCK, _DOUBLE, _SINGLE, r"`(?:\\.|[^`\\])*`", r"(?P<regex>(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![/*\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)"),
    "rust": _lexer(_LINE, _BLOCK, r"b?r(?P<mark>#*)\".*?\"(?P=mark)", r"b?" + _DOUBLE, r"b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'"),
}
_NOT_NEWLINE = re.compile(r"[^\n]+")
_BRACKET = re.compile(r"[()\[\]{}]")
_CLOSES = {")": "(", "]": "[", "}": "{"}


def _blank(s: str) -> str:
    return _NOT_NEWLINE.sub(lambda m: " " * len(m.group(0)), s)


class Source:
    """A text with its comments and strings blanked out, its line starts and its pairs of brackets."""

    def __init__(self, text: str, language: str):
        self.text = text
        self.starts = [0]
        self.starts += [m.end() for m in re.finditer("\n", text)]
        pieces, at, found = [], 0, []
        for m in _LEXERS[language].finditer(text):
            if m.end() == m.start():
                continue
            pieces += [text[at : m.start()], _blank(m.group(0))]
            at = m.end()
            if m.lastgroup in ("line", "block"):
                found.append((m.start(), m.end(), m.lastgroup))
        self.code = "".join([*pieces, text[at:]])
        self.comments = self._alone(found)
        self.pairs: dict[int, int] = {}
        self.opened: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for m in _BRACKET.finditer(self.code):
            c = m.group(0)
            if c in "([{":
                stack.append((c, m.start()))
                continue
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] != _CLOSES[c] and len(stack) - depth < 4:
                depth -= 1
            if depth >= 0 and stack[depth][0] == _CLOSES[c]:
                self.pairs[stack[depth][1]] = m.start()
                self.opened[m.start()] = stack[depth][1]
                del stack[depth:]

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def code_line(self, n: int) -> str:
        return self.code[self.starts[n - 1] : self.starts[n] if n < len(self.starts) else len(self.code)].strip()

    def _alone(self, found: list[tuple[int, int, str]]) -> list[Comment]:
        out: list[Comment] = []
        mergeable = False
        for start, end, kind in found:
            first, last = self.line(start), self.line(max(start, end - 1))
            head = self.text[self.starts[first - 1] : start]
            tail = self.text[end : self.starts[last] if last < len(self.starts) else len(self.text)]
            if head.strip("﻿ \t") or tail.strip():
                mergeable = False
                continue
            body = self.text[start:end]
            if kind == "line" and mergeable and out[-1].last == first - 1:
                out[-1] = Comment(out[-1].first, last, out[-1].text + "\n" + body)
            else:
                out.append(Comment(first, last, body))
            mergeable = kind == "line"
        return out


_SPACE = re.compile(r"\s*")
_ANGLE = re.compile(r"->|=>|[<>(){};]")


def _skip(code: str, at: int) -> int:
    return _SPACE.match(code, at).end()


def _after_angles(src: Source, at: int) -> int:
    """Past a ``<...>`` list that opens at ``at``; -1 if it doesn't close."""
    depth, i = 0, at
    while m := _ANGLE.search(src.code, i):
        c, i = m.group(0), m.end()
        if c == "<":
            depth += 1
        elif c == ">":
            depth -= 1
            if depth == 0:
                return i
        elif c in "({" and m.start() in src.pairs:
            i = src.pairs[m.start()] + 1
        elif c in ";)}":
            return -1
    return -1


def _parameters(src: Source, at: int) -> int:
    """Past the parameter list (and generics before it) that starts at ``at``; -1 if there is none."""
    at = _skip(src.code, at)
    if src.code.startswith("<", at):
        at = _after_angles(src, at)
        if at < 0:
            return -1
        at = _skip(src.code, at)
    if not src.code.startswith("(", at) or at not in src.pairs:
        return -1
    return src.pairs[at] + 1


_TYPE_BLOCK = re.compile(r"(?:interface|struct)\s*$")


def _go_body(src: Source, at: int) -> int:
    code, i = src.code, at
    while i < len(code):
        c = code[i]
        if c == "\n":
            return -1
        if c == "{":
            if not _TYPE_BLOCK.search(code[max(0, i - 24) : i]):
                return i
            i = src.pairs.get(i, len(code))
        elif c in "([":
            i = src.pairs.get(i, len(code))
        i += 1
    return -1


def _rust_body(src: Source, at: int) -> int:
    code, i = src.code, at
    while i < len(code):
        c = code[i]
        if c == "{":
            return i
        if c in ";}":
            return -1
        if c in "([":
            i = src.pairs.get(i, len(code))
        i += 1
    return -1


_JAVA_TAIL = re.compile(r"\s*(?:\[\s*\]\s*)*(?:throws\s+[\w.,\s<>@]+)?\s*\{")
_C_TAIL = re.compile(
    r"\s*(?:(?:const|noexcept|override|final|volatile|mutable|try|&&?|->\s*[\w:<>,*&\s]+|throw\s*\(\s*\)|__attribute__\s*\(\(.*?\)\)|requires\s[^{;]*)\s*|noexcept\s*\([^)]*\)\s*)*(?P<stop>[{:])"
)
_INIT = re.compile(r"\s*,?\s*[\w:]+(?:<[^<>{}]*>)?\s*(?=[({])")


def _java_body(src: Source, at: int) -> int:
    m = _JAVA_TAIL.match(src.code, at)
    return m.end() - 1 if m else -1


def _c_body(src: Source, at: int) -> int:
    m = _C_TAIL.match(src.code, at)
    if not m:
        return -1
    if m.group("stop") == "{":
        return m.end() - 1
    i = m.end()
    while init := _INIT.match(src.code, i):
        if init.end() not in src.pairs:
            return -1
        i = src.pairs[init.end()] + 1
    i = _skip(src.code, i)
    return i if src.code.startswith("{", i) else -1


def _js_body(src: Source, at: int, arrow: bool) -> int:
    """The body's ``{`` of a function, or the place after ``=>`` of an arrow function; -1 without body."""
    code, i = src.code, _skip(src.code, at)
    typed = code.startswith(":", i)
    last, seen = ":", False
    if typed:
        i += 1
    while i < len(code):
        c = code[i]
        if c.isspace():
            if c == "\n" and seen and last not in "|&,<:>=(":
                j = _skip(code, i)
                if code[j : j + 1] not in "{|&=":
                    return -1
            i += 1
            continue
        if code.startswith("=>", i):
            if arrow:
                return i + 2
            last, i = ">", i + 2
            if not typed:
                return -1
            last = ":"
            continue
        if c == "{":
            if typed and (not seen or last in ":|&<,=("):
                i, last, seen = src.pairs.get(i, len(code)) + 1, "}", True
                continue
            return -1 if arrow else i
        if not typed or c in ";}":
            return -1
        if c in "([":
            i, last, seen = src.pairs.get(i, len(code)) + 1, ")", True
            continue
        last, seen, i = c, True, i + 1
    return -1


_GO = re.compile(r"^[ \t]*func[ \t]+(?:\([^()\n]*\)[ \t]*)?(?P<name>[^\W\d]\w*)[ \t]*(?P<generic>\[)?", re.M)
_RUST = re.compile(r"\bfn\s+(?:r#)?(?P<name>[^\W\d]\w*)\s*")
_C_NAME = re.compile(r"(?:(?P<scope>(?:\w+\s*(?:<[^<>;{}()]*>)?\s*::\s*)*)(?P<tilde>~?))(?P<name>[^\W\d]\w*)\s*(?=\()")
_JAVA_NAME = re.compile(r"(?P<name>[^\W\d][\w$]*)\s*(?=\()")
_JS_FUNCTION = re.compile(r"(?<![\w$.])function\s*\*?\s*(?P<name>[^\W\d]?[\w$]*)\s*(?=[(<])")
_JS_METHOD = re.compile(
    r"^[ \t]*(?:(?:export|default|public|private|protected|static|async|override|readonly|abstract|declare|get|set)[ \t]+)*(?:async[ \t]*)?[*#]?[ \t]*(?P<name>[A-Za-z_$][\w$]*)[ \t]*(?=[(<])",
    re.M,
)
_JS_CONST = re.compile(r"(?<![\w$.])const\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?=[:=])")
_JS_ARROW_HEAD = re.compile(r"=\s*(?:async\s*)?(?:(?P<single>[A-Za-z_$][\w$]*)\s*(?==>)|(?P<function>function\s*\*?\s*[\w$]*\s*)?(?=[(<]))")
_BEFORE_METHOD = re.compile(r"(?:[\w>\]*&$?][\s*&]*|^\s*|[;{}]\s*)\Z")
_LAST_WORD = re.compile(r"([A-Za-z_$][\w$]*)[\s*&]*\Z")
_TYPE_LINE = re.compile(r"[\w:<>,\s*&~\[\].]+")
_MODIFIERS = re.compile(r"(?:(?:pub|export|default|async|unsafe|const|extern|static|inline|public|private|protected|final|abstract|synchronized|native|default|virtual|constexpr|friend)\s*(?:\([^)]*\))?\s*)+")
_ANNOTATION = re.compile(r"@(?!interface\b)\w|#!?\[|\[\[|template\b|__attribute__|__declspec|requires\b|#\s*pragma\b")


def _in_bracket(src: Source, at: int) -> str:
    """The innermost bracket that is open at ``at``, by walking back over pairs; empty at top level."""
    i = at - 1
    while i >= 0:
        c = src.code[i]
        if c in ")]}" and i in src.opened:
            i = src.opened[i]
        elif c in "([{":
            return c
        i -= 1
    return ""


def _declared_from(src: Source, line: int, language: str) -> int:
    """The line on which the declaration begins whose name stands on ``line``."""
    while line > 1:
        above = src.code_line(line - 1)
        if not above or _ANNOTATION.match(above) or above[0] == "#":
            break
        if language in ("c", "cpp", "java"):
            if not _TYPE_LINE.fullmatch(above) or above[-1] in ":,." or above.split()[0] in ("return", "else", "case", "goto", "using", "typedef", "import", "package"):
                break
        elif not _MODIFIERS.fullmatch(above):
            break
        line -= 1
    return line


def _anchor(src: Source, line: int, language: str) -> int:
    """The first of the lines with annotations, attributes or templates right above ``line``, or ``line``."""
    while line > 1:
        above = src.code_line(line - 1)
        if not above:
            break
        if _ANNOTATION.match(above):
            line -= 1
            continue
        if above[-1] in ")]}":
            end = src.starts[line - 2] + src.code[src.starts[line - 2] : src.starts[line - 1]].rstrip().__len__() - 1
            opened = src.opened.get(end)
            if opened is not None and _ANNOTATION.match(src.code_line(src.line(opened))):
                line = src.line(opened)
                continue
        if language == "cpp" and above[-1] == ">":
            first = next((n for n in range(line - 2, max(0, line - 10), -1) if src.code_line(n).startswith("template")), None)
            if first and all(src.code_line(n) for n in range(first, line)) and not any(c in ";{}" for n in range(first, line) for c in src.code_line(n)):
                line = first
                continue
        break
    return line


def _headers(src: Source, language: str) -> list[tuple[str, int, int, int]]:
    """``(name, offset of the name, offset of the header, end of the body)`` of all functions with a body."""
    code, out = src.code, []

    def add(name: str, at: int, head: int, body: int) -> None:
        if body >= 0:
            out.append((name, at, head, src.pairs.get(body, body) + 1 if code.startswith("{", body) else body))

    if language == "go":
        for m in _GO.finditer(code):
            at = m.end()
            if m.group("generic"):
                at = src.pairs.get(m.end() - 1, -2) + 1
            end = _parameters(src, at) if at >= 0 else -1
            if end >= 0:
                add(m.group("name"), m.start("name"), m.start(), _go_body(src, end))
    elif language == "rust":
        for m in _RUST.finditer(code):
            end = _parameters(src, m.end())
            if end >= 0:
                add(m.group("name"), m.start("name"), m.start(), _rust_body(src, end))
    elif language in ("c", "cpp", "java"):
        pattern, body_of = (_JAVA_NAME, _java_body) if language == "java" else (_C_NAME, _c_body)
        for m in pattern.finditer(code):
            name, head = m.group("name"), m.start()
            if name in _KEYWORDS or name[0].isdigit() or m.end() not in src.pairs:
                continue
            body = body_of(src, src.pairs[m.end()] + 1)
            if body < 0:
                continue
            before = code[max(0, head - 240) : head]
            word = _LAST_WORD.search(before)
            previous = before.rstrip()[-1:]
            if word and word.group(1) in ("new", "return", "else", "throw", "case", "goto", "do", "record", "enum", "define", "in"):
                continue
            if language == "java":
                if not (word or previous in (">", "]", "{", "}", ";")) or previous in (".", "=", "(", ",", "+", "-", "!", "?", ":", "&", "|"):
                    continue
                if not word and previous in "{};" and not name[:1].isupper():
                    continue
            else:
                if previous in (".", "=", "(", ",", "+", "-", "!", "?", "|", "/", "%", "<", "[") or before.rstrip().endswith(("->", "&&")):
                    continue
                if language == "c" and not word:
                    continue
                if not word and previous not in ("", ";", "}", "{", ":", ">"):
                    continue
                if not word and previous in (";", "{") and not name[:1].isupper() and not m.group("tilde"):
                    continue
            add(m.group("tilde") + name if language == "cpp" and m.group("tilde") else name, m.start("name"), head, body)
    else:
        taken = set()
        for m in _JS_FUNCTION.finditer(code):
            end = _parameters(src, m.end())
            if m.group("name") and end >= 0:
                taken.add(m.start("name"))
                add(m.group("name"), m.start("name"), m.start(), _js_body(src, end, False))
        for m in _JS_METHOD.finditer(code):
            if m.group("name") in _KEYWORDS or m.start("name") in taken:
                continue
            end = _parameters(src, m.end())
            if end >= 0:
                add(m.group("name"), m.start("name"), m.start("name"), _js_body(src, end, False))
        for m in _JS_CONST.finditer(code):
            at = m.end()
            if code.startswith(":", at):
                at = _after_type(src, at + 1)
                if at < 0:
                    continue
            head = _JS_ARROW_HEAD.match(code, at)
            if not head:
                continue
            if head.group("single"):
                add(m.group("name"), m.start("name"), m.start(), code.index("=>", head.end()) + 2)
                continue
            end = _parameters(src, head.end())
            if end >= 0:
                body = _js_body(src, end, not head.group("function"))
                if body >= 0 and not head.group("function"):
                    i = _skip(code, body)
                    body = i if code.startswith("{", i) else body
                add(m.group("name"), m.start("name"), m.start(), body)
    return out


def _after_type(src: Source, at: int) -> int:
    """The ``=`` that ends a type annotation from ``at``; -1 if there is none."""
    i, code = at, src.code
    while i < len(code):
        c = code[i]
        if code.startswith("=>", i):
            i += 2
            continue
        if c == "=":
            return i
        if c in ";}":
            return -1
        if c in "([{":
            i = src.pairs.get(i, len(code))
        i += 1
    return -1


def _python_functions(text: str) -> list[Function] | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.lstrip("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            doc = None
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                doc = first.value.value
            begin = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append(Function(node.name, node.lineno, begin, begin, node.end_lineno or node.lineno, doc or ""))
    return out


_PY_LEX = re.compile(r"#[^\n]*|(?P<triple>[rRbBuUfF]{0,2}(\"\"\"|''')(?:\\.|(?!\2).)*?(?:\2|\Z))|[rRbBuUfF]{0,2}(?:\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')", re.S)
_PY_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?=[\[(])", re.M)
_PY_DOC = re.compile(r"\s*[rRuUbB]?(\"\"\"|'''|\"|')(.*?)(?<!\\)\1", re.S)


def _python_by_pattern(text: str) -> list[Function]:
    """For files that this Python can't parse, such as those of an older language version."""
    pieces, at = [], 0
    for m in _PY_LEX.finditer(text):
        pieces += [text[at : m.start()], _blank(m.group(0))]
        at = m.end()
    code = "".join([*pieces, text[at:]])
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    pairs, stack = {}, []
    for m in re.finditer(r"[()]", code):
        if m.group(0) == "(":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    out = []
    for m in _PY_DEF.finditer(code):
        opened = code.find("(", m.end())
        colon = code.find(":", pairs.get(opened, len(code)))
        if opened < 0 or colon < 0:
            continue
        doc = _PY_DOC.match(text, colon + 1)
        line = bisect_right(starts, m.start("name"))
        after = next((n for n in range(bisect_right(starts, colon) + 1, len(starts) + 1) if (s := code[starts[n - 1] : starts[n] if n < len(starts) else len(code)]).strip() and len(s) - len(s.lstrip()) <= len(m.group(1))), len(starts) + 1)
        out.append(Function(m.group("name"), line, line, line, after - 1, doc.group(2) if doc else ""))
    return out


def spans_of(text: str, language: str) -> tuple[list[Comment], list[Function]]:
    """All comments that stand alone and all functions with a body, each in order of lines."""
    if language == "python":
        found = _python_functions(text)
        return [], sorted(found if found is not None else _python_by_pattern(text), key=lambda f: f.line)
    src = Source(text, language)
    functions = []
    for name, at, head, end in _headers(src, language):
        line = src.line(at)
        begin = _declared_from(src, src.line(_skip(src.code, head)), language)
        begin = min(begin, line)
        functions.append(Function(name, line, _anchor(src, begin, language), begin, src.line(max(0, end - 1))))
    return src.comments, sorted(functions, key=lambda f: (f.line, f.start))
