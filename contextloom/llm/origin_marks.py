"""What one file's own text and name say about where it comes from."""

from __future__ import annotations

import re

# Phrases, in the languages of the collection, by which tools sign their output.
GENERATED_PHRASES = (
    r"\bcode generated\b.*\bdo not edit",
    r"\bauto-?generated (?:file|from|by|code|source)",
    r"\bgenerated (?:automatically|file)\b",
    r"(?:^|[\s*#/])@generated\b",
    r"<auto-?generated",
    r"\bmachine[- ]generated\b",
    r"\bgenerated (?:by|from|with|using)\b.*(?:compiler|generator|codegen|version|tool|schema|do not)",
    r"\bautomatically (?:generated|produced|created)\b",
    r"\bchanges (?:\w+ )*will be (?:lost|overwritten)",
    r"\b(?:manual|hand) edits? (?:is|are|will be) (?:overwritten|lost)",
    r"\boutput of \S+ (?:on|for|from) .*edits go there",
    r"\bdo not (?:edit|modify)(?: (?:this file|by hand|manually))?\s*[.!*-]*\s*$",
    r"\b(?:automatisch (?:generiert|erzeugt|erstellt)|wird (?:von|aus) .*(?:erzeugt|generiert))",
    r"\bnicht (?:von hand |manuell )?(?:ändern|bearbeiten|editieren)",
    r"\b(?:généré|genere) (?:automatiquement|par)\b|\bne pas (?:modifier|éditer)",
    r"\b(?:generado|creado) (?:automáticamente|por)\b|\bno (?:editar|modificar)\b",
    r"\bgerado (?:automaticamente|por)\b|\bnão (?:editar|edite|modificar|modifique)\b",
    r"сгенерирован|не редактировать",
)
# Phrases by which people say that a file is theirs, whatever else its head mentions.
KEPT_PHRASES = (
    r"\bnot generated\b",
    r"\bno longer generated\b",
    r"\bonce generated\b",
    r"\b(?:kept|written|maintained|edited) by hand\b",
    r"\bhand[- ](?:written|maintained|edited)\b",
    r"\bkeep in (?:step|sync) with\b",
    r"\b(?:please )?edit (?:here|freely)\b",
)
# Lines by which third-party code names its origin.
FOREIGN_PHRASES = (
    r"\bgoverned by the licen[cs]e of \S+",
    r"\bpart of the \S+ project\b.*\bupstream\b",
    r"\bimported from \S+.*\brevision\b|\bsee UPSTREAM\b",
    r"\S+ v\d+(?:\.\d+)+ \| \(c\) .*licen[cs]e",
    r"^\W*!?\s*\S+ v\d+\.\d+\.\d+ .*\(c\) .*(?:contributors|authors)",
)
_GENERATED = re.compile("|".join(f"(?:{p})" for p in GENERATED_PHRASES), re.I)
_KEPT = re.compile("|".join(f"(?:{p})" for p in KEPT_PHRASES), re.I)
_FOREIGN = re.compile("|".join(f"(?:{p})" for p in FOREIGN_PHRASES), re.I)

# Every phrase above holds one of these, in lower case; the comments of most files hold none.
HINTS = (
    "generat", "generad", "genere", "génér", "gerado", "do not", "erzeugt", "erstellt", "hand", "bearbeiten", "ändern", "modif", "edit", "сгенер", "редакт", "creat", "creado", "produced", "lost", "overwrit",
    "keep in", "licen", "upstream", "imported", "(c)",
)


def hinted(text: str) -> bool:
    """Whether any of the phrases may stand in a text; plain searches, as most texts hold none."""
    lowered = text.lower()
    return any(hint in lowered for hint in HINTS)


# Lock files of package managers.
LOCK_NAMES = frozenset(
    "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml bun.lockb composer.lock Gemfile.lock Cargo.lock poetry.lock "
    "Pipfile.lock uv.lock pdm.lock go.sum flake.lock mix.lock pubspec.lock Podfile.lock Package.resolved gradle.lockfile packages.lock.json".split()
)
# Directories in which package managers and people put other projects' code.
FOREIGN_DIRS = frozenset(
    "node_modules bower_components jspm_packages vendor vendored third_party third-party thirdparty 3rdparty 3rd-party "
    "external externals extern deps Pods Carthage site-packages dist-packages".split()
)
CODE = frozenset(
    "go py pyi java ts tsx js jsx mjs cjs c h cc cpp cxx hpp hh rs rb php cs kt swift scala lua pl sh css scss less sql proto dart m mm r jl".split()
)
SHEETS = frozenset("js mjs cjs jsx ts css html htm svg".split())
#: Shell scripts repeat themselves by nature.
SCRIPTS = frozenset({"sh"})
PROSE = frozenset("md markdown rst txt adoc".split())

_COMMENT = re.compile(r"^\s*(?://|/\*|\*|#(?!!)|<!--|--|;|%|\"\"\"|''')")
_STRING = re.compile(r"\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'")
_TRIPLE = ('"""', "'''")
_HEREDOC = re.compile(r"<<[-~]?\s*[\"']?([A-Z_]\w*)[\"']?\s*(?:[;|>&)].*)?$")
_LINE_COMMENT = re.compile(r"//.*|(?:^|\s)#.*")
_TEMPLATE = re.compile(r"`[^`]*`")
_RUN = re.compile(r"x[x0]*|0[x0]*")
_TO_SHAPE = {ord(c): "x" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"} | {ord(c): "0" for c in "0123456789"} | {ord(c): None for c in "-+. \t\r"}
_OPAQUE = re.compile(r"(?:[A-Za-z0-9+/=_-]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[0-7]{1,3})){8,}")
_VALUE = r"[-+]?(?:0x[0-9a-fA-F]+|\d[\d_.]*(?:[eE][-+]?\d+)?)[uUlLfFn]{0,3}"
_NUMBERS = re.compile(rf"{_VALUE}(?:[\s,;{{}}()\[\]]+{_VALUE})*[\s,;{{}}()\[\]]*$")
_NUMBER = re.compile(r"0x[0-9a-fA-F]+|\d[\d_.]*")
_BANNER = re.compile(r"/\*!?.*?\*/|//[^\n]*", re.S)
#: A line of data: this long and with hardly a space.
DATA_LINE = 160
#: A run of signs without a space that holds letters and digits is data from this length on, whatever its line's; a line of numbers from so many on.
DATA_RUN, DATA_NUMBERS = 32, 6
#: A line of squeezed code.
SQUEEZED_LINE = 80
#: Lines in a block over which repetition is measured, so that long files aren't judged by their length.
BLOCK = 48
GRAM = 3


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def comment_lines(lines: list[str]) -> list[str]:
    """All whole-line comments, wherever they stand; what merely stands in a text literal of several lines is none."""
    found, inside, literal, skipped = [], False, "", []
    for line in lines:
        line = line.lstrip("\ufeff")
        if literal:
            if line.strip() == literal if literal.isidentifier() else line.count(literal) % 2:
                literal, skipped = "", []
            elif _COMMENT.match(line):
                skipped.append(line)
            continue
        comment = inside or bool(_COMMENT.match(line))
        if comment:
            found.append(line)
        if "/*" in line or "*/" in line:
            bare = line if comment else _STRING.sub("", line)
            opened, closed = bare.rfind("/*"), bare.rfind("*/")
            if opened != closed:
                inside = opened > closed
        if not inside and ("`" in line or "<<" in line or '"""' in line or "'''" in line) and (not comment or line.lstrip()[:3] in _TRIPLE):
            literal = _opened_literal(line)
    # A literal that never ends was none.
    return found + skipped if literal else found


def _opened_literal(line: str) -> str:
    """What ends the text literal that a line of code leaves open: its quotes, or the word of a here-document."""
    for quotes in _TRIPLE:
        if line.count(quotes) % 2:
            return quotes
    bare = _LINE_COMMENT.sub("", _STRING.sub("", line))
    if bare.count("`") % 2:
        return "`"
    heredoc = _HEREDOC.search(line)
    return heredoc.group(1) if heredoc else ""


def line_shapes(text: str) -> list[str]:
    """Each code line with strings, names and numbers replaced, so that lines stamped out from one template are equal."""
    shaped = _RUN.sub("x", _STRING.sub("", text).translate(_TO_SHAPE))
    return [s for s in shaped.split("\n") if s and s[0] not in "#*" and s[:2] != "//"]


def repetition(text: str) -> float:
    """Share of distinct runs of three line shapes, averaged over blocks; near 0 in stamped-out code, 1 in short files."""
    shapes = line_shapes(text)
    if len(shapes) < 10:
        return 1.0
    ratios = []
    for start in range(0, len(shapes), BLOCK):
        block = shapes[start : start + BLOCK]
        if len(block) < 10 and ratios:
            break
        ratios.append(len(set(zip(block, block[1:], block[2:]))) / (len(block) - GRAM + 1))
    return sum(ratios) / len(ratios)


def literal_share(text: str, lines: list[str]) -> float:
    """Share of the text that is data, whatever its encoding: long lines with hardly a space, lines of numbers, runs of encoded signs."""
    total = 0
    for line in lines:
        if len(line) >= DATA_LINE and line.count(" ") * 40 <= len(line):
            total += len(line)
            continue
        bare = line.strip(" \t{}()[],;")
        if bare[:1].isdigit() or bare[:1] in ("-", "+"):
            if _NUMBERS.match(bare) and len(_NUMBER.findall(bare)) >= DATA_NUMBERS:
                total += len(line) + 1
            continue
        if len(bare) >= DATA_RUN:
            total += sum(len(run) for run in _OPAQUE.findall(bare) if len(run) >= DATA_RUN and any(map(str.isdigit, run)) and any(map(str.isalpha, run)))
    return total / max(1, len(text))


def is_dense(text: str) -> bool:
    """Whether the code, banners and strings aside, is squeezed into long lines with hardly a space."""
    body = _BANNER.sub("", _TEMPLATE.sub("", _STRING.sub("", text))).strip()
    if len(body) < 120:
        return False
    lines = [line for line in body.split("\n") if line.strip()]
    long_bytes = sum(len(line) for line in lines if len(line) >= SQUEEZED_LINE)
    spaces = sum(body.count(c) for c in " \t\n")
    return long_bytes >= 0.7 * len(body) and spaces <= 0.14 * len(body)


def content_marks(path: str, text: str) -> dict:
    """All that one file's text says, as plain values. Never fails; an empty text says nothing."""
    ext = extension(path)
    lines = text.replace("\r\n", "\n").split("\n")
    comments = [line for line in comment_lines(lines) if hinted(line)] if ext not in PROSE and hinted(text) else []
    kept = any(_KEPT.search(line) for line in comments)
    code = ext in CODE
    return {
        "signed": not kept and any(_GENERATED.search(line) for line in comments),
        "kept": kept,
        "foreign": any(_FOREIGN.search(line) for line in comments),
        "dense": ext in SHEETS and is_dense(text),
        "repetition": repetition(text) if code and ext not in SCRIPTS else 1.0,
        "literal": literal_share(text, lines) if code else 0.0,
    }
