"""The redaction rules and the scan of one text by them."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

from contextloom.functions.tables import CONFIDENCE_LEVELS, ENTROPY_THRESHOLDS, REDACTION_RULES, SUSPICIOUS_WORDS


@dataclass(frozen=True)
class Rule:
    """A pattern for one kind of secret; its first group, if any, is the secret."""

    rule_id: str
    secret_type: str
    confidence: str
    pattern: str
    least_entropy: float = 0.0
    keywords: tuple[str, ...] = ()
    regex: re.Pattern = field(init=False, repr=False, compare=False)
    lowered: tuple[str, ...] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "regex", re.compile(self.pattern, re.ASCII))
        object.__setattr__(self, "lowered", tuple(k.lower() for k in self.keywords))


BUILT_IN = tuple(Rule(i, t, c, p, e, k) for i, t, c, e, k, p in REDACTION_RULES)

_BEGIN = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
_MASKED = re.compile(r"\[REDACTED:[^\]]*\]")
_TOKEN = re.compile(r"[^ \t=:\"']+")
_LONG_TOKEN = re.compile(r"[^ \t=:\"'\n]{8,}")
_HEX, _ALNUM, _BASE64 = re.compile(r"[0-9a-fA-F]+"), re.compile(r"[0-9A-Za-z]+"), re.compile(r"[0-9A-Za-z+/=_-]+")


@lru_cache(maxsize=1 << 16)
def entropy(value: str) -> float:
    """Bits per character of the first 256 characters; 0 below 16."""
    if len(value) < 16:
        return 0.0
    head = value[:256]
    return -sum(n / len(head) * math.log2(n / len(head)) for n in Counter(head).values())


@lru_cache(maxsize=1 << 16)
def charset_of(value: str) -> str:
    if not value:
        return "unknown"
    return "hex" if _HEX.fullmatch(value) else "alphanumeric" if _ALNUM.fullmatch(value) else "base64" if _BASE64.fullmatch(value) else "mixed"


def _variable(before: str) -> str:
    """The name left of the first ``=`` or ``:`` of a line."""
    at = min((i for i in (before.find("="), before.find(":")) if i > 0), default=-1)
    return re.split(r"[.\[ \t]", before[:at].strip())[-1] if at > 0 else ""


def scan_text(text: str | None, rules: tuple[Rule, ...], threshold: str, sensitive: bool) -> tuple[str | None, list[tuple]]:
    """The text with secrets replaced, and ``(line, start, end, rule_id, secret_type, confidence)`` of each.

    Columns are bytes of the line, the end exclusive. A sensitive file lowers the threshold by one level. Key
    blocks are blanked line by line, so lines keep their numbers; a block without end runs to the end.
    """
    if not text:
        return text, []
    level = CONFIDENCE_LEVELS.get(threshold, 0) - bool(sensitive)
    active = [r for r in rules if CONFIDENCE_LEVELS[r.confidence] >= level]
    by_entropy = sensitive or level <= 0
    words = sorted({k for r in active for k in r.lowered}, key=len)
    every = any(not r.lowered for r in active)
    hint = re.compile("|".join(re.escape(w) for w in words)) if words else None
    if not by_entropy and not every and "PRIVATE KEY" not in text and not (hint and hint.search(text.lower())):
        return text, []
    out, found, inside = [], [], False
    for number, line in enumerate(text.split("\n"), 1):
        if inside:
            inside = not _END.search(line)
            out.append("")
            continue
        if level <= CONFIDENCE_LEVELS["high"] and "PRIVATE KEY" in line and _BEGIN.search(line):
            found.append((number, 0, len(line.encode()), "private-key-block", "private_key_block", "high"))
            inside = not _END.search(line)
            out.append("[REDACTED:private_key_block]")
            continue
        lowered = line.lower()
        hits = []
        for order, rule in enumerate(active) if every or hint and hint.search(lowered) else ():
            if rule.lowered and not any(k in lowered for k in rule.lowered):
                continue
            for m in rule.regex.finditer(line):
                start, end = m.span(1) if rule.regex.groups and m.group(1) is not None else m.span()
                if rule.least_entropy and entropy(line[start:end]) < rule.least_entropy:
                    continue
                hits.append((start, order, end, rule))
        at, pieces, masked = 0, [], []
        for start, _, end, rule in sorted(hits, key=lambda h: (h[0], h[1])):
            if start < at:
                continue
            pieces += [line[at:start], f"[REDACTED:{rule.secret_type}]"]
            masked.append((number, len(line[:start].encode()), len(line[:end].encode()), rule.rule_id, rule.secret_type, rule.confidence))
            at = end
        line = "".join([*pieces, line[at:]])
        found += masked
        if by_entropy and _LONG_TOKEN.search(line):
            line, more = _by_entropy(line, number, level)
            found += more
        out.append(line)
    return "\n".join(out), found


def _by_entropy(line: str, number: int, level: int) -> tuple[str, list[tuple]]:
    taken = [m.span() for m in _MASKED.finditer(line)]
    name = _variable(line)
    suspicious = any(w in name.lower() or w in line.lower() for w in SUSPICIOUS_WORDS)
    pieces, found, at = [], [], 0
    for m in _TOKEN.finditer(line):
        token, (start, end) = m.group(0), m.span()
        if len(token.encode()) < 16 or any(start < b and end > a for a, b in taken):
            continue
        limit = ENTROPY_THRESHOLDS.get(charset_of(token), ENTROPY_THRESHOLDS["mixed"]) - 0.5 * suspicious
        if entropy(token) < limit:
            continue
        confidence = "medium" if suspicious else "low"
        if CONFIDENCE_LEVELS[confidence] < level:
            continue
        pieces += [line[at:start], "[REDACTED:high_entropy_secret]"]
        found.append((number, len(line[:start].encode()), len(line[:end].encode()), "entropy", "high_entropy_secret", confidence))
        at = end
    return "".join([*pieces, line[at:]]), found
