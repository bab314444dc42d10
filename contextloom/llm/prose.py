"""The running prose of a document, sentence by sentence."""

from __future__ import annotations

import re

_FENCE = re.compile(r"^[ \t>]*(`{3,}|~{3,}).*?(?:^[ \t>]*\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_FRONT = re.compile(r"\A---\n.*?\n---\n", re.S)
_INLINE_CODE = re.compile(r"`[^`\n]*`")
_IMAGE_OR_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)|!?\[([^\]\n]*)\]\[[^\]\n]*\]")
_URL = re.compile(r"(?:https?|ftp|mailto):[^\s>)\]]+|<[^<>\n]{1,200}>")
_HEADING = re.compile(r"^[ \t]*#{1,6}[ \t].*$|^.+\n[ \t]*(?:={3,}|-{3,})[ \t]*$", re.M)
_TABLE = re.compile(r"^[ \t]*\|.*$|^.*\S[ \t]*\|[ \t]*\S.*\|.*$", re.M)
_INDENTED = re.compile(r"^(?: {4,}|\t)(?![-*+\d ]).*$", re.M)
_QUOTE = re.compile(r"^[ \t]*>.*$", re.M)
_BULLET = re.compile(r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+", re.M)
_BREAK = re.compile(r"\n[ \t]*\n|(?<=[.!?:;])[ \t\n]+(?=[^a-z])|\n(?=[ \t]*(?:[-*+]|\d+[.)])[ \t])")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence in lower case; code, tables, links, headings and quotes are no running prose.

    A short paragraph of one line without an end mark is a title.
    """
    text = text.replace("\r\n", "\n")
    text = _FRONT.sub("", text)
    text = _FENCE.sub("\n\n", text)
    if "<" in text:
        text = _COMMENT.sub(" ", text)
    text = _HEADING.sub("\n\n", text)
    if "|" in text:
        text = _TABLE.sub("\n\n", text)
    text = _QUOTE.sub("\n\n", text)
    text = _INDENTED.sub("", text)
    text = _IMAGE_OR_LINK.sub(" ", text)
    text = _URL.sub(" ", text)
    text = _INLINE_CODE.sub(" ", text)
    found = []
    for part in _BREAK.split(text):
        if not part or part.isspace():
            continue
        bullet = _BULLET.match(part)
        words = _WORD.findall(part.lower())
        if not words or not bullet and len(words) <= 5 and part.rstrip()[-1] not in ".!?;:":
            continue
        found.append(words)
    return found
