"""Credential grammars in one deterministic automaton, and the judgement of what they match.

Token formats, key armor, connection strings, connection calls and the words that announce a credential
(names of secrets, headers, flags) are one table; a text is scanned once. What stands under a name is
then read at its place on the whole text.
"""

from __future__ import annotations

import base64
import binascii
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

from contextloom.llm.automaton import Automaton, all_but, alt, chars, lit, many, seq

#: Characters of texts that are scanned in one go.
BATCH_CHARS = 1 << 22


class Span(NamedTuple):
    """A literal credential, as character offsets into the whole text."""

    start: int
    end: int
    kind: str


_UPPER, _LOWER, _DIGIT = string.ascii_uppercase, string.ascii_lowercase, string.digits
_ALNUM = _UPPER + _LOWER + _DIGIT
_URLSAFE = _ALNUM + "_-"
_BASE64 = _ALNUM + "+/="
# Published prefixes of token formats, with the characters that follow and how many (0: no end).
TOKEN_FORMATS = (
    ("AKIA", _UPPER + _DIGIT, 16, 16, "aws_access_key_id"),
    ("ASIA", _UPPER + _DIGIT, 16, 16, "aws_access_key_id"),
    ("ABIA", _UPPER + _DIGIT, 16, 16, "aws_access_key_id"),
    ("ACCA", _UPPER + _DIGIT, 16, 16, "aws_access_key_id"),
    ("A3T", _UPPER + _DIGIT, 17, 17, "aws_access_key_id"),
    ("ghp_", _ALNUM, 20, 0, "github_token"),
    ("gho_", _ALNUM, 20, 0, "github_token"),
    ("ghu_", _ALNUM, 20, 0, "github_token"),
    ("ghs_", _ALNUM, 20, 0, "github_token"),
    ("ghr_", _ALNUM, 20, 0, "github_token"),
    ("github_pat_", _ALNUM + "_", 22, 0, "github_token"),
    ("glpat-", _URLSAFE, 20, 0, "gitlab_token"),
    ("sk_live_", _ALNUM, 16, 0, "stripe_api_key"),
    ("rk_live_", _ALNUM, 16, 0, "stripe_api_key"),
    ("sk-", _URLSAFE, 20, 0, "openai_api_key"),
    ("xoxb-", _ALNUM + "-", 16, 0, "slack_token"),
    ("xoxp-", _ALNUM + "-", 16, 0, "slack_token"),
    ("xoxa-", _ALNUM + "-", 16, 0, "slack_token"),
    ("xoxo-", _ALNUM + "-", 16, 0, "slack_token"),
    ("xoxr-", _ALNUM + "-", 16, 0, "slack_token"),
    ("xoxs-", _ALNUM + "-", 16, 0, "slack_token"),
    ("AIza", _URLSAFE, 30, 0, "gcp_api_key"),
    ("npm_", _ALNUM, 30, 0, "npm_token"),
    ("SK", _DIGIT + "abcdef", 32, 32, "twilio_api_key"),
    ("AccountKey=", _BASE64, 40, 0, "azure_connection_string"),
    ("SharedAccessKey=", _BASE64, 40, 0, "azure_connection_string"),
)
# Prefixes of formats of several parts joined by dots, and the least lengths of the parts.
DOTTED_FORMATS = (("SG.", (16, 16), "sendgrid_api_key"), ("eyJ", (8, 8, 8), "jwt_token"))
# Ends of names under which credentials are kept.
SECRET_NAMES = (
    "password passwd passphrase passwort pass pwd pw secret secrets token cred creds credential credentials apikey apitoken "
    "authtoken accesstoken authkey"
).split()
KEY_QUALIFIERS = (
    "api app access deploy signing sign hmac licence license encryption auth private secret service account master storage shared client admin "
    "root session webhook user db database crypt cipher aes jwt cookie"
).split()
# Parameters of addresses that carry a credential, beside the names above.
QUERY_NAMES = "sig signature auth key".split()
# Words that mark a value as a stand-in wherever they stand in it.
STAND_IN_WORDS = (
    "your example sample mock fake dummy placeholder changeme change replace replaceme redacted goes here todo fixme tbd notreal xxx foo bar foobar unset notset hunter2 letmein"
).split()
# Words that don't make a value a credential when it has no other parts.
PLAIN_WORDS = (
    "you me my not a real insert put enter none null undefined nil true false test testing default value vault store given password passwd secret token key "
    "admin root guest empty optional required string bool int user the db auth api"
).split()
# First words of instructions to put a value in, and the nouns that end them.
LEAD_WORDS, NOUNS = frozenset("my put insert enter set add some the use".split()), frozenset("token key secret password passwd value here".split())

_SUFFIX = re.compile(
    r"(?i:(?:" + "|".join(sorted(set(SECRET_NAMES) - {"pw"}, key=len, reverse=True)) + r"|(?-i:(?<![a-zA-Z])(?:pw|Pw|PW)|(?<=[a-z])P[wW])|(?:" + "|".join(KEY_QUALIFIERS) + r")[_.-]?key)s?\d{0,8})$"
)
_QUERY_NAME = re.compile(r"(?i)^(?:.*[_-])?(?:" + "|".join(QUERY_NAMES) + ")$")
#: A name's end has to lie within so many characters of it; the longest ending above has fewer.
_ENDING = 40
#: From the end of a secret's name to the start of its value: closing quotes, types, separators, also over line ends.
_BETWEEN = re.compile(
    r"(?P<name_end>[\"'`\]]{0,2})[ \t]*(?:(?<=[\"'][ \t])(?:value|content)[ \t]*(?==))?"
    r"(?:(?:\[\d*\])?[ \t]*(?::[ \t]*&?(?:'static[ \t]+)?(?:str|string|String|char|Text|\[u8\]|\w+)(?=[ \t]+=[ \t]))?[ \t]*"
    r"(?P<sep>=>|:=|\?=|={1,3}|:|,(?=[ \t]*[\"'`])|\((?=[ \t]*[\"'`])|\{(?=[ \t]*\")|>(?!=))"
    r"[ \t]*|(?P<space>[ \t]+))"
    r"(?:(?:new[ \t]+)?(?:String|std::string|Some|Buffer\.from|bytes|str|b64decode|atob|\w+\.(?:from|decode|valueOf))?\([ \t]*)?"
    r"(?P<wrap>(?:\\|\(|[|>][-+]?)?[ \t]*\r?\n[ \t]*(?:[#/*]+[ \t]*)?(?=[\"'`\w])|\([ \t]*)?"
)
_QUOTED = re.compile(r"(?:[rbuf]|&)?(\"\"\"|'''|\"|'|`)((?:\\.|(?!\1)[^\\\n])*?)(?:\1|(?=\\?\n)|$)")
_BARE = re.compile(r"[^\s\"'`<>,;]{4,}")
_TAG = re.compile(r"([^<\s][^<\n]{3,}?)\s*</")
_RUN = re.compile(r"[\w-]*")
_BODY_RUN = re.compile(r"[A-Za-z0-9+/=]{24,}")
_QUERY_VALUE = re.compile(r"=([^&\s\"'`<>#]{6,})")
_HEADER = re.compile(r"(?i)(basic|bearer)[ \t]+([A-Za-z0-9._~+/=-]{6,})")
_USER_VALUE = re.compile(r"[ =]?[\"']?([\w.@-]+):([^\s\"'@]+)")
_PASS_VALUE = re.compile(r"[ ]?[\"']?([^\s\"'`-][^\s\"'`]{5,})")
_CLIENTS = re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb|psql|redis-cli|mongo|mongosh|sshpass|docker login|helm|ldapsearch|curl|smbclient|htpasswd|sqlcmd)\b")
_LOOKUP = re.compile(
    r"\$\{|\$\(|\{\{|\}\}|%\(|@@|<[\w .-]+>|^\$\w+|^%[\w.-]+%$|^\[[^\]]*\]$|REDACTED|process\.env|os\.environ|getenv|ENV\[|env\(|secrets?\.|\bvault[.:/ ]|config\.|"
    r"^\w+\([^)]*\)?;?$|^[a-z]\w*\.[a-z]\w*(?:\.\w+)*(?:\(.*)?$|^&?\w+\[.*\]$|^\*?[A-Za-z_]\w*->",
    re.I,
)
_STAND_IN, _PLAIN = frozenset(STAND_IN_WORDS), frozenset(STAND_IN_WORDS) | frozenset(PLAIN_WORDS)
_WORDS = re.compile(r"[a-z]+|[0-9]+", re.I)
_PARTS = re.compile(r"[-_ .]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_JOINT = re.compile(r"[\"'`][ \t]*(?:\+|\.|\\|&)?[ \t]*\\?[ \t]*\r?\n?[ \t]*(?:\+|\.)?[ \t]*[\"'`]")
_PIECE = re.compile(r"[A-Za-z0-9_.+/=-]+")
_SAME = re.compile(r"(.)\1{5,}")
_IDENTIFIER = re.compile(r"[A-Za-z]+(?:[_. -][A-Za-z]+)*")
_PATHLIKE = re.compile(r"^(?:[\w.-]*/)+[\w.-]+\.\w{1,5}$|^[a-z]+://|^/[a-z0-9_./-]+$|^\.{1,2}/")
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
_DIGESTED = re.compile(r"^(?:sha\d+[-:]|\$2[aby]\$|\$argon2|\$[156]\$|\{SSHA|pbkdf2|scrypt:|ssh-(?:rsa|ed25519|dss)|ecdsa-|AAAA[BCE]3)|^h1:", re.I)
_ESCAPED = re.compile(r"(?:\\x[0-9a-fA-F]{2}|\\u00[0-9a-fA-F]{2}|%[0-9a-fA-F]{2}|&#x?\w+;)")


def _looks_random(part: str) -> bool:
    """Whether a part of a value mixes letters and digits as no word does."""
    digits, letters = sum(map(str.isdigit, part)), sum(map(str.isalpha, part))
    return len(part) >= 6 and digits >= 2 and letters >= 2 and len(re.findall(r"\d+|[a-z]+|[A-Z]+", part)) >= 3


def is_dummy(value: str) -> bool:
    """Whether a value, taken as a whole, is a stand-in: repeated signs, or words that say so and nothing random beside them."""
    if len(set(value)) <= 2 or _SAME.search(value) or "..." in value:
        return True
    if not any(c.isalnum() for c in value):
        return len(set(value)) < 4
    lowered = value.lower()
    if lowered.startswith(("sk-your", "1234", "abc123", "qwerty")):
        return True
    parts = [p for p in _PARTS.split(value) if p]
    if any(_looks_random(p) for p in parts):
        return False
    words = [p.lower() for p in parts]
    if any(w in _STAND_IN for w in words) or words[:3] == ["not", "a", "real"]:
        return True
    if words and words[0] in LEAD_WORDS and words[-1] in NOUNS:
        return True
    return all(w.lower() in _PLAIN for w in _WORDS.findall(_HUMP.sub(" ", value)) if w.isalpha())


def is_reference(value: str) -> bool:
    """Whether a value only points to where the credential is."""
    return bool(_LOOKUP.search(value))


def is_secret_value(value: str, *, quoted: bool, free: bool = False) -> bool:
    """Whether a value under a secret's name is a literal credential.

    ``quoted``: it stands in quotes; ``free``: it follows a name in prose, so it has to look the part.
    """
    v = value.strip()
    if len(v) < 4 or is_reference(v) or _DIGESTED.search(v) or _PATHLIKE.search(v) or _UUID.fullmatch(v):
        return False
    plain = _ESCAPED.sub("x1", v) if _ESCAPED.search(v) else v
    if is_dummy(plain):
        return False
    digits, letters = any(c.isdigit() for c in plain), any(c.isalpha() for c in plain)
    special = any(not c.isalnum() and c not in " \t" for c in plain)
    mixed = any(c.islower() for c in plain) and any(c.isupper() for c in plain)
    if len(v) < 6:
        return quoted and digits and special and letters
    if " " in v and not (special and digits and v.count(" ") <= 1):
        return False
    if _IDENTIFIER.fullmatch(plain):
        upper, lower = sum(map(str.isupper, plain)), sum(map(str.islower, plain))
        return len(plain) >= 10 and min(upper, lower) >= 0.3 * (upper + lower) or mixed and len(plain) >= 16 and upper >= 4 and not re.search(r"[_. -]", plain)
    if not letters:
        return digits and special and len(set(v)) >= 5
    if free:
        return digits and (special or mixed or len(v) >= 16) or mixed and special and len(v) >= 8
    return digits or (mixed and special)


def decoded(value: str) -> str | None:
    """What a base64 text holds, if it decodes."""
    try:
        return base64.b64decode(value + "=" * (-len(value) % 4), validate=False).decode("utf-8")
    except (ValueError, binascii.Error):
        return None


def _armor():
    """A private key's armor: begin line, header lines, runs of base64 with any joints of literals, and its end line."""
    escape = seq(lit("\\"), chars("nrt\\\"'/\r\n "))
    # runs begin with a letter, a digit or "="; a joint begins with a sign that isn't base64: so a text is read one way
    opening = alt(chars(" \t\r\n\"'`,;.()#*>|&<"), escape)
    joint = seq(opening, many(alt(opening, chars("+/"))))
    run = lambda least: seq(chars(_ALNUM + "="), many(chars(_BASE64), least - 1))
    label = many(chars(_UPPER + _DIGIT + " "), 0)
    tail = seq(lit("PRIVATE KEY"), many(lit(" BLOCK"), 0, 1), lit("-----"))
    header = seq(many(chars(_ALNUM + "-"), 2), lit(":"), many(all_but("\r\n\\\"'`")), joint)
    begin = seq(lit("-----BEGIN "), label, tail, joint, many(header))
    body = seq(run(24), many(seq(joint, run(24))))
    close = seq(many(seq(joint, run(1)), 0, 3), many(joint, 0, 1), lit("-----END "), label, tail)
    return seq(begin, body), seq(begin, body, close)


@cache
def automaton() -> Automaton:
    """All grammars in one table; built once per process."""
    grammars: dict = {}
    for prefix, allowed, least, most, kind in TOKEN_FORMATS:
        grammars[f"format {prefix} {kind}"] = (seq(lit(prefix), many(chars(allowed), least, most or None)), False)
        grammars[f"prefix {prefix} {kind}"] = (lit(prefix), False)
    for prefix, parts, kind in DOTTED_FORMATS:
        body = [many(chars(_URLSAFE), parts[0])]
        for least in parts[1:]:
            body += [lit("."), many(chars(_URLSAFE), least)]
        grammars[f"format {prefix} {kind}"] = (seq(lit(prefix), *body), False)
        grammars[f"prefix {prefix} {kind}"] = (lit(prefix), False)
    grammars["armor open"], grammars["armor closed"] = ((part, True) for part in _armor())
    joints = seq(chars(" \t\r\n\"'\\"), many(chars(" \t\r\n\"'\\+")))
    grammars["encoded"] = (seq(lit("LS0tLS1CRUdJTi"), many(chars(_BASE64)), many(seq(joints, chars(_ALNUM), many(chars(_BASE64), 19)))), False)
    user = many(all_but(" \t\r\n/:@\"'`<>"))
    host = chars(_ALNUM + "_.[{$-", other=True)
    grammars["userinfo"] = (seq(lit("://"), user, lit(":"), alt(many(all_but(" \t\r\n/\"'`<>"), 1), many(all_but(" \t\r\n@\"'`<>"), 1)), lit("@"), host), True)
    blank, quote = many(chars(" \t\r\n")), chars("\"'`")
    server = seq(many(all_but(" \t\r\n\"'`,()"), 1), chars(".:"), many(all_but(" \t\r\n\"'`,()"), 1))
    account = many(chars(_ALNUM + "_.@\\-", other=True), 1)
    grammars["call"] = (seq(lit("("), blank, quote, server, quote, blank, lit(","), blank, quote, account, quote, blank, lit(","), blank, quote), True)
    for word in ("pass", "pwd", "pw", "secret", "token", "key", "cred", "sig", "auth"):
        grammars[f"name {word}"] = (lit(word, fold=True), True)
    for word in ("basic ", "bearer "):
        grammars[f"header {word}"] = (lit(word, fold=True), False)
    for flag in ("-u", "--user", "--proxy-user"):
        grammars[f"user {flag}"] = (lit(flag), False)
    grammars["flag -p"] = (lit("-p"), False)
    return Automaton(grammars)


def joined_literal(text: str, at: int) -> tuple[str, int]:
    """The token that starts at ``at``, put together over adjacent string literals, and where its last piece ends."""
    pieces, end = [], at
    while m := _PIECE.match(text, end):
        pieces.append(m.group(0))
        end = m.end()
        joint = _JOINT.match(text, end)
        if not joint:
            break
        end = joint.end()
    return "".join(pieces), end


class _Words:
    """The run of word characters and dots around an offset; runs are walked once, however many names they hold."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, 0, 0

    def around(self, start: int, end: int) -> tuple[int, int]:
        if not self.begin <= start < self.end:
            begin = start
            while begin > self.end and (self.text[begin - 1].isalnum() or self.text[begin - 1] in "_.-"):
                begin -= 1
            self.begin, self.end = begin, begin
        if end > self.end:
            self.end = _RUN.match(self.text, end).end()
        return self.begin, self.end


def _named(text: str, begin: int, stop: int, code: bool) -> Iterator[Span]:
    """The literal under the name ``text[begin:stop]``, if that is the name of a secret."""
    lowered = text[max(begin, stop - 2 * _ENDING) : stop].lower()
    if begin and text[begin - 1] in "?&;" and text[stop : stop + 1] == "=" and (_SUFFIX.search(lowered) or _QUERY_NAME.match(lowered)):
        value = _QUERY_VALUE.match(text, stop)
        if value and is_secret_value(value.group(1), quoted=False):
            yield Span(value.start(1), value.end(1), "generic_secret")
        return
    if not _SUFFIX.search(text[max(begin, stop - _ENDING) : stop]) or "public" in lowered:
        return
    gap = _BETWEEN.match(text, stop)
    if not gap or not gap.group(0):
        return
    kind = "password" if "pass" in lowered or "pwd" in lowered or lowered.endswith("pw") else "generic_api_key" if "key" in lowered else "generic_secret"
    sep, pos = gap.group("sep"), gap.end()
    quoted = _QUOTED.match(text, pos)
    if sep == ">":
        tag = _TAG.match(text, pos)
        if tag and is_secret_value(tag.group(1), quoted=True):
            yield Span(tag.start(1), tag.end(1), kind)
        return
    if quoted and len(quoted.group(2)) >= 4:
        free = bool(gap.group("space")) and not sep and not gap.group("name_end")
        if is_secret_value(quoted.group(2), quoted=True, free=free):
            yield Span(quoted.start(2), quoted.end(2), kind)
        return
    if gap.group("wrap") and "\n" in gap.group("wrap") and sep not in (":", "="):
        return
    bare = _BARE.match(text, pos)
    if not bare:
        return
    value = bare.group(0).rstrip(").]}\\") if code else bare.group(0).rstrip("\\")
    if sep is None:
        if is_secret_value(value.rstrip(".,:)"), quoted=False, free=True):
            yield Span(bare.start(), bare.start() + len(value.rstrip(".,:)")), kind)
        return
    line_start = text.rfind("\n", 0, begin) + 1
    in_comment = text[line_start:begin].lstrip().startswith(("//", "#", "*", "/*", "--", ";", "<!--"))
    if code and not in_comment and sep in (":", "=", ":=", "=>", ",", "==", "===") and re.fullmatch(r"[A-Za-z_][\w.]*(?:\(.*)?[;,)]*", value):
        return
    if "\n" in (gap.group("wrap") or "") and not is_secret_value(value, quoted=False, free=True):
        return
    if is_secret_value(value, quoted=False):
        yield Span(bare.start(), bare.start() + len(value), kind)


def _key_block(text: str, start: int, end: int, closed: bool) -> Iterator[Span]:
    """A key's armor; one without its end line ends with its last line of base64, so that no code after it is taken."""
    stop, genuine = start, False
    for run in _BODY_RUN.finditer(text, start, end):
        body = run.group(0)
        base64ish = any(map(str.isdigit, body)) and any(map(str.isupper, body)) and any(map(str.islower, body)) and not is_dummy(body)
        if base64ish:
            genuine, stop = True, run.end()
        elif not closed:
            break
    if genuine:
        yield Span(start, end if closed else stop, "private_key_block")


def _format(text: str, start: int, end: int, prefix: str, kind: str, whole: bool) -> Iterator[Span]:
    body, stop = text[start:end], end
    if not whole:
        body, stop = joined_literal(text, start)
        match = next((m for m in automaton().scan(body) if m[0] == 0 and f"format {prefix} {kind}" in m[2]), None)
        if match is None or match[1] < len(body):
            return
    elif text[end : end + 1].isalnum():
        return
    rest = body[len(prefix) :]
    if not is_dummy(rest) and not _SAME.search(rest) and "your" not in rest.lower() and (any(map(str.isdigit, rest)) or len(set(rest)) > 7):
        yield Span(start, stop, kind)


def _matches(text: str, words: _Words, start: int, end: int, tags: frozenset, code: bool) -> Iterator[Span]:
    for tag in tags:
        what, _, rest = tag.partition(" ")
        if what == "name":
            yield from _named(text, *words.around(start, end), code)
        elif what in ("format", "prefix"):
            prefix, _, kind = rest.rpartition(" ")
            yield from _format(text, start, end, prefix, kind, what == "format")
        elif what == "armor":
            yield from _key_block(text, start, end, "armor closed" in tags)
        elif what == "encoded":
            head = decoded(re.sub(r"[^A-Za-z0-9+/]", "", text[start:end])[:64])
            if head and "PRIVATE KEY" in head:
                yield Span(start, end, "private_key_block")
        elif what == "userinfo":
            at = text.index(":", start + 3) + 1
            value = text[at : end - 2]
            if len(value) >= 3 and not re.match(r"\d{1,5}/", value) and not is_reference(value) and not is_dummy(value):
                yield Span(at, end - 2, "connection_string")
        elif what == "call":
            value = _QUOTED.match(text, end - 1)
            if value and is_secret_value(value.group(2), quoted=True, free=True):
                yield Span(value.start(2), value.end(2), "password")
        elif what == "header" and (m := _HEADER.match(text, start)):
            value = m.group(2)
            if m.group(1).lower() == "basic":
                inner = decoded(value)
                if inner and ":" in inner and inner.isprintable() and not is_dummy(inner.partition(":")[2]):
                    yield Span(m.start(2), m.end(2), "basic_auth")
            elif len(value) >= 12 and is_secret_value(value, quoted=False, free=True):
                yield Span(m.start(2), m.end(2), "bearer_token")
        elif what == "user" and (m := _USER_VALUE.match(text, end)) and is_secret_value(m.group(2), quoted=False):
            yield Span(m.start(2), m.end(2), "password")
        elif what == "flag" and start and text[start - 1] in " \t\"'" and (m := _PASS_VALUE.match(text, end)):
            if _CLIENTS.search(text, text.rfind("\n", 0, start) + 1, start) and is_secret_value(m.group(1), quoted=False):
                yield Span(m.start(1), m.end(1), "password")


def _in_order(found: set[Span]) -> list[Span]:
    kept: list[Span] = []
    for span in sorted(found, key=lambda s: (s.start, -s.end, s.kind.startswith(("generic", "password")), s.kind)):
        if not kept or span.start >= kept[-1].end:
            kept.append(span)
    return kept


def find_in_texts(texts: list[str | None], code: list[bool]) -> list[list[Span]]:
    """For each text all its literal credentials, in order, without overlaps; none in a null or empty text.

    ``code``: whether the file is in a programming language, where a bare word after ``=`` is a variable.
    Of overlapping finds the one that starts first is kept, of equal starts the longest.
    """
    out: list[list[Span]] = [[] for _ in texts]
    batch: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        begins, at = [], 0
        for k in batch:
            begins.append(at)
            at += len(texts[k]) + 1
        finds: dict[int, set[Span]] = {}
        words: dict[int, _Words] = {}
        for start, end, tags in automaton().scan("\0".join(texts[k] for k in batch)):
            n = bisect_right(begins, start) - 1
            k, base = batch[n], begins[n]
            if k not in words:
                words[k] = _Words(texts[k])
            finds.setdefault(k, set()).update(_matches(texts[k], words[k], start - base, end - base, tags, code[k]))
        for k, spans in finds.items():
            out[k] = _in_order(spans)
        batch.clear()
        held = 0

    for k, text in enumerate(texts):
        if not text:
            continue
        batch.append(k)
        held += len(text)
        if held >= BATCH_CHARS:
            flush()
    if batch:
        flush()
    return out


def find_credentials(text: str | None, code: bool = False) -> list[Span]:
    """``find_in_texts`` of one text."""
    return find_in_texts([text], [code])[0]


def line_starts(text: str) -> list[int]:
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def line_of(starts: list[int], offset: int) -> int:
    """The line, counted from 1, on which the character at ``offset`` stands."""
    return bisect_right(starts, offset)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by ``[REDACTED:<type>]``; line ends inside a span stay, so line numbers do."""
    if not text or not spans:
        return text
    out, at = [], 0
    for span in spans:
        out += [text[at : span.start], f"[REDACTED:{span.kind}]", "\n" * text.count("\n", span.start, span.end)]
        at = span.end
    return "".join([*out, text[at:]])
