"""Profiles: TOML files, inheritance, layers and checks. Configuration is not data, so this is driver code."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from contextloom.functions.globs import glob_regex
from contextloom.functions.tables import CONFIDENCE_LEVELS

# What fields may hold, and what targets imply.
FORMATS, TOKENIZERS, TARGETS = ("markdown", "xml", "plain"), ("cl100k_base", "o200k_base", "none"), ("claude", "chatgpt", "generic")
TARGET_PRESETS = {"claude": {"format": "xml", "max_tokens": 200_000}, "chatgpt": {"format": "markdown", "max_tokens": 128_000}, "generic": {"format": "markdown"}}
SOFT_MAX_TOKENS, HARD_MAX_TOKENS = 500_000, 2_000_000
MAX_UPWARD = 20


@dataclass(frozen=True)
class Profile:
    """One profile's settings; empty values inherit."""

    extends: str = ""
    output: str = ""
    format: str = "markdown"
    max_tokens: int = 128_000
    tokenizer: str = "none"
    compression: bool = False
    redaction: bool = True
    target: str = ""
    ignore: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    priority_files: tuple[str, ...] = ()
    assert_include: tuple[str, ...] = ()
    slice_max_tokens: int = 20_000
    slice_depth: int = 2
    brief_max_tokens: int = 4_000
    tiers: Mapping[int, tuple[str, ...]] = field(default_factory=dict)
    confidence_threshold: str = "medium"
    exclude_paths: tuple[str, ...] = ()


_NAMES = {f.name for f in fields(Profile)}


def settings_of(table: Mapping) -> tuple[dict, list[str]]:
    """The settings that a TOML table sets, and the keys that mean nothing."""
    found, unknown = {}, []
    for key, value in table.items():
        if key == "relevance" and isinstance(value, Mapping):
            found["tiers"] = {int(k.removeprefix("tier_")): tuple(v) for k, v in value.items() if k.startswith("tier_")}
        elif key == "redaction_config" and isinstance(value, Mapping):
            found |= {k: tuple(v) if isinstance(v, list) else v for k, v in value.items() if k in ("confidence_threshold", "exclude_paths")}
            found |= {"redaction": value["enabled"]} if "enabled" in value else {}
        elif key in _NAMES:
            found[key] = tuple(value) if isinstance(value, list) else value
        else:
            unknown.append(key)
    return found, unknown


def load_profiles(path: str | Path) -> dict[str, dict]:
    """The settings of each profile of a TOML file; keys without meaning are left out."""
    with open(path, "rb") as file:
        return {name: settings_of(table)[0] for name, table in tomllib.load(file).get("profile", {}).items()}


def find_upward(name: str, start: str | Path) -> Path | None:
    """The nearest file of that name at or above ``start``; a repository's root ends the search."""
    here = Path(start).resolve()
    for folder in [here, *here.parents][:MAX_UPWARD]:
        if (folder / name).is_file():
            return folder / name
        if (folder / ".git").exists():
            return None
    return None


def resolved(name: str, profiles: Mapping[str, Mapping], seen: tuple[str, ...] = ()) -> tuple[Profile, tuple[str, ...]]:
    """The profile with all it inherits, and the chain of names; cycles and missing names raise.

    A profile that extends nothing extends ``default``, and that the built-in values.
    """
    if name in seen:
        raise ValueError("circular inheritance: " + " -> ".join((*seen, name)))
    own = profiles.get(name)
    if own is None and name != "default":
        raise KeyError(f"profile {name!r} is not defined")
    own = dict(own or {})
    parent = own.get("extends") or ("default" if name != "default" else "")
    if parent:
        base, chain = resolved(parent, profiles, (*seen, name))
    else:
        base, chain = Profile(), ()
    return replace(base, **{k: v for k, v in own.items() if k != "extends"}, extends=own.get("extends", "")), (name, *chain)


def layered(profile: Profile, *, env: Mapping[str, str] | None = None, prefix: str = "CONTEXT_", target: str = "", flags: Mapping | None = None) -> Profile:
    """Layers over a profile, later ones stronger: environment, preset of the target, flags. Bad numbers in the environment are ignored."""
    out = profile
    for key, cast in (("format", str), ("max_tokens", int), ("tokenizer", str), ("output", str), ("target", str), ("compression", None), ("redaction", None)):
        raw = (os.environ if env is None else env).get(prefix + key.upper())
        if raw is None:
            continue
        try:
            value = raw.strip().lower() in ("1", "true", "yes", "on") if cast is None else cast(raw)
        except ValueError:
            continue
        out = replace(out, **{key: value})
    chosen = (flags or {}).get("target") or target or out.target
    if chosen:
        if chosen not in TARGET_PRESETS:
            raise ValueError(f"unknown target {chosen!r}")
        out = replace(out, target=chosen, **TARGET_PRESETS[chosen])
    return replace(out, **{k: v for k, v in (flags or {}).items() if v is not None})


def problems(name: str, profile: Profile) -> list[tuple[str, str, str]]:
    """``(severity, field, message)`` of what is wrong or doubtful with a profile."""
    found = []
    for key, allowed in (("format", FORMATS), ("tokenizer", TOKENIZERS), ("target", ("", *TARGETS)), ("confidence_threshold", tuple(CONFIDENCE_LEVELS))):
        if getattr(profile, key) not in allowed:
            found.append(("error", f"{name}.{key}", f"{getattr(profile, key)!r} is not one of {', '.join(a for a in allowed if a)}"))
    if profile.max_tokens < 0 or profile.max_tokens > HARD_MAX_TOKENS:
        found.append(("error", f"{name}.max_tokens", f"{profile.max_tokens} is out of range"))
    elif profile.max_tokens > SOFT_MAX_TOKENS:
        found.append(("warning", f"{name}.max_tokens", f"{profile.max_tokens} is unusually large"))
    patterns = {f"tier_{t}": p for t, p in profile.tiers.items()} | {k: getattr(profile, k) for k in ("ignore", "include", "priority_files", "assert_include", "exclude_paths")}
    for where, globs in patterns.items():
        for glob in globs:
            try:
                glob_regex(glob)
            except ValueError as wrong:
                found.append(("error", f"{name}.{where}", str(wrong)))
    owners: dict[str, int] = {}
    for tier in sorted(profile.tiers):
        for glob in profile.tiers[tier]:
            if glob in owners:
                found.append(("warning", f"{name}.tier_{tier}", f"{glob!r} is already in tier {owners[glob]} and never decides here"))
            owners.setdefault(glob, tier)
    if sum(v not in ("", (), {}, None) and v != getattr(Profile(), k) for k, v in asdict(profile).items()) > 8:
        found.append(("warning", name, "many settings; consider splitting the profile"))
    return found


_SIZE_UNITS = {"KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}


def parsed_size(text: str) -> int:
    """Bytes of ``500``, ``12KB``, ``1.5 MB`` or ``2gb``; anything else, also a negative number, raises."""
    bare = text.strip()
    unit = _SIZE_UNITS.get(bare[-2:].upper())
    number = bare[:-2].strip() if unit else bare
    try:
        size = int(number)
    except ValueError:
        if not unit:
            raise ValueError(f"no size: {text!r}") from None
        try:
            size = float(number)
        except ValueError:
            raise ValueError(f"no size: {text!r}") from None
    if not size >= 0 or size == float("inf"):
        raise ValueError(f"a size can't be negative or endless: {text!r}")
    return int(size * (unit or 1))


def diff_mode(since: str = "", base: str = "", head: str = "") -> str:
    """``since``, ``range`` or ``cache``: what a comparison is made against; contradicting or half-given references raise."""
    if since and (base or head):
        raise ValueError("a start and a range exclude each other")
    if bool(base) != bool(head):
        raise ValueError("a range needs both of its ends")
    return "since" if since else "range" if base else "cache"
