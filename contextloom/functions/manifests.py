"""What build files and package manifests say, as short Markdown sections. Empty where there is nothing to say."""

from __future__ import annotations

import json
import re
import tomllib

_TARGET = re.compile(r"^([a-zA-Z_][a-zA-Z0-9_\-]*)\s*:", re.M)


def make_section(text: str) -> str:
    """Targets of a make file in order of first appearance."""
    targets = dict.fromkeys(_TARGET.findall(text))
    return "Available targets:\n" + "".join(f"- `{t}`\n" for t in targets) if targets else ""


def package_json_section(text: str) -> str:
    """Name and scripts, in order of their names."""
    try:
        package = json.loads(text)
        scripts = package.get("scripts") or {}
        name = package.get("name") or ""
    except (ValueError, AttributeError):
        return ""
    if not isinstance(scripts, dict) or not scripts:
        return ""
    return (f"Package: {name}\n" if name else "") + "Scripts:\n" + "".join(f"- `{k}`: `{scripts[k]}`\n" for k in sorted(scripts))


def go_mod_section(text: str) -> str:
    """Module path and language version, in the file's order."""
    found = re.findall(r"^\s*(module|go) (.+?)\s*$", text, re.M)
    return "".join(f"{'Module' if kind == 'module' else 'Go version'}: {value}\n" for kind, value in found)


def _table(text: str, name: str) -> dict:
    try:
        table = tomllib.loads(text).get(name, {})
    except tomllib.TOMLDecodeError:
        return {}
    return table if isinstance(table, dict) else {}


def cargo_section(text: str) -> str:
    package = _table(text, "package")
    return "".join(f"{label}: {package[key]}\n" for key, label in (("name", "Crate"), ("version", "Version"), ("edition", "Edition")) if isinstance(package.get(key), str))


def pyproject_section(text: str) -> str:
    project = _table(text, "project")
    return "".join(f"{label}: {project[key]}\n" for key, label in (("name", "Project"), ("version", "Version"), ("requires-python", "Python")) if isinstance(project.get(key), str))


_BY_NAME = {"makefile": make_section, "gnumakefile": make_section, "package.json": package_json_section, "go.mod": go_mod_section, "cargo.toml": cargo_section, "pyproject.toml": pyproject_section}


def manifest_section(path: str | None, text: str | None) -> str:
    """The section of a build file, told by its name; other files have none."""
    extract = _BY_NAME.get((path or "").rsplit("/", 1)[-1].lower())
    return extract(text) if extract and text else ""
