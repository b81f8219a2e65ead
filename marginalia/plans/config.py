"""Configuration: discovery, inheritance, validation, and what it says about a path."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Mapping
from posixpath import dirname, join, normpath

from ..rules import registry

TOOL = "marginalia"
NAMES = (f".{TOOL}.toml", f"{TOOL}.toml", "pyproject.toml")
LANGUAGES = ("en", "zh", "ja")
LEXICONS = ("stale-markers", "constraint-markers", "commit-contexts", "pointer-markers", "source-pointers", "rationale-headings", "conversation-markers")
#: What each lexicon extends in ``rules.lexical``.
EXTENDS = dict(zip(LEXICONS, ("stale", "constraint", "commit", "pointer", "source", "rationale", "conversation"), strict=True))
DEFAULTS = {
    "include": ["**/*.md", "**/*.markdown"], "exclude": [], "preview": False, "kinds": [], "domains": [], "sites": [],
    "lint": {
        "select": ["ALL"], "ignore": [], "languages": list(LANGUAGES), "per-file-ignores": {}, "lexicon": {}, "ptr": {"catalog-dirs": []},
        "dup": {"min-identifiers": 5, "min-jaccard": 0.8, "min-paragraph-similarity": 0.9, "min-paragraph-chars": 80, "shingle-size": 5},
    },
}
_EXTENSIONS = ("extend-select", "extend-ignore", "extend-exclude")
_DEPTH = 128


class ConfigError(ValueError):
    pass


def merged(base: dict, over: dict) -> dict:
    """Inherited settings: tables merge, arrays replace; what extends select, ignore or exclude is appended to what extends it already."""
    out = dict(base)
    for k, v in over.items():
        if k in _EXTENSIONS and isinstance(out.get(k), list) and isinstance(v, list):
            out[k] = [*out[k], *v]
        elif isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v)
        else:
            out[k] = v
    return out


def inherited(configs: Mapping[str, dict], name: str) -> dict:
    """A configuration with those that its ``extend`` names, relative to its own folder; cycles and deep chains raise."""
    chain: list[str] = []
    while name is not None:
        if name in chain:
            raise ConfigError(f"configuration cycle: {' -> '.join([*chain, name])}")
        if len(chain) >= _DEPTH:
            raise ConfigError(f"configuration inheritance exceeds {_DEPTH} files")
        if name not in configs:
            raise ConfigError(f"cannot read configuration {name}")
        chain.append(name)
        up = configs[name].get("extend")
        if up is not None and (not isinstance(up, str) or not up):
            raise ConfigError(f"{name}: extend must be a file's path")
        name = normpath(join(dirname(name), up)) if up else None
    out: dict = {}
    for step in reversed(chain):
        out = merged(out, {k: v for k, v in configs[step].items() if k != "extend"})
    return out


def settled(raw: dict, label: str = "configuration") -> dict:
    """Settings with defaults and extensions joined in, validated."""
    raw = dict(raw)
    lint = dict(raw.get("lint", {}))
    more = {"exclude": _strings(raw.pop("extend-exclude", []), f"{label}: extend-exclude")}
    more |= {k: _strings(lint.pop(f"extend-{k}", []), f"{label}: lint.extend-{k}") for k in ("select", "ignore")}
    raw["lint"] = lint
    _known(raw, DEFAULTS, label)
    out = merged(DEFAULTS, raw)
    out["exclude"] = [*out["exclude"], *more["exclude"]]
    out["lint"] = out["lint"] | {k: [*out["lint"][k], *more[k]] for k in ("select", "ignore")}
    validate(out, label)
    return out


def _strings(value, label: str) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ConfigError(f"{label} must be an array of strings")
    return value


def _known(raw: dict, shape: dict, label: str) -> None:
    for k, v in raw.items():
        if k not in shape:
            raise ConfigError(f"{label}: unknown field {k}")
        if isinstance(shape[k], dict) and k not in ("per-file-ignores", "lexicon"):
            if not isinstance(v, dict):
                raise ConfigError(f"{label}: {k} must be a table")
            _known(v, shape[k], label)


def valid_selector(s: str) -> bool:
    return s == "ALL" or s in registry.CODES or s in registry.FAMILIES


def validate(settings: dict, label: str = "configuration") -> None:
    """Raises ConfigError for the first wrong value."""
    lint = settings["lint"]

    def need(good: bool, what: str) -> None:
        if not good:
            raise ConfigError(f"{label}: {what}")

    for m in settings["kinds"]:
        need(set(m) == {"path", "kind"} and m["kind"] in registry.KINDS, f"unknown kind in {m}")
    for m in settings["domains"]:
        need(set(m) == {"path", "name"} and m["name"].strip() != "", "domains.name must not be empty")
    for m in settings["sites"]:
        need({"path", "root"} <= set(m) <= {"path", "root", "public", "base"}, f"unknown or missing field in site {m}")
        for f in ("root", "public"):
            v = m.get(f)
            need(v is None or (v.strip() != "" and not v.startswith(("/", "\\")) and not re.match(r"[A-Za-z]:[\\/]", v)), f"sites.{f} must be a folder relative to this configuration")
            need(v is None or not normpath(v).startswith(".."), f"sites.{f} is outside the workspace")
        base = m.get("base", "/")
        need(base.startswith("/") and "?" not in base and "#" not in base, "sites.base must be a path that starts with /")
    selectors = [*lint["select"], *lint["ignore"], *(s for ss in lint["per-file-ignores"].values() for s in ss)]
    for s in selectors:
        need(valid_selector(s), f"invalid rule selector {s}")
    for code in [*lint["languages"], *lint["lexicon"]]:
        need(code in LANGUAGES, f"unsupported language {code}")
    dup = lint["dup"]
    need(dup["min-identifiers"] >= 1, "lint.dup.min-identifiers must be at least 1")
    need(0 <= dup["min-jaccard"] <= 1, "lint.dup.min-jaccard must be from 0 to 1")
    need(0 < dup["min-paragraph-similarity"] <= 1, "lint.dup.min-paragraph-similarity must be above 0 and at most 1")
    need(dup["min-paragraph-chars"] >= 1 and dup["shingle-size"] >= 1, "lint.dup.min-paragraph-chars and shingle-size must be positive")
    need(all(x.strip() for x in lint["ptr"]["catalog-dirs"]), "lint.ptr.catalog-dirs entries must not be empty")
    for words in lint["lexicon"].values():
        need(set(words) <= {f"extend-{n}" for n in LEXICONS}, "unknown lexicon")
        need(all(x.strip() for xs in words.values() for x in xs), "lint.lexicon entries must not be empty")
    globs = [*settings["include"], *settings["exclude"], *(m["path"] for f in ("kinds", "domains", "sites") for m in settings[f]), *lint["per-file-ignores"]]
    need(all(globs), "a glob must not be empty")


def extra_words(settings: dict) -> dict[str, dict[str, list[str]]]:
    """Phrases that the lexicons add, as ``rules.lexical`` takes them."""
    out: dict[str, dict[str, list[str]]] = {}
    for code, words in settings["lint"]["lexicon"].items():
        for name, phrases in words.items():
            out.setdefault(EXTENDS[name.removeprefix("extend-")], {})[code] = phrases
    return out


def discover(texts: Mapping[str, str]) -> dict[str, dict]:
    """Settings by folder ("" for the root) from configuration files (path: text): of a folder the first of NAMES, with what it extends.

    A pyproject.toml counts only with a table for this tool.
    """
    parsed: dict[str, dict] = {}
    for path, text in texts.items():
        try:
            value = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"invalid configuration {path}: {e}") from e
        if path.rsplit("/", 1)[-1] == "pyproject.toml":
            value = value.get("tool", {}).get(TOOL)
        if value is not None:
            parsed[normpath(path)] = value
    out = {}
    for folder in {dirname(p) for p in parsed}:
        name = next((join(folder, n) for n in NAMES if join(folder, n) in parsed), None)
        if name:
            out[folder] = settled(inherited(parsed, name), name)
    out.setdefault("", settled({}))
    return out


def suggested(paths: list[str]) -> dict:
    """A starter configuration for a workspace's paths: what to leave out, kinds by place, and a site if one is built from it."""
    has = lambda pattern: any(re.search(pattern, p) for p in paths)
    kinds = [
        ("**/README.md", "readme", r"(^|/)README\.md$"), ("**/CHANGELOG.md", "changelog", r"(^|/)CHANGELOG\.md$"), ("**/AGENTS.md", "agents", r"(^|/)AGENTS\.md$"),
        ("docs/adr/**", "adr", r"^docs/adr/"), ("docs/reference/**", "reference", r"^docs/reference/"), ("docs/guides/**", "howto", r"^docs/guides/"),
        ("docs/plans/**", "plan", r"^docs/plans/"), ("docs/runbooks/**", "runbook", r"^docs/runbooks/"),
    ]
    out: dict = {"kinds": [{"path": g, "kind": k} for g, k, p in kinds if has(p)]}
    out["exclude"] = [g for g, p in (("**/node_modules/**", r"(^|/)node_modules/"), ("**/vendor/**", r"(^|/)vendor/"), ("**/target/**", r"(^|/)target/")) if has(p)]
    if has(r"^(?:mkdocs\.ya?ml|book\.toml|docusaurus\.config\.[jt]s)$") or has(r"^docs/\.vitepress/"):
        out["sites"] = [{"path": "docs/**", "root": "docs"}]
    return out
