"""Settings: defaults, reading, and the rules that only need the settings themselves."""

from __future__ import annotations

import json
import os
import warnings
from dataclasses import dataclass, field
from typing import Any

from waymark.functions import literals

#: File names under which settings are sought, in this order, here and in up to twelve parent directories.
NAMES = ("waymark.config.ts", "waymark.config.mts", "waymark.config.js", "waymark.config.mjs", "waymark.config.json", ".waymark.json")
PRESETS = {
    "minimal": ["index-freshness"],
    "standard": ["index-freshness", "human-guide-links"],
    "strict": ["index-freshness", "human-guide-links", "okf-type", "docs-style"],
    "playbook": ["index-freshness", "okf-type"],
}
#: Known names without an implementation; naming them is a warning.
RESERVED = frozenset({"link-rot", "routing-currency", "bootstrap-size"})
STYLE_RULES = ("title", "purpose", "audience", "task-orientation", "examples", "owner-source", "no-stale-wording")
STYLE_PROFILES = {
    "google-dev-docs": ["title", "purpose", "audience", "task-orientation", "examples", "no-stale-wording"],
    "playbook-okf": ["title", "purpose", "owner-source", "no-stale-wording"],
    "playbook-okf-soft": ["title", "no-stale-wording"],
    "title-only": ["title"],
}


@dataclass(frozen=True)
class Settings:
    project: str | None = None
    agent_root: str = "docs/for-agents"
    agent_index: str | None = None
    include: list[str] = field(default_factory=lambda: ["**/*.{md,mdx}"])
    exclude: list[str] = field(default_factory=lambda: ["**/node_modules/**", "**/.git/**"])
    require_type: bool | None = None
    allowed_types: list[str] | None = None
    human: list[dict[str, Any]] = field(default_factory=list)
    out_file: str = "index.json"
    llms: dict[str, Any] = field(default_factory=dict)
    ownership: dict[str, dict[str, Any]] = field(default_factory=dict)
    ownership_from_corpus: bool = True
    intents: list[dict[str, Any]] = field(default_factory=list)
    changes: list[dict[str, Any]] = field(default_factory=list)
    preset: str = "minimal"
    gates_include: list[str] = field(default_factory=list)
    gates_exclude: list[str] = field(default_factory=list)
    style: dict[str, Any] | None = None
    tool: str = "waymark"

    @property
    def index_doc(self) -> str:
        return self.agent_index or f"{self.agent_root}/INDEX.md"

    @property
    def strict(self) -> bool:
        return self.preset != "minimal"

    @property
    def type_required(self) -> bool:
        return self.require_type if self.require_type is not None else self.preset == "strict"


def parse(data: dict[str, Any]) -> Settings:
    """Settings of a parsed document; unknown keys are an error, a single human source counts as a list of one."""
    known = set(Settings.__dataclass_fields__)
    if extra := sorted(set(data) - known):
        raise ValueError(f"unknown settings: {', '.join(extra)}")
    human = data.get("human")
    data = data | ({"human": [human]} if isinstance(human, dict) else {})
    if data.get("preset", "minimal") not in PRESETS:
        raise ValueError(f"unknown preset: {data['preset']}")
    return Settings(**data)


def find(start: str) -> str | None:
    at = os.path.abspath(start)
    for _ in range(13):
        for name in NAMES:
            if os.path.isfile(path := os.path.join(at, name)):
                return path
        at = os.path.dirname(at)
    return None


def load(start: str) -> tuple[Settings, str]:
    """Settings and their directory. JSON, or a script that exports a literal; no code is run."""
    path = find(start)
    if path is None:
        raise FileNotFoundError(f"no settings at or above {start}")
    with open(path, encoding="utf-8") as f:
        data = json.load(f) if path.endswith(".json") else literals.read(f.read())
    if not isinstance(data, dict):
        raise ValueError("settings must be an object")
    return parse(data), os.path.dirname(path)


def gate_ids(settings: Settings) -> list[str]:
    """The preset's gates, then the included, less the excluded; reserved names are left out."""
    out = list(PRESETS[settings.preset])
    for name in settings.gates_include:
        if name in RESERVED:
            warnings.warn(f"gate {name!r} is reserved and does nothing", stacklevel=2)
        elif name not in out:
            out.append(name)
    return [x for x in out if x not in settings.gates_exclude]


def style_rules(settings: Settings) -> tuple[str, list[str]]:
    """Profile and required rules of the style gate."""
    if settings.style is None:
        profile = "playbook-okf-soft" if settings.preset == "playbook" else "playbook-okf"
        return profile, STYLE_PROFILES[profile]
    profile = settings.style.get("profile")
    if profile == "custom":
        return profile, [r for r in settings.style.get("required", []) if r in STYLE_RULES]
    profile = profile if profile in STYLE_PROFILES else "playbook-okf"
    return profile, STYLE_PROFILES[profile]


def contained(root: str, path: str) -> str | None:
    """The real path below root, or null if it leaves it."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    return full if full == base or full.startswith(base + os.sep) else None
