"""Settings from the command line and from files of variables, and the paths that follow from them."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from lodestone.functions.text import project_slug


def read_variables(text: str) -> dict[str, str]:
    """NAME=value lines of a text; comments and other lines are passed over, one pair of outer quotes is taken off."""
    out = {}
    for line in text.splitlines():
        name, sep, value = line.strip().removeprefix("export ").partition("=")
        if sep and not name.startswith("#") and re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
            out[name.strip()] = re.sub(r"^([\"'])(.*)\1$", r"\2", value.strip())
    return out


def resolve(name: str, *sources: Mapping[str, str]) -> str | None:
    """The value of the first source that has one that isn't empty."""
    return next((s[name] for s in sources if s.get(name)), None)


@dataclass
class Arguments:
    root: str = ""
    watch: bool = True
    exclude: list[str] = field(default_factory=list)
    pool_size: int | None = None
    extras: dict[str, str] = field(default_factory=dict)


def parse_arguments(argv: Sequence[str]) -> Arguments:
    """--path DIR, --watch, --no-watch, --exclude A,B (repeatable), --pool-size N (ignored unless positive), and any other
    `--name value` as an extra. The last of repeated ones counts."""
    out, rest = Arguments(), list(argv)
    while rest:
        name = rest.pop(0)
        if name in ("--watch", "--no-watch"):
            out.watch = name == "--watch"
        elif name.startswith("--") and rest and (name in ("--path", "--exclude", "--pool-size") or not rest[0].startswith("--")):
            value = rest.pop(0)
            if name == "--path":
                out.root = os.path.abspath(value)
            elif name == "--exclude":
                out.exclude += [p.strip() for p in value.split(",") if p.strip()]
            elif name == "--pool-size":
                out.pool_size = int(value) if value.isdigit() and int(value) > 0 else out.pool_size
            else:
                out.extras[name] = value
    return out


def find_up(start: str, marker: str, levels: int = 5) -> str | None:
    """The nearest of `start` and the folders above it, `levels` in all, that holds a file named marker."""
    at = os.path.abspath(start)
    for _ in range(levels):
        if os.path.exists(os.path.join(at, marker)):
            return at
        at = os.path.dirname(at)
    return None


def index_folder(base: str, root: str) -> str:
    """Where a project's index lies below base: a folder named by the project."""
    return f"{base.rstrip('/')}/data/{project_slug(root)}"


def within(root: str, path: str) -> bool:
    """Whether a path, taken from root unless it is absolute, is root or lies below it once '..' is resolved."""
    root = os.path.normpath(root)
    full = os.path.normpath(os.path.join(root, path))
    return full == root or full.startswith(root.rstrip("/") + "/")


# Providers of models, the variable with their key (none for a local one), and that with their model's name.
PROVIDERS = {"gemini": ("GEMINI_API_KEY", "GEMINI_MODEL"), "ollama": (None, "OLLAMA_MODEL"), "openai": ("OPENAI_API_KEY", "OPENAI_MODEL")}
PROVIDER_VARIABLE = "PROMPT_ENHANCER_PROVIDER"


def provider(variables: Mapping[str, str], override: str | None = None) -> str | None:
    """The provider that is asked for, by override or variable, if it is known and its key is there."""
    name = (override or variables.get(PROVIDER_VARIABLE) or "").strip().lower()
    if name not in PROVIDERS:
        return None
    key, _ = PROVIDERS[name]
    return name if key is None or variables.get(key) else None


def model_name(variables: Mapping[str, str], name: str, default: str | None = None) -> str | None:
    return variables.get(PROVIDERS[name][1]) or default if name in PROVIDERS else None


def refine(raw: str, composed: str, call: Callable[[str], str] | None, valid: Callable[[str, str], bool], context: Callable[[str], str | None] | None = None) -> str:
    """What a model makes of a composed text; the composed text itself if there is no model, or it fails, or its answer isn't
    valid. A context that can't be had is left out."""
    if call is None:
        return composed
    try:
        found = context(raw) if context else None
    except Exception:  # noqa: BLE001 - whatever goes wrong there, the text stands without it
        found = None
    parts = [f"Raw request:\n{raw}", *([found] if found else []), f"Composed text to improve:\n{composed}"]
    try:
        answer = call("\n\n".join(parts))
    except Exception:  # noqa: BLE001 - a model that fails leaves the composed text
        return composed
    return answer if valid(composed, answer) else composed
