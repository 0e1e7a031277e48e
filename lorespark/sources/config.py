"""Routing rules and settings from files and the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from lorespark.operators.retrieval import ROUTES, RULES


def load_rules(path: str | None = None, root: str | None = None) -> tuple[tuple, str]:
    """Rules by priority, and the default route: of the file given, else of config/routing_rules.yaml under the root, else the built-in ones."""
    import yaml

    at = path or (f"{root}/config/routing_rules.yaml" if root and Path(f"{root}/config/routing_rules.yaml").exists() else None)
    if at is None:
        return RULES, "vector"
    data = yaml.safe_load(Path(at).read_text(encoding="utf-8"))
    rules = []
    for r in data.get("rules", ()):
        words = {k: tuple(r.get("keywords", {}).get(k, ())) for k in ("zh", "en")}
        if r["target_route"] not in ROUTES or r.get("secondary") not in (None, *ROUTES):
            raise ValueError(f"rule {r['id']}: unknown route")
        if not any(words.values()) or not all(w.strip() for ws in words.values() for w in ws):
            raise ValueError(f"rule {r['id']}: no keywords")
        rules.append((r["id"], int(r["priority"]), r["target_route"], r.get("secondary"), words["zh"], words["en"]))
    if len({r[1] for r in rules}) < len(rules):
        raise ValueError("two rules have the same priority")
    if data.get("default_route", "vector") not in ROUTES:
        raise ValueError("unknown default route")
    return tuple(sorted(rules, key=lambda r: r[1])), data.get("default_route", "vector")


def _plain(value: Any) -> str:
    if isinstance(value, bool):
        return "1" if value else "0"
    return "+".join(map(_plain, value)) if isinstance(value, list) else str(value)


def setting(name: str, path: tuple[str, ...], env: Mapping[str, str] | None = None, env_file: str | None = None, file: str | None = None) -> str | None:
    """A setting: the environment's, else that of a file of NAME=value lines, else that at a path in a YAML or JSON file."""
    env = os.environ if env is None else env
    if env.get(name):
        return env[name]
    if env_file and Path(env_file).exists():
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            key, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and not key.startswith("#") and key.strip() == name:
                return value.strip().strip("\"'")
    if file and Path(file).exists():
        text = Path(file).read_text(encoding="utf-8")
        if file.endswith(".json"):
            data = json.loads(text)
        else:
            import yaml

            data = yaml.safe_load(text)
        for key in path:
            data = data.get(key) if isinstance(data, dict) else None
        return None if data is None else _plain(data)
    return None


def bounded(value: str | None, default: int, least: int, most: int) -> int:
    """A whole number between bounds, or the default where none is given."""
    if value is None:
        return default
    n = int(value)
    if not least <= n <= most:
        raise ValueError(f"{n} is not between {least} and {most}")
    return n
