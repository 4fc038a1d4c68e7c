"""Run settings and saved searches from JSON texts, with their rules."""

from __future__ import annotations

import json
from datetime import UTC, datetime


def run_config(text: str, supported: tuple[str, ...], sources: tuple[str, ...]) -> dict:
    """A run's settings; raises ValueError for no categories, nameless or repeated or unsupported sources, and undeclared categories."""
    got = json.loads(text)
    categories = got.get("categories") or {}
    if not categories:
        raise ValueError("no categories")
    for name in categories:
        if name not in supported:
            raise ValueError(f"unsupported category: {name}")
    seen: set[str] = set()
    for source in got.get("sources") or []:
        name = (source.get("name") or "").strip()
        if not name:
            raise ValueError("a source has no name")
        if name in seen:
            raise ValueError(f"source named twice: {name}")
        seen.add(name)
        if source.get("type") not in sources:
            raise ValueError(f"unsupported source: {source.get('type')}")
        if source.get("category") and source["category"] not in categories:
            raise ValueError(f"undeclared category: {source['category']}")
    default = got.get("defaultCategory") or ""
    if default and default not in categories:
        raise ValueError(f"undeclared category: {default}")
    return got


def category_of(wanted: str, categories: list[str], default: str = "") -> str:
    """The category a request means: the one it names, else the default, else the only one."""
    if wanted:
        if wanted not in categories:
            raise ValueError(f"unknown category {wanted}: one of {', '.join(sorted(categories))}")
        return wanted
    if default:
        return default
    if len(categories) == 1:
        return categories[0]
    raise ValueError(f"name a category: one of {', '.join(sorted(categories))}")


def watches(text: str) -> list[dict]:
    """Saved searches; a nameless one raises ValueError."""
    out = json.loads(text).get("watches") or []
    for w in out:
        if not (w.get("name") or "").strip():
            raise ValueError("a watch has no name")
    return out


def active(watch: dict, now: datetime) -> bool:
    """Whether a saved search has not run out; moments without a zone are in UTC."""
    until = watch.get("expires_at")
    if not until:
        return True
    until = datetime.fromisoformat(until) if isinstance(until, str) else until
    aware = lambda t: t if t.tzinfo else t.replace(tzinfo=UTC)
    return aware(now) < aware(until)
