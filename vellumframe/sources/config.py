"""Settings: defaults, then a file, then overrides."""

from __future__ import annotations

import copy
import hashlib
import json
from typing import Any

DEFAULTS: dict[str, Any] = {
    "layout": {"zone": 0.085, "window": 12, "repeats": 3},
    "placement": {"policy": "learned"},
    "qa": {"content_coverage_min": 0.97, "page_coverage_warn": 0.9},
    "links": {"author_year": False},
}


def merged(base: dict, over: dict) -> dict:
    """over laid on base, dictionaries within dictionaries; neither changes."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


class Config:
    def __init__(self, data: dict | None = None):
        self.data = merged(DEFAULTS, data or {})

    @classmethod
    def load(cls, path: str | None = None, overrides: dict | None = None) -> Config:
        data = {}
        if path:
            with open(path, encoding="utf-8") as f:
                data = json.load(f)
        return cls(merged(data, overrides or {}))

    def get(self, dotted: str, default: Any = None) -> Any:
        at: Any = self.data
        for part in dotted.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, dotted: str, value: Any) -> None:
        *way, last = dotted.split(".")
        at = self.data
        for part in way:
            at = at.setdefault(part, {})
        at[last] = value

    def fingerprint(self) -> str:
        """Twelve digits that change with any setting."""
        return hashlib.sha1(json.dumps(self.data, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]
