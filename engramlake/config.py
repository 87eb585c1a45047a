"""Settings by dotted name, from defaults and a JSON file on top of them."""

from __future__ import annotations

import json
import os
from typing import Any

#: What holds unless a file says otherwise.
DEFAULTS: dict[str, Any] = {
    "search": {"limit": 10, "fts": 20, "like": 10},
    "decay": {"days": 30, "strikes": 3},
    "digest": {"tokens": 250},
    "wander": {"size": 5},
}


def _merged(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = _merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


class Config:
    """Nested settings; a missing or empty file leaves the defaults."""

    def __init__(self, values: dict[str, Any] | None = None):
        self.values = _merged(DEFAULTS, values or {})

    @classmethod
    def load(cls, path: str) -> Config:
        if not os.path.exists(path) or not os.path.getsize(path):
            return cls()
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def get(self, name: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, name: str, value: Any) -> Config:
        """A copy with another value."""
        *path, last = name.split(".")
        over: dict[str, Any] = {last: value}
        for part in reversed(path):
            over = {part: over}
        return Config(_merged(self.values, over))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.values, f, ensure_ascii=False, indent=1)
