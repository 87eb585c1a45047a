"""Language models as plain functions: choice by cost with fallback, and counts of what was used."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

#: (prompt, system) -> answer
Model = Callable[[str, str], str]


@dataclass
class Usage:
    """Calls, failures and characters of one model."""

    calls: int = 0
    failed: int = 0
    asked: int = 0
    answered: int = 0


@dataclass
class Router:
    """A model made of several: (name, tier, function), tried from the wanted tier upwards, then downwards.

    A model that raises or answers nothing is passed over; if none answers, the
    answer is empty. ``used`` counts each model's share.
    """

    models: Sequence[tuple[str, int, Model]]
    tier: int = 0
    used: dict[str, Usage] = field(default_factory=dict)

    def order(self) -> list[tuple[str, int, Model]]:
        up = sorted((m for m in self.models if m[1] >= self.tier), key=lambda m: m[1])
        return up + sorted((m for m in self.models if m[1] < self.tier), key=lambda m: -m[1])

    def __call__(self, prompt: str, system: str = "") -> str:
        for name, _, model in self.order():
            use = self.used.setdefault(name, Usage())
            use.calls += 1
            use.asked += len(prompt) + len(system)
            try:
                answer = model(prompt, system)
            except Exception:  # whatever a backend raises, the next one is asked
                use.failed += 1
                continue
            if answer and answer.strip():
                use.answered += len(answer)
                return answer
            use.failed += 1
        return ""

    def totals(self) -> Usage:
        return Usage(*(sum(getattr(u, f) for u in self.used.values()) for f in ("calls", "failed", "asked", "answered")))


def first_model(*candidates: Model | None) -> Model | None:
    """The first model there is, e.g. the host's own before a configured one; None if there is none."""
    return next((m for m in candidates if m is not None), None)
