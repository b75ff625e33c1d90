"""A job of ordered steps: a step that fails stops it, one with nothing to do is skipped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


class Skip(Exception):
    """Raised by a step that has nothing to do."""


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[dict], str]
    default: bool = True
    scope: frozenset[str] = frozenset({"company", "universe"})


@dataclass
class Report:
    events: list[tuple[str, str, str]] = field(default_factory=list)  # step, status, detail

    @property
    def ok(self) -> bool:
        return all(status != "FAILED" for _, status, _ in self.events)


def select(steps: list[Step], scope: str, only: list[str] | None = None, skip: list[str] | None = None) -> list[Step]:
    """Steps of a scope in their registered order; ``only`` names them, or the defaults without ``skip`` are taken."""
    unknown = {*(only or []), *(skip or [])} - {s.name for s in steps}
    if unknown:
        raise ValueError(f"no such step: {sorted(unknown)}")
    chosen = [s for s in steps if (s.name in only if only else s.default) and s.name not in (skip or [])]
    return [s for s in chosen if scope in s.scope]


def execute(steps: list[Step], context: dict, cancelled: Callable[[], bool] = lambda: False) -> Report:
    report = Report()
    for k, step in enumerate(steps):
        if cancelled():
            report.events += [(s.name, "CANCELLED", "") for s in steps[k:]]
            break
        try:
            report.events.append((step.name, "DONE", step.run(context)))
        except Skip as reason:
            report.events.append((step.name, "SKIPPED", str(reason)))
        except Exception as error:
            report.events.append((step.name, "FAILED", repr(error)))
            report.events += [(s.name, "NOT_RUN", "") for s in steps[k + 1 :]]
            break
    return report
