"""Curriculum configuration: strict keys, validated stages, forks of branches. All of configuration size."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass, field

POLICIES = ("repeat", "reduce_share", "defer")


class ConfigError(ValueError):
    """A configuration says what it may not."""


@dataclass(frozen=True)
class Stage:
    stage: str
    token_start: int
    token_end: int
    sequence_length: int
    mixture: dict[str, float]
    protected_floors: dict[str, float] = field(default_factory=dict)
    warmup_tokens: int = 0
    scarcity_policy: str = "repeat"


@dataclass(frozen=True)
class Curriculum:
    stages: tuple[Stage, ...]
    global_batch_size: int = 8
    seed: str = "0"


def strict(kind: type, values: dict):
    """An instance of a dataclass; unknown keys and missing ones raise."""
    names = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - names):
        raise ConfigError(f"{kind.__name__} has no {', '.join(unknown)}")
    try:
        return kind(**values)
    except TypeError as error:
        raise ConfigError(str(error)) from None


def curriculum(values: dict) -> Curriculum:
    """A validated curriculum of plain values (as a YAML file gives them)."""
    stages = tuple(strict(Stage, s) for s in values.get("stages", ()))
    made = strict(Curriculum, values | {"stages": stages})
    validate(made.stages)
    return made


def load(path: str) -> Curriculum:
    import yaml

    with open(path) as file:
        return curriculum(yaml.safe_load(file) or {})


def validate(stages: tuple[Stage, ...], tolerance: float = 1e-6) -> None:
    """Stages aren't empty, have a span, follow each other without gaps, and their shares and floors add up."""
    if not stages:
        raise ConfigError("a curriculum needs a stage")
    for k, s in enumerate(stages):
        if s.token_end <= s.token_start:
            raise ConfigError(f"stage {s.stage} has no tokens")
        if k and s.token_start != stages[k - 1].token_end:
            raise ConfigError(f"stage {s.stage} doesn't follow {stages[k - 1].stage}")
        if s.scarcity_policy not in POLICIES:
            raise ConfigError(f"stage {s.stage}: no policy {s.scarcity_policy}")
        if abs(sum(s.mixture.values()) - 1) > tolerance:
            raise ConfigError(f"stage {s.stage}: shares sum to {sum(s.mixture.values())}")
        for lane, floor in s.protected_floors.items():
            if lane not in s.mixture or floor > s.mixture[lane] + tolerance:
                raise ConfigError(f"stage {s.stage}: the floor of {lane} exceeds its share")
        if sum(s.protected_floors.values()) > 1 + tolerance:
            raise ConfigError(f"stage {s.stage}: floors exceed the stage")


def report(stages: tuple[Stage, ...]) -> str:
    """The schedule as lines of text."""
    lines = []
    for s in stages:
        shares = ", ".join(f"{lane} {w:.1%}" for lane, w in sorted(s.mixture.items()))
        lines.append(f"{s.stage}: tokens {s.token_start}-{s.token_end}, length {s.sequence_length}: {shares}")
    return "\n".join(lines)


@dataclass(frozen=True)
class Branch:
    run_id: str
    branch_id: str
    parent: str | None = None
    fork_step: int | None = None


def fork(branches: list[Branch], parent: str, new: str, step: int) -> Branch:
    """A new branch from a parent's step; its id must be new and the parent known."""
    by_id = {b.branch_id: b for b in branches}
    if parent not in by_id:
        raise ConfigError(f"no branch {parent}")
    if new in by_id:
        raise ConfigError(f"branch {new} exists")
    return Branch(by_id[parent].run_id, new, parent, step)


def bisect(low: float, high: float, holds: Callable[[float], bool], iterations: int = 25, whole: bool = False) -> float:
    """The least value between ``low`` and ``high`` at which a monotone condition holds."""
    if whole:
        low, high = int(low), int(high)
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if holds(middle) else (middle + 1, high)
        return high
    for _ in range(iterations):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def one_step(steps: list[int]) -> int:
    """The one step of a batch's parts."""
    if len(set(steps)) != 1:
        raise ConfigError(f"parts of {len(set(steps))} steps")
    return steps[0]
