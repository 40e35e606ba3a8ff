"""Settings of the analytics pipelines."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PairConfig:
    positive_tokens: tuple[str, ...] = ("inf", "1", "true", "yes", "r")
    known_tokens: tuple[str, ...] = ("inf", "noinf", "1", "0", "true", "false", "yes", "no", "r", "a", "n")
    studies: tuple[str, ...] | None = None
    min_positive: int = 3
    min_negative: int = 3


@dataclass(frozen=True)
class SimulationConfig:
    mutation_rate: float = 1e-7
    resistance_cost: float = 0.05
    burst: float = 50.0
    adsorption: float = 1e-9
    horizon: float = 96.0
    dt: float = 0.5

    @property
    def n_steps(self) -> int:
        return int(round(self.horizon / self.dt)) + 1
