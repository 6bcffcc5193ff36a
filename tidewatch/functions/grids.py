"""Threshold grids: point i is ``start + i * step`` and the last point is ``stop``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Grid:
    start: float
    stop: float
    points: int

    @property
    def step(self) -> float:
        return (self.stop - self.start) / (self.points - 1)

    def values(self) -> list[float]:
        inner = [self.start + i * self.step for i in range(self.points - 1)]
        return inner + [self.stop]


# The sweeps in use, as (start, stop, number of points).
GRIDS = {
    "thousandths": Grid(0.0, 1.0, 1001),
    "fivehundredths": Grid(0.0, 1.0, 501),
    "percent": Grid(0.01, 0.99, 99),
    "tenth_to_nine_tenths": Grid(0.1, 0.9, 81),
    "middle": Grid(0.3, 0.7, 41),
}
FIXED_THRESHOLDS = [0.0, 0.01, 0.1, 0.3, 0.5, 0.7]
