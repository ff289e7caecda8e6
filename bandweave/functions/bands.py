"""Gaussian bands over [-1, 1]: levels, representatives, and the two ways to digitise."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DEVIATION = 0.25


@dataclass(frozen=True)
class Bands:
    """2r + 1 levels from -1 to 1 and the representative of each of the 2r bands between them."""

    levels: tuple[float, ...]
    labels: tuple[float, ...]

    def left_closed(self, x: Column) -> Column:
        """The band b with levels[b] <= x < levels[b + 1]; 1 falls into the last band."""
        below = sum((F.when(x >= level, 1).otherwise(0) for level in self.levels[1:-1]), F.lit(0))
        return F.when(x.isNotNull(), below)

    def right_closed(self, x: Column) -> Column:
        """The band b with levels[b] < x <= levels[b + 1]; -1 falls into the first band."""
        below = sum((F.when(x > level, 1).otherwise(0) for level in self.levels[1:-1]), F.lit(0))
        return F.when(x.isNotNull(), below)

    def label(self, band: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in self.labels]), band + 1)


def _equal_edges(r: int) -> list[float]:
    return [i / r - 1 for i in range(2 * r + 1)]


def _bands(widths: list[float], digits: int | None) -> Bands:
    levels, at = [-1.0], -1.0
    for w in widths:
        at += w
        levels.append(at)
    levels[-1] = 1.0
    middle = [(a + b) / 2 for a, b in zip(levels, levels[1:])]
    return Bands(tuple(levels), tuple(middle if digits is None else [round(x, digits) for x in middle]))


def cumulative_bands(r: int) -> Bands:
    """Widths are twice the Gaussian's mass between equally spaced edges. They sum to a little less than 2; the last level is 1."""
    mass = lambda x: 0.5 * (1 + math.erf(x / (DEVIATION * math.sqrt(2))))
    edges = _equal_edges(r)
    return _bands([2 * (mass(b) - mass(a)) for a, b in zip(edges, edges[1:])], None)


def sampled_bands(r: int, points: int = 2000) -> Bands:
    """Widths are twice each edge interval's share of the density at equally spaced points; representatives have 4 decimals."""
    xs = [-1 + 2 * i / (points - 1) for i in range(points)]
    density = [math.exp(-0.5 * (x / DEVIATION) ** 2) for x in xs]
    edges, total = _equal_edges(r), sum(density)
    return _bands([2 * sum(d for x, d in zip(xs, density) if a <= x < b) / total for a, b in zip(edges, edges[1:])], 4)
