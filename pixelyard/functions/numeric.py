"""Grids and sums whose rounding matters."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np

from pixelyard.errors import InvalidConfig

#: Added to a precision's denominator: 2 ** -52.
EPS = 2.220446049250313e-16


def linspace(start: float, stop: float, n: int) -> tuple[float, ...]:
    """``start + i * step``, with the last value exactly ``stop``."""
    if n == 1:
        return (start,)
    step = (stop - start) / (n - 1)
    return (*(start + i * step for i in range(n - 1)), stop)


IOU_LADDER = linspace(0.5, 0.95, 10)
RECALL_LADDER = linspace(0.0, 1.0, 101)


def ladder(values: Iterable[float], name: str = "thresholds") -> tuple[float, ...]:
    """The values, if they are finite, within [0, 1] and strictly ascending."""
    out = tuple(float(v) for v in values)
    if not out:
        raise InvalidConfig(f"{name} are empty")
    if not all(math.isfinite(v) and 0.0 <= v <= 1.0 for v in out):
        raise InvalidConfig(f"{name} must be finite and within [0, 1]")
    if any(a >= b for a, b in zip(out, out[1:])):
        raise InvalidConfig(f"{name} must ascend strictly")
    return out


def pairwise_mean(values: Sequence[float]) -> float:
    """The mean with numpy's pairwise summation over a contiguous array, in the given order."""
    array = np.ascontiguousarray(values, dtype=np.float64)
    return float(np.sum(array) / len(array)) if len(array) else -1.0


def wilson(hits: float, n: int, z: float = 1.959963984540054) -> tuple[float, float]:
    """The Wilson score interval of a share."""
    if n == 0:
        return 0.0, 1.0
    p, d = hits / n, 1.0 + z * z / n
    centre = p + z * z / (2 * n)
    margin = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return max(0.0, (centre - margin) / d), min(1.0, (centre + margin) / d)
