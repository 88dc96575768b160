"""The standard normal distribution, for single numbers on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist


def quantile(p: float) -> float:
    if not 0 < p < 1:
        raise ValueError("p must be between 0 and 1")
    return NormalDist().inv_cdf(p)


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
