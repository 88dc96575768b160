"""The clock and the seeds of a driver program."""

from __future__ import annotations

import random
from datetime import UTC, datetime

import numpy as np


def utc_now() -> datetime:
    return datetime.now(UTC)


def set_seed(seed: int) -> None:
    """Seed Python's and numpy's global generators; plans of this library draw nothing at random."""
    random.seed(seed)
    np.random.seed(seed % (1 << 32))
