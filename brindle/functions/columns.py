"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a naive time, read in the session's zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    """Whole-second boundaries from a to b."""
    return F.unix_seconds(b.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))


def days_between(a: Column, b: Column) -> Column:
    return seconds_between(a, b) / F.lit(86400.0)


def unit_hash(*parts: Column) -> Column:
    """Uniform in [0, 1): the first 64 bits of SHA-256 of the parts joined by ``:``, modulo 10^12, over 10^12."""
    head = F.conv(F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 1, 16), 16, 10)
    return F.pmod(head.cast("decimal(20,0)"), F.lit(10**12).cast("decimal(20,0)")).cast("double") / F.lit(1e12)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def two_sided_p(z: Column) -> Column:
    """Probability of a standard normal value at least as far from 0, to 1.5e-7 (Abramowitz and Stegun, 7.1.26)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    # Fixed values of the published approximation.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)
