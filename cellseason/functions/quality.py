"""Sensor quality masks and scale factors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vegetation_ok(qa) -> Column:
    """Low two quality bits at most 1."""
    return _c(qa).bitwiseAND(3) <= 1


def temperature_ok(qa) -> Column:
    """Low two quality bits equal to 0."""
    return _c(qa).bitwiseAND(3) == 0


def masked(value, ok: Column, scale: float = 1.0) -> Column:
    """Scaled value where the mask holds, NULL elsewhere."""
    return F.when(ok, _c(value) * F.lit(scale))
