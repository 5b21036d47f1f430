"""Ordinal labels per cell x campaign x decade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LABEL_KEYS, PHASE_COUNTERS
from ..functions.scoring import presence


def record_severity() -> Column:
    """Highest phase present in a record: 0 when counters are observed and none is positive, NULL when
    no counter is observed."""
    names = [c for pair in PHASE_COUNTERS.values() for c in pair]
    seen = F.coalesce(*[F.col(c) for c in names]).isNotNull()
    expr = None
    for level, pair in PHASE_COUNTERS.items():
        hit = (F.col(pair[0]) > 0) | (F.col(pair[1]) > 0)
        expr = F.when(hit, level) if expr is None else expr.when(hit, level)
    return expr.when(seen, 0)


def severity() -> Column:
    """The maximum over records is the phase of the group; records without counters do not count."""
    return F.max(record_severity())


def intensity(density: str = "densite_imago") -> Column:
    return F.log1p(F.avg(density))


def aggregate_labels(df: DataFrame, keys=LABEL_KEYS) -> DataFrame:
    """One hash aggregate with map-side combine; rows without a full key are left out."""
    out = df.dropna(subset=list(keys)).groupBy(*keys).agg(
        severity().alias("severite"), intensity().alias("intensite"),
        F.count("*").alias("effort_prospection"))
    return out.withColumn("binaire", presence("severite"))
