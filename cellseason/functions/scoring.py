"""Record scoring and prediction framing: scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DENSITY_BINS, PHASES, POTENTIAL


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def phase_level(sol, trans, greg) -> Column:
    """Phase of a record from its three counts; NULL when any count is missing."""
    sol, trans, greg = _c(sol), _c(trans), _c(greg)
    missing = sol.isNull() | trans.isNull() | greg.isNull()
    return (
        F.when(missing, None)
        .when(sol + trans + greg == 0, "absent")
        .when(greg > 0, "G")
        .when((trans >= sol) & (sol > 0), "T")
        .when(trans > 0, "St")
        .otherwise("S")
    )


def equivalent_density(adults, larvae) -> Column:
    """Adult-equivalent density ``adults + larvae / 9``; a single missing term counts as zero."""
    a, l = _c(adults), _c(larvae)
    return F.when(a.isNotNull() | l.isNotNull(),
                  F.coalesce(a, F.lit(0.0)) + F.coalesce(l, F.lit(0.0)) / F.lit(9.0))


def density_class(density) -> Column:
    """Right-closed class 0..7: the number of bounds strictly below the density."""
    d = _c(density)
    return F.when(d.isNotNull(), sum((F.when(d > b, 1).otherwise(0) for b in DENSITY_BINS), F.lit(0)))


def potential(level, density) -> Column:
    """Six-level potential from the level x density-class matrix (a folded literal, no join)."""
    level = _c(level)
    rows = F.create_map(*[x for name, row in POTENTIAL.items()
                          for x in (F.lit(name), F.array(*[F.lit(v) for v in row]))])
    hit = F.get(F.try_element_at(rows, level), density_class(density))
    return F.when(level == "absent", 0).otherwise(hit)


def score_records(df: DataFrame) -> DataFrame:
    """Adds level, density and potential to survey records."""
    return df.withColumns({
        "niveau_gregarite": phase_level("Sol", "Trans", "Greg"),
        "densite_imago": equivalent_density("DI_dif_moy", "DL_dif_moy"),
    }).withColumn("potentiel_acridien", potential("niveau_gregarite", "densite_imago"))


def presence(severity) -> Column:
    """1 from level 1 on, 0 for observed absence, NULL stays NULL."""
    return (_c(severity) >= 1).cast("int")


def to_ordinal(score) -> Column:
    """Continuous score to severity: half-even rounding, then clipping to 0..3."""
    return F.greatest(F.lit(0), F.least(F.lit(3), F.rint(_c(score)).cast("int")))


def presence_from_probabilities(probabilities, classes) -> Column:
    """Sum of the probabilities of the classes at or above level 1; ``classes`` names the positions."""
    p = _c(probabilities)
    picks = [F.get(p, F.lit(i)) for i, c in enumerate(classes) if c >= 1]
    return sum(picks, F.lit(0.0))


def presence_from_score(score) -> Column:
    """Monotone presence score of a regression, logistic around the absence/presence border."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(_c(score) - F.lit(0.5))))


def argmax_without(probabilities: Column, skip: int, n: int) -> Column:
    """Position of the largest entry other than ``skip``; the first one wins ties."""
    others = [i for i in range(n) if i != skip]
    best = F.greatest(*[F.get(probabilities, F.lit(i)) for i in others])
    pick = None
    for i in others:
        hit = F.get(probabilities, F.lit(i)) == best
        pick = F.when(hit, i) if pick is None else pick.when(hit, i)
    return pick


def thresholded_phase(probabilities, threshold, phases=PHASES, target: str = "G") -> Column:
    """Class index with a lowered bar for the target class, otherwise the best other class."""
    p, g = _c(probabilities), list(phases).index(target)
    return F.when(F.get(p, F.lit(g)) >= threshold, g).otherwise(argmax_without(p, g, len(phases)))


def category_code(c, order) -> Column:
    """Position of a category in a fixed order, NULL for unknown values."""
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), _c(c)).cast("int")
    return F.when(pos > 0, pos - 1)


def draw(key, seed: int = 0) -> Column:
    """Reproducible uniform draw in [0, 1) from an integer key: 52 bits of the digest of key and seed."""
    return digest_draw(_c(key), F.lit(seed))


def digest_draw(key: Column, seed: Column) -> Column:
    text = F.concat(key.cast("bigint").cast("string"), F.lit(":"), seed.cast("bigint").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(4503599627370496.0)
