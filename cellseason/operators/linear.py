"""Linear models from sums of products that are kept by season.

One aggregation gives, for each season (and level), the sums of all products of ``z = (1, predictors, target)``. They add up: a fold is
the sum of its seasons, so an expanding window solves one small system for each fold and scans the rows once for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fit:
    """Intercept and slopes; ``of`` gives the value for predictors as columns or as one array column."""

    intercept: float
    coefficients: DenseVector

    def of(self, x: Column) -> Column:
        beta = F.array(*[F.lit(float(b)) for b in self.coefficients])
        return F.lit(float(self.intercept)) + F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def moments(df: DataFrame, x: Column, width: int, y: Column, keys: list[str] = ()) -> DataFrame:
    """``keys``, ``line`` and ``m``: the sums of the products z_i * z_j of z = (1, the ``width`` entries of ``x``, y), one line i of the matrix in a row.

    Partial sums are made where the rows are; what is exchanged is one row a key, line and task. The sums of all products at once are
    too many for generated code. A product with a NULL adds nothing; no rows give no row."""
    at = lambda i: F.get("__z", i)
    rows = (df.select(*keys, F.concat(F.array(F.lit(1.0)), x, F.array(y.cast("double"))).alias("__z"))
            .select(*keys, "__z", F.explode(F.sequence(F.lit(0), F.lit(width + 1))).alias("line")).withColumn("__v", at(F.col("line"))))
    return rows.groupBy(*keys, "line").agg(F.array(*[F.sum(F.col("__v") * at(F.lit(j))) for j in range(width + 2)]).alias("m"))


def matrices(lines: DataFrame, keys: list[str], width: int, most: int | None = None) -> dict[tuple, np.ndarray]:
    """The symmetric matrix of each key, from lines as ``moments`` gives them; more than ``most`` keys are an error."""
    out: dict[tuple, np.ndarray] = {}
    for r in (lines if most is None else lines.limit(most * (width + 2) + 1)).collect():
        m = out.setdefault(tuple(r[k] for k in keys), np.zeros((width + 2, width + 2)))
        m[r["line"], r["line"]:] = [0.0 if v is None else v for v in r["m"][r["line"]:]]
    if most is not None and len(out) > most:
        raise ValueError(f"more than {most} groups of sums")
    return {k: m + np.triu(m, 1).T for k, m in out.items()}


def solve(m: np.ndarray, penalty) -> Fit:
    """Least squares with ``penalty(variances, variance of y, weight)`` on the diagonal, intercept free. ``m`` is a weighted sum of matrices."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    a, b = cov[:-1, :-1], cov[:-1, -1]
    beta = np.linalg.solve(a + np.diag(penalty(np.diag(a), cov[-1, -1], n)), b)
    return Fit(float(mean[-1] - mean[:-1] @ beta), DenseVector(beta))


def ridge_of_levels(levels: dict[int, np.ndarray], alpha: float) -> Fit:
    """Ridge with the class weights of these rows: rows over (levels times rows of the level)."""
    rows = sum(m[0, 0] for m in levels.values())
    total = sum(m * (rows / (len(levels) * m[0, 0])) for m in levels.values())
    return solve(total, lambda var, var_y, n: np.full(len(var), alpha / n))


def expanding(seasons: dict[str, dict], folds: list[tuple[list[str], str]]):
    """``(test season, sums of the training seasons by level)`` of each fold. Folds whose training seasons contain those of the fold
    before add only the new ones."""
    have, total = set(), {}
    for train, test in folds:
        if not have <= set(train):
            have, total = set(), {}
        for season in sorted(set(train) - have):
            for level, m in seasons.get(season, {}).items():
                total[level] = total[level] + m if level in total else m
        have = set(train)
        yield test, dict(total)


def by_season(table: DataFrame, season: str, level: str | None, width: int) -> dict[str, dict]:
    """Sums as matrices; the table has the lines of one matrix a season and level, both short lists."""
    out: dict[str, dict] = {}
    for key, m in matrices(table, [season, level] if level else [season], width).items():
        out.setdefault(key[0], {})[key[1] if level else 0] = m
    return out
