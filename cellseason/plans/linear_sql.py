"""SQL of penalised least squares: sums of products, then Gauss-Jordan steps over lists, for the oracles."""

from __future__ import annotations

import math

RIDGE = "1e0 / n"


def fits_sql(rows: str, width: int, penalty: str) -> str:
    """``(g, a, b)``: intercept and slopes of each group of ``rows`` (g, w, x, y). ``penalty`` may use n, var (of the column) and var_y."""
    k = width + 1
    return f"""(WITH RECURSIVE lin AS MATERIALIZED ({rows}),
z AS (SELECT g, w, list_concat([1e0], x, [CAST(y AS DOUBLE)]) AS z FROM lin),
mom AS MATERIALIZED (SELECT g, i, j, sum(w * z[i] * z[j]) AS s FROM z, unnest(range(1, {width + 3})) a(i), unnest(range(1, {width + 3})) b(j) GROUP BY 1, 2, 3),
cov AS (SELECT m.g, m.i, m.j, n.s AS n, m.s / n.s - a.s * b.s / (n.s * n.s) AS v FROM mom m JOIN mom n ON n.g = m.g AND n.i = 1 AND n.j = 1
  JOIN mom a ON a.g = m.g AND a.i = 1 AND a.j = m.i JOIN mom b ON b.g = m.g AND b.i = 1 AND b.j = m.j WHERE m.i > 1 AND m.j > 1),
own AS (SELECT c.*, d.v AS var, y.v AS var_y FROM cov c JOIN cov d ON d.g = c.g AND d.i = c.i AND d.j = c.i JOIN cov y ON y.g = c.g AND y.i = {width + 2} AND y.j = {width + 2} WHERE c.i < {width + 2}),
line AS (SELECT g, i, list(v + CASE WHEN i = j THEN {penalty} ELSE 0 END ORDER BY j) AS r FROM own GROUP BY 1, 2),
sys AS (SELECT g, list(r ORDER BY i) AS m FROM line GROUP BY 1),
gj AS (SELECT g, 0 AS k, m FROM sys UNION ALL SELECT g, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / m[k + 1][k + 1])
  ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM gj WHERE k < {width}),
slope AS (SELECT g, list_transform(m, lambda r: r[{k}]) AS b FROM gj WHERE k = {width}),
mean AS (SELECT m.g, list(m.s / n.s ORDER BY m.j) AS mean FROM mom m JOIN mom n ON n.g = m.g AND n.i = 1 AND n.j = 1 WHERE m.i = 1 AND m.j > 1 GROUP BY 1)
SELECT slope.g, mean[{k}] - list_dot_product(mean[:{width}], b) AS a, b FROM slope JOIN mean USING (g))"""


def panel_columns(day: str, knots=(2.0, 4.0), order: int = 4, period: float = 300.0) -> str:
    """Trend and season terms of a day number, as a list."""
    t = f"CAST({day} AS DOUBLE) / {period!r}e0"
    waves = [f"{f}({2 * math.pi * h / period!r}e0 * {day})" for h in range(1, order + 1) for f in ("sin", "cos")]
    return "[" + ", ".join([t, *(f"greatest(0e0, {t} - {k!r}e0)" for k in knots), *waves]) + "]"
