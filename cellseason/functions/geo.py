"""Metric grid: transverse Mercator projection and cell arithmetic as pure column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CELL_SIZE_M

# fixed values: WGS 84 ellipsoid and UTM zone 38 South
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
CENTRAL_MERIDIAN, SCALE, FALSE_EAST, FALSE_NORTH = 45.0, 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECC = 2 * math.sqrt(_N) / (1 + _N)
# third-order Krueger series
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utm_xy(lon, lat) -> tuple[Column, Column]:
    """Longitude/latitude in degrees to easting/northing in metres."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - CENTRAL_MERIDIAN)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(ECC) * F.atanh(F.lit(ECC) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = F.lit(SCALE * RADIUS)
    return F.lit(FALSE_EAST) + k * east, F.lit(FALSE_NORTH) + k * north


def lon_lat(x, y) -> tuple[Column, Column]:
    """Easting/northing back to degrees."""
    xi = (_c(y) - FALSE_NORTH) / F.lit(SCALE * RADIUS)
    eta = (_c(x) - FALSE_EAST) / F.lit(SCALE * RADIUS)
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, 1):
        xi1 = xi1 - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    return F.lit(CENTRAL_MERIDIAN) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)


def cell_index(coord, size: float = CELL_SIZE_M) -> Column:
    return F.floor(_c(coord) / F.lit(float(size))).cast("int")


def cell_id(col, row) -> Column:
    return F.concat_ws("_", _c(col).cast("string"), _c(row).cast("string"))


def cell_centre(index, size: float = CELL_SIZE_M) -> Column:
    return (_c(index) + F.lit(0.5)) * F.lit(float(size))


def cell_corners(col, row, size: float = CELL_SIZE_M) -> dict[str, Column]:
    col, row, s = _c(col), _c(row), F.lit(float(size))
    return {"x_min": col * s, "y_min": row * s, "x_max": (col + 1) * s, "y_max": (row + 1) * s}


def cell_polygon(col, row, size: float = CELL_SIZE_M) -> Column:
    """GeoJSON text of a cell box in grid metres, closed ring, integer coordinates."""
    k = {n: c.cast("bigint") for n, c in cell_corners(col, row, size).items()}
    corner = ((k["x_max"], k["y_min"]), (k["x_max"], k["y_max"]), (k["x_min"], k["y_max"]),
              (k["x_min"], k["y_min"]), (k["x_max"], k["y_min"]))
    ring = F.concat_ws(",", *[F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))
                              for x, y in corner])
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}"))
