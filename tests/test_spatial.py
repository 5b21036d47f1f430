import math
import random

import numpy as np
from pyspark.sql import functions as F

from cellseason.functions import geo
from cellseason.operators import spatial
from cellseason.operators.order import stored

from .conftest import rows

BASE = (44.166666666666664, -24.95)


def square(x, y, h, code, poly):
    pts = [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]
    return (poly, code, code, f"area {code}", [{"lon": a, "lat": b} for a, b in pts])


AREAS = "poly_id bigint, AIRE_CODE int, SECT_NO int, AIRE_NOM string, ring array<struct<lon:double,lat:double>>"


def test_projection_and_snap(spark):
    pts = spark.createDataFrame([(0, *BASE), (1, BASE[0] + 0.001, BASE[1]), (2, BASE[0] + 0.015, BASE[1])], "id int, LNG_DD double, LAT_DD double")
    x, y = geo.utm_xy("LNG_DD", "LAT_DD")
    r = pts.filter("id = 0").select(F.round(x, 2), F.round(y, 2)).first()
    assert abs(r[0] - 415872.65) < 0.02 and abs(r[1] - 7240330.58) < 0.02
    got = rows(spatial.snap_to_grid(pts).select("id", "cell_col", "cell_id"), "id")
    assert got[0] == (0, 415, "415_7240") and got[1][1] == 415 and got[2][1] == 417


def test_clip_is_strict_and_attaches_attributes(spark):
    pts = spark.createDataFrame([(0, *BASE), (1, BASE[0] + 1, BASE[1]), (2, BASE[0], BASE[1] + 0.06)], "id int, LNG_DD double, LAT_DD double")
    areas = spark.createDataFrame([square(*BASE, 0.05, 3, 1)], AREAS)
    assert rows(spatial.clip_to_areas(pts, areas).select("id", "AIRE_CODE", "AIRE_NOM")) == [(0, 3, "area 3")]


def test_overlaps_keep_every_match_for_points_and_the_lowest_for_cells(spark):
    areas = spark.createDataFrame([square(*BASE, 0.05, 1, 7), square(*BASE, 0.03, 2, 2)], AREAS)
    pts = spark.createDataFrame([(0, *BASE)], "id int, LNG_DD double, LAT_DD double")
    assert sorted(r[0] for r in rows(spatial.clip_to_areas(pts, areas).select("AIRE_CODE"))) == [1, 2]
    g = spatial.build_grid(areas)
    assert g.count() == g.select("cell_id").distinct().count()
    assert g.filter("cell_id = '415_7240'").first()["AIRE_CODE"] == 2


def test_grid_covers_disjoint_areas_and_snaps_back(spark):
    areas = spark.createDataFrame([square(BASE[0] + i, BASE[1], 0.05, i + 1, i) for i in range(4)], AREAS)
    g = spatial.with_centroid(spatial.build_grid(areas))
    assert g.select("AIRE_CODE").distinct().count() == 4 and 350 < g.count() < 600
    x, y = geo.utm_xy("lon", "lat")
    assert g.filter((geo.cell_index(x) != F.col("cell_col")) | (geo.cell_index(y) != F.col("cell_row"))).isEmpty()


def test_irregular_ring_with_hole_against_brute_force(spark):
    rnd = random.Random(5)
    ring = [(0, 0), (6, 1), (4, 3), (7, 6), (2, 5), (3, 2.5), (-1, 4)]
    hole = [(1, 0.6), (2, 0.8), (1.4, 1.4)]
    pts = [(i, rnd.uniform(-2, 8), rnd.uniform(-1, 7)) for i in range(1500)]

    def crossings(px, py, poly):
        n = 0
        for (x1, y1), (x2, y2) in zip(poly, poly[1:] + poly[:1]):
            if (y1 <= py) != (y2 <= py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
                n += 1
        return n

    want = sorted(i for i, x, y in pts if (crossings(x, y, ring) + crossings(x, y, hole)) % 2)
    data = [(1, 1, 1, "a", [{"lon": float(a), "lat": float(b)} for a, b in r]) for r in (ring, hole)]
    got = spatial.within_areas(spark.createDataFrame(pts, "id int, x double, y double"),
                               spatial.rings_to_edges(spark.createDataFrame(data, AREAS)), "x", "y", 0.7)
    assert sorted(r[0] for r in rows(got.select("id"))) == want and len(want) > 100


def _wavy(n, rnd):
    """A ring of ``n`` vertices around (0.31, 0.27) with bays; every 40th stretch is level, and many vertices are close together."""
    ring = []
    for i in range(n):
        a = 2 * math.pi * (i / n) ** 2
        r = 0.8 + 0.3 * math.sin(9 * a) + rnd.uniform(0, 0.002)
        ring.append((0.31 + r * math.cos(a), ring[-1][1] if i % 40 == 1 else 0.27 + r * math.sin(a)))
    return ring


def _inside(points, ring):
    """Ids of the points inside, by a ray to the right over all edges."""
    x1, y1 = np.array(ring).T
    x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
    flat = y1 == y2
    return [i for i, x, y in points if (((y1 <= y) != (y2 <= y)) & ~flat & (x < x1 + (y - y1) * (x2 - x1) / np.where(flat, 1, y2 - y1))).sum() % 2]


def test_cover_of_a_detailed_ring_holds_few_edges_a_cell_and_gives_the_same_answers(spark):
    rnd = random.Random(7)
    ring = _wavy(100_000, rnd)
    areas = spark.createDataFrame([(1, 1, 1, "a", [{"lon": a, "lat": b} for a, b in ring])], AREAS)
    edges = spatial.rings_to_edges(areas)
    cover = stored(spatial.tile_cover(edges, 0.5, most=1000))
    fullest, deepest, inner = cover.select(F.max(F.size("edges")), F.max("level"), F.count_if(F.size("edges") == 0)).first()
    assert fullest <= 1000 and deepest >= 2 and inner > 0
    points = [(i, rnd.uniform(-1, 1.6), rnd.uniform(-1, 1.6)) for i in range(1500)]
    points += [(len(points) + k, x + rnd.uniform(-1e-4, 1e-4), y + rnd.uniform(-1e-4, 1e-4)) for k, (x, y) in enumerate(rnd.sample(ring, 500))]
    got = spatial.within_areas(spark.createDataFrame(points, "id int, x double, y double"), edges, "x", "y", 0.5, most=1000)
    assert sorted(r[0] for r in rows(got.select("id"))) == _inside(points, ring)


def test_cover_on_vertices_sides_and_corners_of_cells(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (2.0, 0.5), (2.0, 0.0), (3.0, 0.0), (3.0, 2.0), (2.0, 1.0), (1.0, 2.0), (0.0, 2.0), (0.0, 1.0), (0.5, 1.0), (0.5, 0.5), (0.0, 0.5)]
    areas = spark.createDataFrame([(1, None, 1, "a", [{"lon": a, "lat": b} for a, b in ring])], AREAS)
    points = [(i, x / 8, y / 8) for i, (x, y) in enumerate((x, y) for x in range(-2, 28) for y in range(-2, 20))]
    table = spark.createDataFrame(points, "row int, level double, y double")  # names of the cover's own columns
    for most in (256, 3):
        got = spatial.within_areas(table, spatial.rings_to_edges(areas), "level", "y", 0.5, most=most)
        assert sorted(r[0] for r in rows(got.select("row"))) == _inside(points, ring)
        assert got.columns == ["row", "level", "y", "poly_id", "AIRE_CODE", "SECT_NO", "AIRE_NOM"]
    empty = spatial.within_areas(table, spatial.rings_to_edges(areas.limit(0)), "level", "y", 0.5)
    assert empty.isEmpty()


def test_equal_areas_are_judged_once_and_keep_every_match(spark):
    pts = spark.createDataFrame([(i, BASE[0] + i / 100, BASE[1]) for i in range(-10, 11)], "id int, LNG_DD double, LAT_DD double")
    data = [square(*BASE, 0.055, 1 + k % 3, k) for k in range(600)] + [square(BASE[0] + 0.05, BASE[1], 0.025, 9, 600)]
    data[5] = (5, 2, 2, "turned", data[5][4][2:] + data[5][4][:2])  # the same edges from another vertex on
    edges = spatial.rings_to_edges(spark.createDataFrame(data, AREAS))
    first, members = spatial.equal_areas(edges)
    assert first.count() == 8 and members.count() == 601 and members.select("rep", "part").distinct().count() == 4
    got = rows(spatial.within_areas(pts, edges, "LNG_DD", "LAT_DD", 0.25).select("id", "poly_id", "AIRE_CODE"))
    want = [(i, k, 2 if k == 5 else 1 + k % 3) for i in range(-5, 6) for k in range(600)] + [(i, 600, 9) for i in range(3, 8)]
    assert sorted(got) == sorted(want)
    counts = dict(rows(spatial.count_within(pts, edges, "LNG_DD", "LAT_DD", 0.25)))
    assert counts == {**{k: 11 for k in range(600)}, 600: 5}


def test_selection_tiles_and_boxes(spark):
    g = spark.createDataFrame([(f"10_{r}", 10, r, "A") for r in (23, 20, 22, 21)], "cell_id string, cell_col int, cell_row int, AIRE_CODE string")
    lab = spark.createDataFrame([("10_23",), ("10_20",), ("99_99",), ("10_20",)], "cell_id string")
    assert sorted(r[0] for r in rows(spatial.select_cells(g, "observed", lab).select("cell_id"))) == ["10_20", "10_23"]
    assert rows(spatial.cells_outside(g, lab)) == [("99_99",)]
    assert spatial.select_cells(g, "all").count() == 4
    for mode in ("observed", "other"):
        try:
            spatial.select_cells(g, mode)
            raise AssertionError("accepted")
        except ValueError:
            pass
    assert rows(spatial.with_tile(g, 3).select("cell_row", "tile"), "cell_row") == [(20, 0), (21, 0), (22, 0), (23, 1)]
    box = spatial.with_corners(g).filter("cell_row = 20").first()
    assert (box["x_min"], box["y_max"]) == (10000.0, 21000.0) and box["geometry"].startswith('{"type":"Polygon","coordinates":[[[11000,20000]')
