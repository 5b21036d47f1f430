"""Spatial operators on plain coordinate columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CELL_SIZE_M
from ..functions import geo
from .order import running_before, stored

AREA_ATTRIBUTES = ("AIRE_CODE", "SECT_NO", "AIRE_NOM")
#: Edges that a cell of a polygon's cover may hold before it is quartered, and how often it may be.
EDGES_PER_CELL, LEVELS = 256, 16
#: Slack for rounding, in cells: an edge that close to a cell is entered there too, which changes no answer.
SLACK = 1e-6
_EDGE = ("x1", "y1", "x2", "y2")
_EDGE_TYPE = "struct<x1:double,y1:double,x2:double,y2:double>"


def snap_to_grid(df: DataFrame, lon: str = "LNG_DD", lat: str = "LAT_DD", size: float = CELL_SIZE_M) -> DataFrame:
    """Adds the metric cell of each point; the projection stays inside generated code."""
    x, y = geo.utm_xy(lon, lat)
    return (df.withColumns({"cell_col": geo.cell_index(x, size), "cell_row": geo.cell_index(y, size)})
            .withColumn("cell_id", geo.cell_id("cell_col", "cell_row")))


def rings_to_edges(areas: DataFrame, ring: str = "ring", metric: bool = False, poly: str = "poly_id") -> DataFrame:
    """One row per polygon edge ``(poly_id, attributes, x1, y1, x2, y2)`` from rings of ``{lon, lat}``, level ones too.

    Holes and further parts are further rows with the same ``poly_id``: parity counts them right."""
    keep = [poly, *[a for a in AREA_ATTRIBUTES if a in areas.columns]]
    pt = F.col(ring)
    nxt = lambda i: F.get(pt, F.pmod(i + 1, F.size(pt)))
    pairs = F.transform(pt, lambda p, i: F.struct(
        p["lon"].alias("x1"), p["lat"].alias("y1"), nxt(i)["lon"].alias("x2"), nxt(i)["lat"].alias("y2")))
    edges = areas.select(*keep, F.explode(pairs).alias("e")).select(*keep, "e.*")
    if metric:
        x1, y1 = geo.utm_xy("x1", "y1")
        x2, y2 = geo.utm_xy("x2", "y2")
        edges = edges.select(*keep, x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return edges


def _cut(y):
    """Abscissa of the edge (x1, y1, x2, y2) at height ``y``, kept between its ends; of a level edge one of its ends."""
    x1, y1, x2, y2 = (F.col(c) for c in _EDGE)
    at = x1 + (y - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0))
    return F.least(F.greatest(at, F.least(x1, x2)), F.greatest(x1, x2))


def _beyond(y, left):
    """Whether the crossing of the edge with the upright line at ``left`` lies below ``y``, for edges that cross it."""
    right = F.when(F.col("x1") > F.col("x2"), F.col("y1")).otherwise(F.col("y2"))  # height of the end on the right
    return (right <= y) != (_spans(y) & (_cut(y) > left))


def _spans(y):
    return (F.col("y1") <= y) != (F.col("y2") <= y)


def _straddles(left):
    return (F.col("x1") <= left) != (F.col("x2") <= left)


def _flips(x, y, left, low):
    """Whether the edge parts the point (x, y) from the corner (left, low) of its cell: on the way along the left side and then to the right.

    Both halves of the way use the same abscissa at height ``y``, so they agree to the last bit and the parity is that of
    a ray to the right over all edges, however the cells are cut."""
    along_side = _straddles(left) & (_beyond(y, left) != _beyond(low, left))
    return along_side != (_spans(y) & (_cut(y) > left) & (_cut(y) <= x))


def _touched(size: float, row):
    """First and last column of ``size`` that the edge touches in a row of cells, with a little slack for rounding."""
    y1, y2 = F.col("y1"), F.col("y2")
    lowest, highest = F.least("y1", "y2"), F.greatest("y1", "y2")
    a = F.when(y1 == y2, F.col("x1")).otherwise(_cut(F.greatest(lowest, row * F.lit(size))))
    b = F.when(y1 == y2, F.col("x2")).otherwise(_cut(F.least(highest, (row + 1) * F.lit(size))))
    return F.floor(F.least(a, b) / size - SLACK), F.floor(F.greatest(a, b) / size + SLACK)


def _base_cells(edges: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Cells of ``size`` between the first and the last touched one of each row, with the parity ``odd`` of their lower left corner, and
    the edges by the cells that they touch."""
    rows = F.sequence(F.floor(F.least("y1", "y2") / size - SLACK), F.floor(F.greatest("y1", "y2") / size + SLACK))
    first, last = _touched(size, F.col("row"))
    pieces = (edges.withColumn("row", F.explode(rows)).withColumn("col", F.explode(F.sequence(first, last)))
              .select("shape", "row", "col", *_EDGE))
    # a cut of the row's lower side lies right of the corners of all cells up to ``col``
    low = F.col("row") * F.lit(size)
    near = F.ceil(F.col("at") / size) - 1
    exact = near + F.when((near + 1) * F.lit(size) < F.col("at"), 1).when(near * F.lit(size) >= F.col("at"), -1).otherwise(0)
    cuts = (edges.filter("y1 <> y2").withColumn("row", F.explode(rows)).filter(_spans(low)).withColumn("at", _cut(low))
            .select("shape", "row", exact.alias("col"), F.lit(1).alias("cuts")))
    width = pieces.groupBy("shape", "row").agg(F.min("col").alias("first"), F.max("col").alias("last"))
    cells = width.select("shape", "row", F.explode(F.sequence("first", "last")).alias("col"), F.lit(0).alias("cuts"))
    to_right = Window.partitionBy("shape", "row").orderBy(F.desc("col"))
    return (cells.union(cuts).groupBy("shape", "row", "col").agg(F.sum("cuts").alias("cuts"), F.min("cuts").alias("cell"))
            .withColumn("odd", F.sum("cuts").over(to_right) % 2 == 1).filter("cell = 0").select("shape", "row", "col", "odd"), pieces)


def _quarter(cells: DataFrame, pieces: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """The four quarters of each cell, which are of ``size``, and the edges by the quarters that they touch."""
    rows = F.array(F.col("row") * 2, F.col("row") * 2 + 1)
    columns = F.array(F.col("col") * 2, F.col("col") * 2 + 1)
    parts = (pieces.join(cells, ["shape", "row", "col"])
             .withColumns({"left": F.col("col") * F.lit(2 * size), "low": F.col("row") * F.lit(2 * size), "col": F.explode(columns), "rows": rows})
             .withColumn("row", F.explode("rows")))
    first, last = _touched(size, F.col("row"))
    touches = ((F.least("y1", "y2") / size - SLACK < F.col("row") + 1) & (F.greatest("y1", "y2") / size + SLACK >= F.col("row"))
               & F.col("col").between(first, last))
    flips = _flips(F.col("col") * F.lit(size), F.col("row") * F.lit(size), F.col("left"), F.col("low"))
    keys = ["shape", "row", "col"]
    quarters = parts.groupBy(*keys).agg((F.first("odd") != (F.count_if(flips) % 2 == 1)).alias("odd"))
    return quarters, parts.filter(touches).select(*keys, *_EDGE)


def _cover(edges: DataFrame, size: float, poly: str, most: int, levels: int) -> tuple[DataFrame, int]:
    """``tile_cover`` and its deepest level."""
    keys = ["shape", "row", "col"]
    edges = edges.select(F.struct(poly, *[a for a in AREA_ATTRIBUTES if a in edges.columns]).alias("shape"), *_EDGE)
    cells, pieces = _base_cells(edges, size)
    found, level = [], 0

    def entries(cells: DataFrame, pieces: DataFrame) -> DataFrame:
        return cells.select(F.lit(level).alias("level"), *keys, "odd", F.lit(None).cast(_EDGE_TYPE).alias("edge")).union(
            pieces.select(F.lit(level), *keys, F.lit(None).cast("boolean"), F.struct(*_EDGE)))

    # a shape of few edges has no full cell
    few = edges.groupBy("shape").count().filter(F.col("count") > most).isEmpty()
    while not few and level < levels:
        full = pieces.groupBy(*keys).count().filter(F.col("count") > most).select(*keys)
        if full.isEmpty():
            break
        full, cells, pieces = stored(full), stored(cells), stored(pieces)
        found.append(entries(cells.join(full, keys, "left_anti"), pieces.join(full, keys, "left_anti")))
        level += 1
        cells, pieces = _quarter(cells.join(full, keys, "left_semi"), pieces.join(full, keys, "left_semi"), size / 2**level)
    found.append(entries(cells, pieces))
    left, low = (F.col(c) * F.lit(size) / F.pow(F.lit(2.0), F.col("level")) for c in ("col", "row"))
    entry = lambda c: F.when(F.col("x1").isNotNull() & (F.greatest("x1", "x2") > left), c)  # edges left of the cell part nothing
    # (right end at or below y) for each edge with ends right of the side; what two edges share is no change
    tops = F.sort_array(F.flatten(F.collect_list(entry(F.array(F.when(F.col("x1") > left, F.col("y1")), F.when(F.col("x2") > left, F.col("y2")))))))
    once = lambda seen, v: F.when(F.try_element_at(seen, F.lit(-1)) == v, F.slice(seen, 1, F.size(seen) - 1)).otherwise(F.concat(seen, F.array(v)))
    cover = (reduce(DataFrame.union, found).select("level", *keys, "odd", "edge.*").groupBy("level", *keys)
             .agg((F.max("odd") != (F.count_if(_straddles(left) & _beyond(low, left)) % 2 == 1)).alias("odd"),
                  tops.alias("tops"), F.collect_list(entry(F.struct(*_EDGE))).alias("edges"))
             .withColumn("tops", F.aggregate(F.filter("tops", lambda v: v.isNotNull()), F.array().cast("array<double>"), once)))
    return cover.filter(F.col("odd") | (F.size("edges") > 0)), level


def tile_cover(edges: DataFrame, size: float, poly: str = "poly_id", most: int = EDGES_PER_CELL, levels: int = LEVELS) -> DataFrame:
    """Quadtree cells over polygons: (shape, level, row, col, odd, tops, edges); ``shape`` holds ``poly`` and the attributes.

    A cell of level k measures ``size / 2**k``. It holds the edges that touch it, and a point in it needs no others: the point lies inside
    if ``odd``, the number of ``tops`` at or below it and the number of ``edges`` that a ray to the right meets are odd together.
    ``tops`` are the heights at which edges, or runs of them, end right of the cell's left side. Cells with more than ``most`` edges are quartered, at most ``levels`` times (edges that
    meet in one vertex cannot be told apart by cells); inner cells have no edges, outer ones are left out. Level edges of
    the rings are needed as well. Each level of cells is one job over those that are still too full."""
    return _cover(edges, size, poly, most, levels)[0]


#: Members of a class of equal areas that one row of a match meets; larger classes are dealt into parts.
MEMBERS = 256
#: Rows that one task of the join gives, about.
MATCHES = 20_000_000


def equal_areas(edges: DataFrame, poly: str = "poly_id") -> tuple[DataFrame, DataFrame]:
    """Areas with the same edges as one class: ``(edges of the classes, members)``.

    The edges are ``(rep, parts, x1, y1, x2, y2)``: ``rep`` numbers the class by the hashes of its edges, in any order (count and two exact
    sums of 64-bit hashes). Members are ``(rep, part, shape)``, where a class has ``parts`` of about ``MEMBERS`` each."""
    shape = F.struct(poly, *[a for a in AREA_ATTRIBUTES if a in edges.columns])
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *_EDGE).cast("decimal(20,0)"))
    shapes = edges.groupBy(shape.alias("shape")).agg(F.struct(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")).alias("rep"))
    classes = shapes.groupBy("rep").agg(F.min("shape").alias("shape"), F.ceil(F.count("*") / F.lit(MEMBERS)).cast("int").alias("parts"))
    first = edges.select(shape.alias("shape"), *_EDGE).join(classes, "shape").select("rep", "parts", *_EDGE)
    members = shapes.join(classes.select("rep", "parts"), "rep").select("rep", F.pmod(F.xxhash64("shape"), F.col("parts")).cast("int").alias("part"), "shape")
    return first, members


def _in_classes(points: DataFrame, edges: DataFrame, x: str, y: str, height: float, most: int) -> DataFrame:
    """``(point, rep, parts)`` for each point and class of equal areas that contains it."""
    edges = edges.select(F.struct("rep", "parts").alias("of"), *_EDGE)
    cover, deepest = _cover(edges, height, "of", most, LEVELS)
    side = F.lit(float(height)) / F.pow(F.lit(2.0), F.col("level"))
    level = F.explode(F.sequence(F.lit(0), F.lit(deepest))) if deepest else F.lit(0)
    placed = (points.select(F.struct("*").alias("point"), F.col(x).alias("px"), F.col(y).alias("py"), level.alias("level"))
              .withColumns({"row": F.floor(F.col("py") / side), "col": F.floor(F.col("px") / side)}))
    py = F.col("py")
    right_of = lambda e: ((e["y1"] <= py) != (e["y2"] <= py)) & (F.col("px") < e["x1"] + (py - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]))
    parity = F.size(F.filter("tops", lambda v: v <= py)) + F.size(F.filter("edges", right_of))
    inside = placed.join(cover, ["level", "row", "col"]).filter(F.col("odd") != (parity % 2 == 1))
    return inside.select("point", F.col("shape.of.rep").alias("rep"), F.col("shape.of.parts").alias("parts"))


def within_areas(points: DataFrame, edges: DataFrame, x: str, y: str, height: float, poly: str = "poly_id", most: int = EDGES_PER_CELL) -> DataFrame:
    """Strict point-in-polygon join, one output row per containing polygon.

    Polygons are covered by quadtree cells (``tile_cover``, from tiles of ``height`` on) of at most ``most`` edges, so rows of the area
    side stay small however detailed a ring is. A point meets the cells that it lies in by an equi-join, once for each level of
    the cover, and the parity of the cell's edges is folded inside the row: no pair table is built. Edges are half-open in y; points within rounding of an edge fall on either side.

    Areas with equal edges are judged once (``equal_areas``), then a match meets the members of its class part by part. The matches are
    stored and dealt over as many tasks as their rows need: those grow as points times overlapping areas, a task gives about ``MATCHES``."""
    first, members = equal_areas(edges, poly)
    matches = stored(_in_classes(points, first, x, y, height, most))
    sizes = members.groupBy("rep").agg(F.count("*").alias("m"))
    counts = matches.groupBy("rep").agg(F.count("*").alias("n")).join(sizes, "rep").agg(F.sum(F.col("n") * F.col("m")).alias("t"), F.max("n").alias("n")).first()
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, 1 + (counts["t"] or 0) // MATCHES)
    salt = F.pmod(F.xxhash64("point"), F.lit(1 + (counts["n"] or 0) * MEMBERS // MATCHES))  # parts with very many points go to several tasks
    dealt = matches.select("point", "rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).repartition(tasks, "rep", "part", salt)
    return dealt.join(members, ["rep", "part"]).select("point.*", "shape.*")


def count_within(points: DataFrame, edges: DataFrame, x: str, y: str, height: float, poly: str = "poly_id", most: int = EDGES_PER_CELL) -> DataFrame:
    """``(poly, n_points)`` of the areas that contain points: the rows of ``within_areas`` counted, without expanding equal areas."""
    first, members = equal_areas(edges, poly)
    found = _in_classes(points, first, x, y, height, most).groupBy("rep").agg(F.count("*").alias("n"))
    return members.join(found, "rep").groupBy(F.col(f"shape.{poly}").alias(poly)).agg(F.sum("n").alias("n_points"))


def clip_to_areas(points: DataFrame, areas: DataFrame, lon: str = "LNG_DD", lat: str = "LAT_DD", height: float = 0.25) -> DataFrame:
    """Points strictly inside an area, with its attributes; overlapping areas keep every match."""
    return within_areas(points, rings_to_edges(areas), lon, lat, height).drop("poly_id")


def build_grid(areas: DataFrame, size: float = CELL_SIZE_M) -> DataFrame:
    """Cells whose centre lies inside an area; overlaps go to the lowest ``poly_id``.

    Candidate cells come from each polygon's own crossings, row by row: a grid row is cut by the edges
    at sorted abscissas and cells between the odd and even cuts are inside. Work is proportional to the
    grid produced, not to bounding box times edges."""
    edges = rings_to_edges(areas, metric=True)
    attrs = [a for a in AREA_ATTRIBUTES if a in edges.columns]
    y_lo, y_hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    # rows whose centre y lies in [y_lo, y_hi): first = ceil(y_lo/size - .5), last = ceil(y_hi/size - .5) - 1
    first, last = F.ceil(y_lo / size - 0.5), F.ceil(y_hi / size - 0.5) - 1
    cuts = (edges.filter(first <= last)
            .withColumn("cell_row", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
            .withColumn("cy", geo.cell_centre("cell_row", size))
            .withColumn("cut", F.expr("x1 + (cy - y1) * (x2 - x1) / (y2 - y1)"))
            .groupBy("poly_id", *attrs, "cell_row").agg(F.sort_array(F.collect_list("cut")).alias("cuts")))
    spans = cuts.select("poly_id", *attrs, "cell_row", F.explode(F.transform(
        F.sequence(F.lit(0), F.shiftright(F.size("cuts"), 1) - 1),
        lambda i: F.struct(F.get("cuts", (i * 2).cast("int")).alias("a"), F.get("cuts", (i * 2 + 1).cast("int")).alias("b")))).alias("s"))
    c0, c1 = F.floor(F.col("s.a") / size - 0.5) + 1, F.ceil(F.col("s.b") / size - 0.5) - 1
    cells = (spans.filter(c0 <= c1)
             .select("poly_id", *attrs, "cell_row", F.explode(F.sequence(c0.cast("int"), c1.cast("int"))).alias("cell_col")))
    best = cells.groupBy("cell_col", "cell_row").agg(
        F.min_by(F.struct("poly_id", *attrs), "poly_id").alias("a"))
    return best.select(geo.cell_id("cell_col", "cell_row").alias("cell_id"), "cell_col", "cell_row",
                       *[F.col(f"a.{c}").alias(c) for c in attrs])


def with_corners(grid: DataFrame, size: float = CELL_SIZE_M) -> DataFrame:
    return grid.withColumns({**geo.cell_corners("cell_col", "cell_row", size),
                             "geometry": geo.cell_polygon("cell_col", "cell_row", size)})


def with_centroid(grid: DataFrame, size: float = CELL_SIZE_M) -> DataFrame:
    lon, lat = geo.lon_lat(geo.cell_centre("cell_col", size), geo.cell_centre("cell_row", size))
    return grid.withColumns({"lon": lon, "lat": lat})


def bounds(df: DataFrame, x_min: str, y_min: str, x_max: str, y_max: str) -> DataFrame:
    return df.agg(F.min(x_min).alias("min_x"), F.min(y_min).alias("min_y"),
                  F.max(x_max).alias("max_x"), F.max(y_max).alias("max_y"))


def pixel_of_centre(grid: DataFrame, scale: float, size: float = CELL_SIZE_M) -> DataFrame:
    """Pixel indices of a raster of resolution ``scale`` under each cell centre."""
    return grid.withColumns({"px_col": geo.cell_index(geo.cell_centre("cell_col", size), scale),
                             "px_row": geo.cell_index(geo.cell_centre("cell_row", size), scale)})


def sample_raster(grid: DataFrame, raster: DataFrame, scale: float, size: float = CELL_SIZE_M) -> DataFrame:
    """Nearest-pixel sampling: an equi-join on the pixel under the cell centre; cells off the raster drop out."""
    return (pixel_of_centre(grid, scale, size).join(raster, ["px_col", "px_row"])
            .drop("px_col", "px_row"))


# --- selection and tiling --------------------------------------------------------------------------

def select_cells(grid: DataFrame, mode: str = "observed", wanted: DataFrame | None = None) -> DataFrame:
    """``all`` keeps the grid; ``observed`` and ``file`` keep the cells listed in ``wanted``."""
    if mode == "all":
        return grid
    if mode not in ("observed", "file"):
        raise ValueError(f"unknown selection mode {mode!r} (observed | all | file)")
    if wanted is None:
        raise ValueError(f"mode {mode!r} needs a table of wanted cells")
    return grid.join(wanted.select("cell_id").distinct(), "cell_id", "left_semi")


def cells_outside(grid: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("cell_id").distinct().join(grid, "cell_id", "left_anti")


def with_tile(grid: DataFrame, per_tile: int) -> DataFrame:
    """Tile number of each cell in (row, column) order, ``per_tile`` cells each.

    Ranks are built from the counts of the rows above plus the rank inside the row, so the grid is
    never sorted in one task. ``(cell_row, cell_col)`` must be unique."""
    counts = grid.groupBy("cell_row").agg(F.count("*").alias("n"))
    above = running_before(counts, "cell_row", ["n"]).select("cell_row", "n_before")
    w = Window.partitionBy("cell_row").orderBy("cell_col")
    return (grid.withColumn("__r", F.row_number().over(w) - 1).join(above, "cell_row")
            .withColumn("tile", F.floor((F.col("n_before") + F.col("__r")) / per_tile).cast("int"))
            .select(*grid.columns, "tile"))
