"""Point-in-polygon lookup: the first polygon (in table order) that strictly
contains an incident's (X, Y), or a default name.

Plan: polygons are cut into a uniform grid of cells over their bounding boxes.
Each cell keeps the ordered list of polygons that can contain a point of it,
each with only the edges that matter there, or marked ``full`` when no edge
comes near the cell.  Incidents compute their cell and equi-join the cell
table -- a left join, so every incident is kept and no incident is compared
with polygons far away.  The cell table depends only on the polygons, never on
the incidents; it is broadcast when an upper bound of its size is under a
limit (the grid is coarsened until it is), and otherwise written once and
shuffle-joined on the cell key, where AQE splits hot cells.  No cross join, no
per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bounding_box, contains_point_sql, edges_valid, wkt_edges
from ..schemas import DEFAULT_NEIGHBORHOOD
from ..session import materialize, write_table

DEFAULT_CELL_SIZE = 0.0025          # degrees: about 250 m at city latitudes
DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024
MAX_COORDINATE = 1e6                # beyond, a coordinate is taken for an error
_COARSEN_STEPS = 24                 # cell sizes tried: base * 2^0 .. 2^23
_EDGE_BYTES = 4 * 8 + 16            # four doubles plus struct overhead
_CANDIDATE_BYTES = 96               # ord, name, box and array headers
EDGES_TYPE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def polygon_table(polygons: DataFrame, name: str = "name", wkt: str = "polygon",
                  order: str = "ord", on_error: str = "raise",
                  checkpoint: bool = True) -> DataFrame:
    """``(ord, name, edges, valid, box)`` from ``(name, WKT, ord)`` rows.

    ``on_error="raise"`` fails on a polygon whose WKT gives no usable ring;
    ``"default"`` drops such polygons, so points fall to the default name.
    With ``checkpoint`` the parsed edges (one row per polygon) are written to
    the shared checkpoint folder, so later plans read arrays instead of
    re-planning the parsing expressions at every use.
    """
    if on_error not in ("raise", "default"):
        raise ValueError(f"on_error must be 'raise' or 'default', not {on_error!r}")
    parsed = polygons.select(F.col(order).alias("ord"), F.col(name).alias("name"),
                             wkt_edges(wkt).alias("edges"))
    if checkpoint:
        parsed = materialize(parsed)
    poly = parsed.select("ord", "name", "edges",
                         F.coalesce(edges_valid("edges"), F.lit(False)).alias("valid"),
                         bounding_box("edges").alias("box"))
    if on_error == "default":
        poly = poly.filter("valid")
    return poly


def choose_cell_size(poly: DataFrame, cell_size: float = DEFAULT_CELL_SIZE,
                     max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> tuple[float, bool]:
    """Smallest grid size ``cell_size * 2^k`` whose cell table is estimated under
    ``max_bytes``; returns ``(size, fits)``.  When none fits, the coarsest is
    returned, so the cell table stays as small as it can be.  Also fails on an
    invalid polygon left in the table or one with a coordinate out of range.

    The estimate is an upper bound of what ``polygon_cells`` keeps: one entry
    per (cell, polygon), plus each edge in the cells of the rows it spans (one
    extra row on each side for the margin) from the polygon's left side to
    the edge's right end (one extra column).  Two aggregates over the
    polygons and their edges, one row per candidate size each.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(_COARSEN_STEPS - 1))).alias("k")
    size = F.lit(cell_size) * F.pow(F.lit(2.0), F.col("k"))
    box = F.col("box")

    def span(lo: Column, hi: Column) -> Column:
        return F.floor(hi / size) - F.floor(lo / size) + 1
    if not poly.isEmpty():
        far = poly.filter(F.greatest(*[F.abs(box[c]) for c in ("min_x", "max_x", "min_y", "max_y")])
                          > MAX_COORDINATE).select("name").first()
        if far:
            raise ValueError(f"polygon {far['name']!r} has a coordinate beyond {MAX_COORDINATE}")
    per_poly = (poly.select("name", "valid", "box", k)
                .groupBy("k")
                .agg(F.sum((span(box["min_x"], box["max_x"]) * span(box["min_y"], box["max_y"]))
                           .cast("double") * _CANDIDATE_BYTES).alias("bytes"),
                     F.count(F.when(~F.col("valid"), 1)).alias("n_bad"),
                     F.min(F.when(~F.col("valid"), F.col("name"))).alias("bad"))
                .collect())
    e = F.col("e")
    per_edge = (poly.select("box", F.explode("edges").alias("e")).select("box", "e", k)
                .groupBy("k")
                .agg(F.sum(((span(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])) + 2)
                            * (span(box["min_x"], F.greatest(e["x1"], e["x2"])) + 1))
                           .cast("double") * _EDGE_BYTES).alias("bytes"))
                .collect())
    if not per_poly:
        return cell_size, True      # no polygons: an empty cell table
    if per_poly[0]["n_bad"]:
        raise ValueError(f"polygon {per_poly[0]['bad']!r} has no valid ring")
    edge_bytes = {r["k"]: r["bytes"] or 0.0 for r in per_edge}
    for r in sorted(per_poly, key=lambda r: r["k"]):
        total = (r["bytes"] or 0.0) + edge_bytes.get(r["k"], 0.0)
        if total <= max_bytes:
            return cell_size * (2 ** r["k"]), True
    return cell_size * 2 ** (_COARSEN_STEPS - 1), False


def _edge_touches_rect(e, rx0: Column, ry0: Column, rx1: Column, ry1: Column) -> Column:
    """True when segment ``e`` meets the rectangle (boxes overlap and the
    segment's line does not leave all four corners strictly on one side)."""
    overlap = ((F.greatest(e["x1"], e["x2"]) >= rx0) & (F.least(e["x1"], e["x2"]) <= rx1)
               & (F.greatest(e["y1"], e["y2"]) >= ry0) & (F.least(e["y1"], e["y2"]) <= ry1))

    def side(px: Column, py: Column) -> Column:
        return (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
    corners = [side(rx0, ry0), side(rx1, ry0), side(rx0, ry1), side(rx1, ry1)]
    above = corners[0] > 0
    below = corners[0] < 0
    for c in corners[1:]:
        above, below = above & (c > 0), below & (c < 0)
    return overlap & ~(above | below)


def polygon_cells(poly: DataFrame, cell_size: float) -> DataFrame:
    """``(cx, cy, cands)``: per grid cell, the polygons that can contain a point
    of it, sorted by ``ord``.

    Each candidate keeps only the edges that matter in the cell: a ray cast
    from a point of the cell towards +x can only cross (or the point can only
    lie on) an edge whose y-range meets the cell's row and which reaches the
    cell's left side.  If none of those edges comes within a margin ``eps`` of
    the cell, no boundary passes through it: containment is the same for
    every point of the cell (rounding error is orders of magnitude below
    ``eps``), so it is decided once at the cell centre -- the polygon is then
    kept as ``full`` (no per-point test) or dropped.
    """
    def cell_range(lo: str, hi: str) -> Column:
        box = F.col("box")
        return F.sequence(F.floor(box[lo] / cell_size), F.floor(box[hi] / cell_size))
    eps = cell_size * 1e-6
    cx, cy = F.col("cx"), F.col("cy")
    rx0, rx1 = cx * cell_size - eps, (cx + 1) * cell_size + eps
    ry0, ry1 = cy * cell_size - eps, (cy + 1) * cell_size + eps
    near = F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= ry0)
                    & (F.least(e["y1"], e["y2"]) <= ry1)
                    & (F.greatest(e["x1"], e["x2"]) >= rx0))
    touched = F.exists("edges", lambda e: _edge_touches_rect(e, rx0, ry0, rx1, ry1))
    center_inside = F.expr(contains_point_sql("edges", "__mx", "__my"))
    cells = (poly.select("*", F.explode(cell_range("min_x", "max_x")).alias("cx"))
             .select("*", F.explode(cell_range("min_y", "max_y")).alias("cy"))
             .withColumn("edges", near)
             .withColumns({"__mx": (cx + 0.5) * cell_size, "__my": (cy + 0.5) * cell_size})
             .withColumn("touched", touched)
             .withColumn("full", ~F.col("touched") & center_inside)
             .filter(F.col("touched") | F.col("full"))
             .withColumn("edges", F.when(F.col("full"), F.array().cast(EDGES_TYPE))
                         .otherwise(F.col("edges"))))
    # once a cell lies wholly inside a polygon, later ones cannot be its first hit
    first_full = F.min(F.when(F.col("full"), F.col("ord"))).over(Window.partitionBy("cx", "cy"))
    cells = (cells.withColumn("__first_full", first_full)
             .where(F.col("__first_full").isNull() | (F.col("ord") <= F.col("__first_full"))))
    # a cell's list is bounded by the polygon count, never by the incidents
    return cells.groupBy("cx", "cy").agg(
        F.array_sort(F.collect_list(F.struct("ord", "name", "full", "box", "edges"))).alias("cands"))


def with_neighborhood(df: DataFrame, polygons: DataFrame, x: str = "X", y: str = "Y",
                      out: str = "Neighborhood", default: str = DEFAULT_NEIGHBORHOOD,
                      cell_size: float = DEFAULT_CELL_SIZE,
                      max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
                      on_error: str = "raise", prepared: bool = False) -> DataFrame:
    """Name of the first polygon containing (x, y), else ``default``.

    ``polygons`` has ``(ord, name, polygon)`` (WKT), or is the output of
    ``polygon_table`` when ``prepared``.  Row-preserving: the result has
    exactly the rows of ``df``.
    """
    poly = polygons if prepared else polygon_table(polygons, on_error=on_error)
    size, fits = choose_cell_size(poly, cell_size, max_broadcast_bytes)
    cells = (polygon_cells(poly, size)
             .withColumnRenamed("cx", "__cell_x").withColumnRenamed("cy", "__cell_y"))
    if fits:
        cells = F.broadcast(cells)
    else:
        # too big to broadcast: write it once, so the join shuffles both sides
        # afresh and AQE's skew rule can split a hot cell of the incidents
        cells = write_table(cells, "polygon-cells")
    keyed = df.withColumns({"__px": F.col(x).cast("double"), "__py": F.col(y).cast("double")})
    # a coordinate that is no finite number lies in no cell
    def cell(p: str) -> Column:
        return F.when(F.abs(p) <= MAX_COORDINATE, F.floor(F.col(p) / size))
    keyed = keyed.withColumns({"__cell_x": cell("__px"), "__cell_y": cell("__py")})
    joined = keyed.join(cells, ["__cell_x", "__cell_y"], "left")
    test = contains_point_sql("c.edges", "__px", "__py", "c.box")
    hit = F.expr(f"get(filter(cands, c -> c.full OR {test}), 0).name")
    return (joined.withColumn(out, F.coalesce(hit, F.lit(default)))
            .drop("__cell_x", "__cell_y", "__px", "__py", "cands"))
