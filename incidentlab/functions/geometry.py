"""Planar polygon geometry as native array expressions.

A polygon (``POLYGON`` with holes, or ``MULTIPOLYGON``) is held as the list of
its ring edges ``array<struct<x1,y1,x2,y2>>``.  Containment is the even-odd
rule over all rings (holes and separate parts fall out of the parity), with
points on any edge counted as outside, as a strict "contains" test does.

Each builder returns one SQL expression (higher-order functions with lambda
variables), so a column is parsed once, not rebuilt call by call.  Arguments
are column names or SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: every innermost "( ... )" group of a WKT text is one ring ---
RING_PATTERN = r"\(([^()]+)\)"


def _sql_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _q(c: str) -> str:
    """A bare column name is quoted; anything else is taken as SQL."""
    return f"`{c}`" if c.replace("_", "").isalnum() else c


def wkt_edges_sql(wkt: str) -> str:
    pt = ("named_struct('x', try_cast(get(split(trim(p), {ws}), 0) AS DOUBLE), "
          "'y', try_cast(get(split(trim(p), {ws}), 1) AS DOUBLE))").format(ws=_sql_literal(r"\s+"))
    rings = (f"transform(regexp_extract_all({_q(wkt)}, {_sql_literal(RING_PATTERN)}, 1), "
             f"r -> transform(split(trim(r), {_sql_literal(r'\s*,\s*')}), p -> {pt}))")
    # close an open ring, then pair each point with the next one
    closed = ("array(if(get(ring, 0) = get(ring, size(ring) - 1), ring, "
              "concat(ring, array(get(ring, 0)))))")
    edges = ("transform(sequence(1, greatest(size(c) - 1, 1)), i -> named_struct("
             "'x1', get(c, i - 1).x, 'y1', get(c, i - 1).y, 'x2', get(c, i).x, 'y2', get(c, i).y))")
    return f"flatten(flatten(transform({rings}, ring -> transform({closed}, c -> {edges}))))"


def wkt_edges(wkt: str) -> Column:
    """Edges of every ring of a WKT polygon or multipolygon.

    Open rings are closed.  A coordinate that is not a number becomes null
    (see ``edges_valid``).
    """
    return F.expr(wkt_edges_sql(wkt))


def edges_valid_sql(edges: str) -> str:
    e = _q(edges)
    return (f"(size({e}) >= 3 AND forall({e}, s -> s.x1 IS NOT NULL AND s.y1 IS NOT NULL "
            f"AND s.x2 IS NOT NULL AND s.y2 IS NOT NULL))")


def edges_valid(edges: str) -> Column:
    """True when there are at least three edges and every coordinate is set."""
    return F.expr(edges_valid_sql(edges))


def bounding_box_sql(edges: str) -> str:
    e = _q(edges)
    return ("named_struct("
            f"'min_x', array_min(transform({e}, s -> least(s.x1, s.x2))), "
            f"'min_y', array_min(transform({e}, s -> least(s.y1, s.y2))), "
            f"'max_x', array_max(transform({e}, s -> greatest(s.x1, s.x2))), "
            f"'max_y', array_max(transform({e}, s -> greatest(s.y1, s.y2))))")


def bounding_box(edges: str) -> Column:
    """``struct<min_x,min_y,max_x,max_y>`` of an edge list."""
    return F.expr(bounding_box_sql(edges))


def in_box_sql(box: str, x: str, y: str) -> str:
    b, x, y = _q(box), _q(x), _q(y)
    return f"({x} >= {b}.min_x AND {x} <= {b}.max_x AND {y} >= {b}.min_y AND {y} <= {b}.max_y)"


def on_boundary_sql(edges: str, x: str, y: str) -> str:
    x, y = _q(x), _q(y)
    return (f"exists({_q(edges)}, s -> "
            f"(s.x2 - s.x1) * ({y} - s.y1) - (s.y2 - s.y1) * ({x} - s.x1) = 0 "
            f"AND {x} >= least(s.x1, s.x2) AND {x} <= greatest(s.x1, s.x2) "
            f"AND {y} >= least(s.y1, s.y2) AND {y} <= greatest(s.y1, s.y2))")


def crossing_parity_sql(edges: str, x: str, y: str) -> str:
    x, y = _q(x), _q(y)
    return (f"aggregate({_q(edges)}, false, (acc, s) -> acc != ("
            f"((s.y1 > {y}) != (s.y2 > {y})) "
            f"AND ({x} < (s.x2 - s.x1) * ({y} - s.y1) / (s.y2 - s.y1) + s.x1)))")


def contains_point_sql(edges: str, x: str, y: str, box: str | None = None) -> str:
    inside = f"({crossing_parity_sql(edges, x, y)} AND NOT {on_boundary_sql(edges, x, y)})"
    if box is not None:
        inside = f"({in_box_sql(box, x, y)} AND {inside})"
    return f"coalesce({inside}, false)"


def on_boundary(edges: str, x: str, y: str) -> Column:
    """True when (x, y) lies on one of the edges (collinear and within its box)."""
    return F.expr(on_boundary_sql(edges, x, y))


def crossing_parity(edges: str, x: str, y: str) -> Column:
    """Even-odd ray cast to +x: true when the ray crosses an odd number of edges."""
    return F.expr(crossing_parity_sql(edges, x, y))


def in_box(box: str, x: str, y: str) -> Column:
    return F.expr(in_box_sql(box, x, y))


def contains_point(edges: str, x: str, y: str, box: str | None = None) -> Column:
    """Strict containment of (x, y) in the polygon given by its edges."""
    return F.expr(contains_point_sql(edges, x, y, box))
