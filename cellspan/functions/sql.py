"""Functions for SQL users: temporary SQL functions, which Spark inlines into the plan, so that no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

_RING = "ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
_NEXT = "element_at(ring, 1 + i % size(ring))"  # the corner after the i-th, the first one after the last
#: name: (parameters, result, body)
FUNCTIONS = {
    "in_box_closed": ("x DOUBLE, y DOUBLE, xmin DOUBLE, xmax DOUBLE, ymin DOUBLE, ymax DOUBLE", "BOOLEAN", "x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax"),
    "in_box_halfopen": ("x DOUBLE, y DOUBLE, xmin DOUBLE, xmax DOUBLE, ymin DOUBLE, ymax DOUBLE", "BOOLEAN", "x >= xmin AND x < xmax AND y >= ymin AND y < ymax"),
    "pixel_of": ("v DOUBLE, origin DOUBLE, pixel DOUBLE", "INT", "CAST(rint((v - origin) / pixel) AS INT)"),
    "is_assigned": ("id STRING", "BOOLEAN", "coalesce(lower(trim(id)) NOT IN ('', '0', 'cell_0', 'unassigned', 'none', 'nan'), false)"),
    "vector_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", (
        "aggregate(zip_with(a, b, (p, q) -> p * q), 0D, (s, v) -> s + v)"
        " / greatest(1e-12D, sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)))")),
    "ring_area": (_RING, "DOUBLE", f"abs(aggregate(sequence(1, size(ring)), 0D, (s, i) -> s + element_at(ring, i).x * {_NEXT}.y - {_NEXT}.x * element_at(ring, i).y)) / 2"),
    "point_in_ring": (f"px DOUBLE, py DOUBLE, {_RING}", "BOOLEAN", (
        f"size(filter(sequence(1, size(ring)), i -> (element_at(ring, i).y > py) != ({_NEXT}.y > py)"
        f" AND px < (CASE WHEN {_NEXT}.y = element_at(ring, i).y THEN 0D ELSE ({_NEXT}.x - element_at(ring, i).x) * (py - element_at(ring, i).y) / ({_NEXT}.y - element_at(ring, i).y) END) + element_at(ring, i).x)) % 2 = 1")),
}
#: Table functions: name: (parameters, columns, query)
TABLE_FUNCTIONS = {
    "tile_grid": ("xmin DOUBLE, xmax DOUBLE, ymin DOUBLE, ymax DOUBLE, side DOUBLE, step DOUBLE", "tile_idx BIGINT, tx BIGINT, ty BIGINT, x0 DOUBLE, y0 DOUBLE", (
        "SELECT ty * nx + tx, tx, ty, xmin + tx * step, ymin + ty * step"
        " FROM (SELECT greatest(1, ceil((xmax - xmin - side) / step) + 1) AS nx, greatest(1, ceil((ymax - ymin - side) / step) + 1) AS ny),"
        " LATERAL explode(sequence(0L, CAST(nx - 1 AS BIGINT))) a(tx), LATERAL explode(sequence(0L, CAST(ny - 1 AS BIGINT))) b(ty)")),
    "ring_edges": (_RING, "ord INT, x DOUBLE, y DOUBLE, nx DOUBLE, ny DOUBLE", (
        f"SELECT i, element_at(ring, i).x, element_at(ring, i).y, {_NEXT}.x, {_NEXT}.y FROM explode(sequence(1, size(ring))) e(i)")),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes the functions known to the session under prefix + name; returns their names.

    They are temporary functions of this session: a second call replaces them, another session does not see them.  Nulls give null, but for
    ``is_assigned``; a ring without corners has area 0 and holds no point.
    """
    for name, (params, result, body) in FUNCTIONS.items():
        if "ring ARRAY" in params:  # sequence(1, 0) would count down
            body = f"CASE WHEN size(ring) > 0 THEN {body} WHEN ring IS NOT NULL THEN {'0D' if result == 'DOUBLE' else 'false'} END"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({params}) RETURNS {result} RETURN {body}")
    for name, (params, columns, query) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({params}) RETURNS TABLE({columns}) RETURN {query}")
    return [prefix + n for n in (*FUNCTIONS, *TABLE_FUNCTIONS)]
