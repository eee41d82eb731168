"""Queries on label images that grow with the cells: masks of half a micrometre a pixel, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.operators import images, spectra
from cellspan.operators.staging import cut
from cellspan.sources.views import view

PIXEL = 0.5
PLANES = (11, 14, 17)


def _labels(s: SparkSession, d: str) -> DataFrame:
    """The image of all cells, each an ellipse; nucleus: its inner quarter."""
    nucleus = (F.col("r2") <= 0.25).cast("int").alias("nucleus")
    masks = view(s, d, "v_masks").where("r2 <= 1").select(F.lit(0).alias("scene_id"), (F.col("cell_idx") + 1).alias("label"), "y", "x", nucleus)
    return images.paint(masks, "nucleus")


_LABELS = """p AS (SELECT cell_idx, y, x, r2 FROM v_masks WHERE r2 <= 1), area AS (SELECT cell_idx, count(*) AS n FROM p GROUP BY 1),
l AS (SELECT y, x, cell_idx + 1 AS label, r2 FROM p JOIN area USING (cell_idx) QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY n, cell_idx DESC) = 1)"""


def _planes(s: SparkSession, d: str) -> DataFrame:
    """Masks of the cells that reach a plane, as wide as their ellipsoids are there."""
    z = view(s, d, "v_z_attrs").join(view(s, d, "v_cells").select("cell_id", "cell_idx"), "cell_id").withColumn("z", F.explode(F.array(*(F.lit(p) for p in PLANES))))
    depth = F.pow((F.col("z") - F.col("z_center_um")) / (F.col("z_extent_um") / 2), 2)
    section = z.select("cell_idx", F.col("z").alias("scene_id"), (1 - depth).alias("room")).where("room > 0")
    return view(s, d, "v_masks").join(section, "cell_idx").where("r2 <= room").select("scene_id", (F.col("cell_idx") + 1).alias("label"), "y", "x")


def _tessellated(s: SparkSession, d: str) -> DataFrame:
    grown = images.grow_labels(images.paint(_planes(s, d)), 3)
    return grown.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("area"), F.sum("y").alias("sum_y"), F.sum("x").alias("sum_x"))


def _grow(k: int) -> str:
    steps = "(SELECT i, j FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)) s"
    return f"g{k} AS (SELECT scene_id, y, x, label FROM g{k - 1} UNION ALL SELECT scene_id, y, x, max(label) AS label FROM (SELECT scene_id, y + i AS y, x + j AS x, label FROM g{k - 1}, {steps}) n WHERE NOT EXISTS (SELECT 1 FROM g{k - 1} o WHERE o.scene_id = n.scene_id AND o.y = n.y AND o.x = n.x) GROUP BY 1, 2, 3)"


_TESSELLATED = f"""m AS (SELECT t.z AS scene_id, cell_idx, 1 - power((t.z - z_center_um) / (z_extent_um / 2), 2) AS room FROM v_z_attrs JOIN v_cells USING (cell_id), (VALUES {", ".join(f"({p})" for p in PLANES)}) t(z)),
p AS (SELECT scene_id, cell_idx, y, x FROM v_masks JOIN m USING (cell_idx) WHERE room > 0 AND r2 <= room), area AS (SELECT scene_id, cell_idx, count(*) AS n FROM p GROUP BY 1, 2),
g0 AS (SELECT scene_id, y, x, cell_idx + 1 AS label FROM p JOIN area USING (scene_id, cell_idx) QUALIFY row_number() OVER (PARTITION BY scene_id, y, x ORDER BY n, cell_idx DESC) = 1),
{_grow(1)}, {_grow(2)}, {_grow(3)}
SELECT CAST(scene_id AS BIGINT) AS scene_id, label, count(*) AS area, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(x) AS BIGINT) AS sum_x FROM g3 GROUP BY 1, 2"""

#: Rings in SQL: the side that follows each side, then a walk from every side until it is back.
_SIDES = ((0, (0, 1), (-1, 0)), (1, (1, 0), (0, 1)), (2, (0, -1), (1, 0)), (3, (-1, 0), (0, -1)))


def _rings() -> str:
    at = lambda i, j, a: f"LEFT JOIN l {a} ON {a}.y = l.y + ({i}) AND {a}.x = l.x + ({j}) AND {a}.label = l.label"
    number = lambda y, x, side: f"(({y}) * 2147483648 + ({x})) * 4 + {side}"
    parts = []
    for side, (ay, ax), (cy, cx) in _SIDES:
        after = f"CASE WHEN a.label IS NULL THEN {number('l.y', 'l.x', (side + 1) % 4)} WHEN b.label IS NULL THEN {number(f'l.y + ({ay})', f'l.x + ({ax})', side)} ELSE {number(f'l.y + ({ay + cy})', f'l.x + ({ax + cx})', (side + 3) % 4)} END"
        parts.append(
            f"SELECT l.label, l.y, l.x, {side} AS side, {number('l.y', 'l.x', side)} AS id, {after} AS next, l.x + {cx / 2} AS vx, l.y + {cy / 2} AS vy, {('0e0', 'l.x + 0.5e0', '0e0', '0.5e0 - l.x')[side]} AS across"
            f" FROM l {at(cy, cx, 'o')} {at(ay, ax, 'a')} {at(ay + cy, ax + cx, 'b')} WHERE o.label IS NULL"
        )
    return f"""{_LABELS}, c AS ({" UNION ALL ".join(parts)}),
w AS (SELECT id AS start, id AS cur, next AS ahead, 0 AS step FROM c UNION ALL SELECT w.start, c.id, c.next, w.step + 1 FROM w JOIN c ON c.id = w.ahead WHERE w.ahead <> w.start),
r AS (SELECT start FROM w GROUP BY 1 HAVING min(cur) = start),
v AS (SELECT c.label, w.start AS ring, CAST(w.step AS BIGINT) AS ord, c.vx, c.vy, count(*) OVER q AS length, sum(c.across) OVER q AS area FROM w JOIN r USING (start) JOIN c ON c.id = w.cur WINDOW q AS (PARTITION BY w.start)),
k AS (SELECT label, first(ring ORDER BY length DESC, ring) AS ring FROM v WHERE ord = 0 GROUP BY 1)"""


def _contours(s: SparkSession, d: str) -> DataFrame:
    rings = images.label_contours(_labels(s, d), PIXEL)
    return rings.select("label", "ring", "ord", F.round("vertex_x", 6).alias("vertex_x"), F.round("vertex_y", 6).alias("vertex_y"), "length", F.round("area", 6).alias("area"))


def _geometry(s: SparkSession, d: str) -> DataFrame:
    g = images.scene_geometry(_labels(s, d), PIXEL)
    return g.select("label", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "area", "nuc_area", "ring_area")), "n_rings", "n_vertices")


def _collected(s: SparkSession, d: str) -> DataFrame:
    """Real rings of the cells of even number, contours of the others."""
    real = view(s, d, "v_polygons").where("cell_idx % 2 = 0").select((F.col("cell_idx") + 1).alias("label"), F.col("vertex_ord").alias("ord"), "vertex_x", "vertex_y")
    out = images.collect_polygons(images.label_polygons(_labels(s, d), PIXEL), real)
    return out.withColumns({v: F.round(v, 6) for v in ("vertex_x", "vertex_y")})


def _enclosed(s: SparkSession, d: str) -> DataFrame:
    """Regions that the outlines of the cells' masks close in."""
    labels = cut(_labels(s, d), "labels")
    ridge = images.outlines(labels).select("scene_id", "y", "x", F.lit(0.5).alias("score"))
    extent = labels.agg((F.max("y") + 3).alias("height"), (F.max("x") + 3).alias("width")).select(F.lit(0).alias("scene_id"), "height", "width")
    out = images.enclosed_regions(ridge, extent, 0.1, 12, 4000, 0.0)
    return out.select("component", "area", *(F.round(c, 6).alias(c) for c in ("cy", "cx", "radius", "enclosure", "score")))


def _textured(s: SparkSession, d: str) -> DataFrame:
    """The image of the cells with a value that repeats along its rows and columns."""
    return _labels(s, d).select("scene_id", "y", "x", (((F.col("x") * 7 + F.col("y") * 13) % 97) / 97).alias("value"))


def _radial(s: SparkSession, d: str) -> DataFrame:
    power = spectra.log_power(_textured(s, d), 32, 12)
    return power.groupBy("bin").agg(F.count(F.lit(1)).alias("patches"), F.round(F.avg("power"), 4).alias("power"))


def _anisotropy(s: SparkSession, d: str) -> DataFrame:
    polar = spectra.log_power(_textured(s, d), 32, 8, 8)
    return spectra.anisotropy(polar, 8, 8).select("py", "px", F.round("anisotropy", 4).alias("anisotropy"))


#: Queries whose SQL goes step by step.
RECURSIVE = {"label_contours", "scene_geometry", "collect_polygons"}

#: Queries without SQL are held against plain Python in tests/test_images.py and test_sampling.py.
ALL = {
    "painted_labels": (
        lambda s, d: _labels(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("area"), F.sum("nucleus").alias("nucleus")),
        f"{_LABELS} SELECT label, count(*) AS area, count(*) FILTER (WHERE r2 <= 0.25) AS nucleus FROM l GROUP BY 1",
    ),
    "z_tessellation": (_tessellated, _TESSELLATED),
    "label_contours": (_contours, f"{_rings()} SELECT label, ring, ord, round(vx / 2, 6) AS vertex_x, round(vy / 2, 6) AS vertex_y, length, round(area / 4, 6) AS area FROM v"),
    "scene_geometry": (
        _geometry,
        f"""{_rings()}, g AS (SELECT label, avg(x) / 2 AS cx, avg(y) / 2 AS cy, count(*) / 4e0 AS area, count(*) FILTER (WHERE r2 <= 0.25) / 4e0 AS nuc_area FROM l GROUP BY 1),
        n AS (SELECT label, count(*) AS n_rings, max(length) AS n_vertices, sum(area) / 4 AS ring_area FROM v WHERE ord = 0 GROUP BY 1)
        SELECT label, round(cx, 6) AS cx, round(cy, 6) AS cy, round(area, 6) AS area, round(nuc_area, 6) AS nuc_area, round(ring_area, 6) AS ring_area, n_rings, n_vertices FROM g JOIN n USING (label)""",
    ),
    "collect_polygons": (
        _collected,
        f"""{_rings()} SELECT label, 'contour' AS source, ord, round(vx / 2, 6) AS vertex_x, round(vy / 2, 6) AS vertex_y FROM v JOIN k USING (label, ring) WHERE label % 2 = 0
        UNION ALL SELECT cell_idx + 1, 'real', CAST(vertex_ord AS BIGINT), round(vertex_x, 6), round(vertex_y, 6) FROM v_polygons WHERE cell_idx % 2 = 0""",
    ),
    "enclosed_ridges": (_enclosed, None),
    "radial_power": (_radial, None),
    "cardinal_anisotropy": (_anisotropy, None),
}
