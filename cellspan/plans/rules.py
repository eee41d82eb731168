"""Queries on rules of tables and artifacts, and through functions for SQL users, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.functions import sql as sql_functions
from cellspan.operators import contracts
from cellspan.operators.contracts import Rule
from cellspan.sources import manifests
from cellspan.sources.views import view

#: A JSON artifact of each cell, of one of three kinds, some with faults.
_ARTIFACT = """case when cell_idx % 17 = 0 then 'not JSON'
 when cell_idx % 3 = 0 then concat('{"type":"lab.crop_manifest.v0","schema_version":"', case when cell_idx % 7 = 0 then '0.0.9' else '0.1.0' end,
   '","bundle":{},"image_channels":["dapi"],"num_crops":2,"crop_selection":{},', case when cell_idx % 5 = 0 then '' else '"split_path":"splits.json",' end, '"split_method":"checkerboard","crops":',
   case when cell_idx % 13 = 0 then '{}' else concat('[{"crop_id":"a","crop_box":{},"npz_path":"a","split":"train","qc":{}},{"crop_id":"b","crop_box":{},"npz_path":"b","split":"', case when cell_idx % 11 = 0 then 'dev' else 'test' end, '","qc":{}}]') end, '}')
 when cell_idx % 3 = 1 then concat('{"type":"lab.scene_review.v0","schema_version":"0.1.0","sheet_path":"s","num_rows":', 1 + cell_idx % 4, ',"selection_groups":{},"rows":', case when cell_idx % 2 = 0 then '[{}]' else '[{},{}]' end,
   case when cell_idx % 19 = 0 then '' else ',"scene_fit":"f"' end, '}')
 else concat('{"type":"lab.', case when cell_idx % 23 = 0 then 'unheard_of' else 'cell_flow_sweep.v0' end, '","schema_version":"0.1.0","checkpoint_path":"c","anchor_profile_path":"a","selection_objective":"o","base_sample_options":{},"benchmark_options":{},"num_candidates":', cell_idx % 4,
   ',"ranking":[1],"candidates":[1],"best_candidate":{"name":"n"', case when cell_idx % 4 = 0 then '' else ',"slug":"s"' end, ',"metrics":{}}}') end"""
_KIND = "CASE WHEN cell_idx % 17 = 0 THEN NULL WHEN cell_idx % 3 = 0 THEN 'crop' WHEN cell_idx % 3 = 1 THEN 'scene-review' WHEN cell_idx % 23 <> 0 THEN 'cell-flow-sweep' END"
_FAULTS = f"""k AS (SELECT cell_idx AS i, cell_id AS path, {_KIND} AS kind FROM v_cells),
f AS (SELECT path, kind, 'object' AS rule, 'text' AS detail FROM k WHERE i % 17 = 0
 UNION ALL SELECT path, kind, 'type', 'lab.unheard_of' FROM k WHERE kind IS NULL AND i % 17 <> 0
 UNION ALL SELECT path, kind, 'schema_version', '0.0.9' FROM k WHERE kind = 'crop' AND i % 7 = 0
 UNION ALL SELECT path, kind, 'key', 'split_path' FROM k WHERE kind = 'crop' AND i % 5 = 0
 UNION ALL SELECT path, kind, 'list', 'crops' FROM k WHERE kind = 'crop' AND i % 13 = 0
 UNION ALL SELECT path, kind, 'split', '1:dev' FROM k WHERE kind = 'crop' AND i % 11 = 0 AND i % 13 <> 0
 UNION ALL SELECT path, kind, 'length', 'num_rows=rows' FROM k WHERE kind = 'scene-review' AND 1 + i % 4 <> 1 + i % 2
 UNION ALL SELECT path, kind, 'key', 'scene_summary or scene_fit' FROM k WHERE kind = 'scene-review' AND i % 19 = 0
 UNION ALL SELECT path, kind, 'length', 'num_candidates=candidates' FROM k WHERE kind = 'cell-flow-sweep' AND i % 4 <> 1
 UNION ALL SELECT path, kind, 'key', 'best_candidate.slug' FROM k WHERE kind = 'cell-flow-sweep' AND i % 4 = 0)"""


def _artifacts(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "v_cells").select(F.col("cell_id").alias("path"), F.expr(_ARTIFACT).alias("text"))


def _summaries(s: SparkSession, d: str) -> DataFrame:
    """How many artifacts of each kind are right, and what they say together."""
    crops = F.col("facts")["crops"].try_cast("int")  # the length of the list; nothing where it is no list
    known = manifests.summaries(_artifacts(s, d)).groupBy(F.coalesce("kind", F.lit("none")).alias("kind"))
    return known.agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"), F.sum("n_violations").alias("n_violations"), F.coalesce(F.sum(crops), F.lit(0)).alias("crops"))


_SCENE_CELLS = """select cell_idx, cell_idx % 5 as scene_id, case when cell_idx % 101 = 0 then '' else concat('c', cell_idx % 1000) end as cell_id, cell_idx % 29 as label,
 case when cell_idx % 37 = 0 then 'guessed' else 'synthetic' end as source, case when cell_idx % 41 = 0 then 'upright' else 'full' end as sectioning_state, (cell_area - 30) / 80 as segmentation_reliability,
 nucleus_area / 50 as visibility_fraction, nucleus_area - 9 as membrane_efficiency, cell_area - 30 as dapi_efficiency, case when cell_idx % 3 = 0 then cell_idx % 27 end as nucleus_label from v_cells"""


def _scene_contract(s: SparkSession, d: str) -> DataFrame:
    """Rows of the cells, checked against the label images as if they were their scenes."""
    pixels = view(s, d, "v_pixels").where("label > 0")
    marked = pixels.where("nucleus = 1").select("scene_id", F.col("label").alias("nucleus_label")).distinct()
    tables = {"pixels": pixels.select("scene_id", "label").distinct(), "nuclei": marked}
    rows = s.sql(_SCENE_CELLS.replace("v_cells", "{cells}"), cells=view(s, d, "v_cells"))
    return contracts.check(rows, contracts.scene_rules(), "cell_idx", tables)


_RULES = [
    Rule("required", "cell_id"), Rule("holds", "qv >= 5", name="qv of 5"), Rule("fraction", "overlaps_nucleus"), Rule("positive", "nucleus_distance"), Rule("not_negative", "x_location"),
    Rule("member", "factor", (1, 2, 3, 4, 5, 6)), Rule("matches", "feature_name", "^Brand#[1-4]"), Rule("unique", "mol_key"), Rule("reference", "cell_id", "cells"),
]


def _table_contract(s: SparkSession, d: str) -> DataFrame:
    return contracts.check(view(s, d, "v_molecules"), _RULES, "mol_key", {"cells": view(s, d, "v_cells")})


def _ring_areas(s: SparkSession, d: str) -> DataFrame:
    """Area of each outline, and whether its cell's centre lies in it, through functions for SQL users."""
    sql_functions.register(s, "cellspan_")
    text = """SELECT cell_id, round(cellspan_ring_area(ring), 6) AS area, cellspan_point_in_ring(cx, cy, ring) AS inside FROM (
      SELECT cell_id, avg(vertex_x) AS cx, avg(vertex_y) AS cy, transform(array_sort(collect_list(struct(vertex_ord AS o, CAST(vertex_x AS DOUBLE) AS x, CAST(vertex_y AS DOUBLE) AS y))), v -> struct(v.x, v.y)) AS ring FROM {rings} GROUP BY cell_id)"""
    return s.sql(text, rings=view(s, d, "v_polygons"))


def _grid_counts(s: SparkSession, d: str) -> DataFrame:
    """Cells in the half-open tiles of a grid over each crop, through a table function.

    A cell lies in one square of 10; the tiles, far fewer, are repeated over their squares and hashed, so that the cells are neither repeated nor broadcast.
    """
    sql_functions.register(s, "cellspan_")
    squares = ", ".join(f"LATERAL explode(sequence(floor(g.{v}0 / 10), floor((g.{v}0 + 20) / 10))) {v}(b{v})" for v in "xy")  # those that a tile of 20 reaches over
    text = f"""SELECT /*+ SHUFFLE_HASH(t) */ crop_id, tile_idx, count(*) AS n
      FROM (SELECT crop_id, g.tile_idx, g.x0, g.y0, bx, by FROM {{crops}} c, LATERAL cellspan_tile_grid(c.xmin, c.xmax, c.ymin, c.ymax, 20D, 20D) g, {squares}) t
      JOIN {{cells}} USING (bx, by) WHERE cellspan_in_box_halfopen(centroid_x, centroid_y, x0, x0 + 20, y0, y0 + 20) GROUP BY 1, 2"""
    cells = view(s, d, "v_cells").select("centroid_x", "centroid_y", *(F.floor(F.col(f"centroid_{a}") / 10).alias(f"b{a}") for a in "xy"))
    return s.sql(text, crops=view(s, d, "v_crops"), cells=cells)


def _rule_sql(name: str, table: str, key: str, bad: str) -> str:
    return f"SELECT '{name}' AS rule, count(*) AS n, min(CAST({key} AS VARCHAR)) AS sample FROM {table} WHERE {bad}"


def _unique_sql(name: str, table: str, columns: str) -> str:
    return f"SELECT '{name}' AS rule, coalesce(CAST(sum(k - 1) AS BIGINT), 0) AS n, min(concat_ws(',', {columns})) AS sample FROM (SELECT {columns}, count(*) AS k FROM {table} GROUP BY ALL HAVING count(*) > 1)"


ALL = {
    "artifact_violations": (lambda s, d: manifests.violations(_artifacts(s, d)), f"{_FAULTS} SELECT path, kind, rule, detail FROM f"),
    "artifact_summaries": (
        _summaries,
        f"""{_FAULTS}, n AS (SELECT path, count(*) AS n FROM f GROUP BY 1)
        SELECT coalesce(kind, 'none') AS kind, count(*) AS n, count(*) FILTER (WHERE n.n IS NULL) AS n_valid, coalesce(CAST(sum(n.n) AS BIGINT), 0) AS n_violations,
        2 * count(*) FILTER (WHERE kind = 'crop' AND i % 13 <> 0) AS crops FROM k LEFT JOIN n USING (path) GROUP BY 1""",
    ),
    "scene_contract": (
        _scene_contract,
        f"c AS ({_SCENE_CELLS}), p AS (SELECT DISTINCT scene_id, label FROM v_pixels WHERE label > 0), u AS (SELECT DISTINCT scene_id, label AS nucleus_label FROM v_pixels WHERE label > 0 AND nucleus = 1) "
        + " UNION ALL ".join([
            _rule_sql("required:cell_id", "c", "cell_idx", "cell_id = ''"), _unique_sql("unique:scene_id, cell_id", "c", "scene_id, cell_id"), _rule_sql("positive:label", "c", "cell_idx", "label <= 0"),
            _unique_sql("unique:scene_id, label", "c", "scene_id, label"), _rule_sql("reference:scene_id, label", "c ANTI JOIN p USING (scene_id, label)", "cell_idx", "true"),
            _rule_sql("member:source", "c", "cell_idx", "source = 'guessed'"), _rule_sql("member:sectioning_state", "c", "cell_idx", "sectioning_state = 'upright'"),
            _rule_sql("fraction:segmentation_reliability", "c", "cell_idx", "segmentation_reliability NOT BETWEEN 0 AND 1"), _rule_sql("fraction:visibility_fraction", "c", "cell_idx", "visibility_fraction NOT BETWEEN 0 AND 1"),
            _rule_sql("not_negative:membrane_efficiency", "c", "cell_idx", "membrane_efficiency < 0"), _rule_sql("not_negative:dapi_efficiency", "c", "cell_idx", "dapi_efficiency < 0"),
            _rule_sql("reference:scene_id, nucleus_label", "c ANTI JOIN u USING (scene_id, nucleus_label)", "cell_idx", "nucleus_label IS NOT NULL"),
        ]),
    ),
    "table_contract": (
        _table_contract,
        "c AS (SELECT cell_id FROM v_cells) "
        + " UNION ALL ".join([
            _rule_sql("required:cell_id", "v_molecules", "mol_key", "trim(cell_id) = ''"), _rule_sql("qv of 5", "v_molecules", "mol_key", "qv < 5"), _rule_sql("fraction:overlaps_nucleus", "v_molecules", "mol_key", "overlaps_nucleus NOT BETWEEN 0 AND 1"),
            _rule_sql("positive:nucleus_distance", "v_molecules", "mol_key", "nucleus_distance <= 0"), _rule_sql("not_negative:x_location", "v_molecules", "mol_key", "x_location < 0"), _rule_sql("member:factor", "v_molecules", "mol_key", "factor NOT IN (1, 2, 3, 4, 5, 6)"),
            _rule_sql("matches:feature_name", "v_molecules", "mol_key", "NOT regexp_matches(feature_name, '^Brand#[1-4]')"), _unique_sql("unique:mol_key", "v_molecules", "mol_key"), _rule_sql("reference:cell_id", "v_molecules ANTI JOIN c USING (cell_id)", "mol_key", "cell_id IS NOT NULL"),
        ]),
    ),
    "ring_functions": (
        _ring_areas,
        """SELECT cell_id, round(abs(sum(vertex_x * ny - nx * vertex_y)) / 2, 6) AS area, true AS inside FROM (
        SELECT *, coalesce(lead(vertex_x) OVER w, first_value(vertex_x) OVER w) AS nx, coalesce(lead(vertex_y) OVER w, first_value(vertex_y) OVER w) AS ny FROM v_polygons WINDOW w AS (PARTITION BY cell_id ORDER BY vertex_ord)) GROUP BY cell_id""",
    ),
    "tile_grid_function": (
        _grid_counts,
        """SELECT crop_id, CAST(floor((centroid_y - ymin) / 20) * 4 + floor((centroid_x - xmin) / 20) AS BIGINT) AS tile_idx, count(*) AS n
        FROM v_crops JOIN v_cells ON centroid_x >= xmin AND centroid_x < xmin + 80 AND centroid_y >= ymin AND centroid_y < ymin + 80 GROUP BY 1, 2""",
    ),
}
