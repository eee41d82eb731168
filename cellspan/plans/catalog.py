"""All registered queries of the library proper, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.operators import geometry, spatial, stats
from cellspan.plans import analysis, context, images, loops, measures, rules, selection, tables
from cellspan.sources.views import view, with_views

FLAGSHIP = "crop_counts"
FACTORS = [1, 2, 3, 4, 5, 6, 7]
_KNN = """e AS (SELECT a.cell_idx AS src, b.cell_idx AS dst, row_number() OVER (PARTITION BY a.cell_idx ORDER BY (a.centroid_x - b.centroid_x) * (a.centroid_x - b.centroid_x) + (a.centroid_y - b.centroid_y) * (a.centroid_y - b.centroid_y), b.cell_idx) AS rank
 FROM v_cells a JOIN v_cells b ON a.cell_idx <> b.cell_idx AND b.centroid_x BETWEEN a.centroid_x - 15 AND a.centroid_x + 15
 AND (a.centroid_x - b.centroid_x) * (a.centroid_x - b.centroid_x) + (a.centroid_y - b.centroid_y) * (a.centroid_y - b.centroid_y) <= 225)"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _edges(s: SparkSession, d: str) -> DataFrame:
    cells = view(s, d, "v_cells")
    return spatial.knn_join(cells, cells, 12, 15.0)


def _typed(s: SparkSession, d: str) -> DataFrame:
    cells = view(s, d, "v_cells")
    near = spatial.knn_join(cells.where("cell_type is null"), cells.where("cell_type is not null"), 1, 25.0)
    return near.select(F.col("src").alias("cell_idx"), F.col("dst").alias("nearest"))


def _upsert(s: SparkSession, d: str) -> DataFrame:
    z = view(s, d, "v_z_attrs")
    return stats.upsert(z, z.where("z_confidence < 0.3").withColumn("z_confidence", F.lit(1.0)), "cell_id")


#: name: (query, SQL without the views)
ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "crop_counts": (
        lambda s, d: spatial.crop_counts(view(s, d, "v_molecules"), view(s, d, "v_crops")),
        """SELECT c.crop_id, count(m.o) AS total, count(m.o) FILTER (WHERE m.cell_id <> 'UNASSIGNED') AS assigned FROM v_crops c LEFT JOIN (
        SELECT cell_id, (SELECT min(crop_ord) FROM v_crops WHERE x_location BETWEEN xmin AND xmax AND y_location BETWEEN ymin AND ymax) AS o FROM v_molecules WHERE qv >= 20) m ON m.o = c.crop_ord GROUP BY c.crop_id""",
    ),
    "knn_adjacency": (lambda s, d: _edges(s, d).select("src", "dst", "rank"), f"{_KNN} SELECT src, dst, CAST(rank AS INTEGER) AS rank FROM e WHERE rank <= 12"),
    "neighbor_matrix": (
        lambda s, d: _rounded(stats.neighbor_matrix(_edges(s, d), view(s, d, "v_cells")), "share"),
        f"""{_KNN}, n AS (SELECT a.cell_type AS type_a, b.cell_type AS type_b, count(*) AS n FROM e JOIN v_cells a ON src = a.cell_idx JOIN v_cells b ON dst = b.cell_idx
        WHERE rank <= 12 AND a.cell_type IS NOT NULL AND b.cell_type IS NOT NULL GROUP BY 1, 2)
        SELECT type_a, type_b, n, round(n / sum(n) OVER (PARTITION BY type_a), 6) AS share FROM n""",
    ),
    "nearest_typed_cell": (
        _typed,
        """SELECT cell_idx, nearest FROM (SELECT a.cell_idx, b.cell_idx AS nearest, row_number() OVER (PARTITION BY a.cell_idx ORDER BY (a.centroid_x - b.centroid_x) * (a.centroid_x - b.centroid_x) + (a.centroid_y - b.centroid_y) * (a.centroid_y - b.centroid_y), b.cell_idx) AS r
        FROM v_cells a JOIN v_cells b ON a.cell_type IS NULL AND b.cell_type IS NOT NULL AND (a.centroid_x - b.centroid_x) * (a.centroid_x - b.centroid_x) + (a.centroid_y - b.centroid_y) * (a.centroid_y - b.centroid_y) <= 625) WHERE r = 1""",
    ),
    "polygon_stats": (
        lambda s, d: _rounded(geometry.polygon_stats(view(s, d, "v_polygons")), "area", "cx", "cy", "major", "minor"),
        """SELECT cell_id, round(area, 6) AS area, round(cx, 6) AS cx, round(cy, 6) AS cy, round(2 * sqrt(h + r), 6) AS major, round(2 * sqrt(greatest(h - r, 1e-12)), 6) AS minor FROM (
        SELECT cell_id, abs(sum(vertex_x * ny - nx * vertex_y)) / 2 AS area, avg(vertex_x) AS cx, avg(vertex_y) AS cy, (var_pop(vertex_x) + var_pop(vertex_y)) / 2 AS h,
        sqrt(power((var_pop(vertex_x) - var_pop(vertex_y)) / 2, 2) + power(covar_pop(vertex_x, vertex_y), 2)) AS r FROM (
        SELECT *, coalesce(lead(vertex_x) OVER w, first_value(vertex_x) OVER w) AS nx, coalesce(lead(vertex_y) OVER w, first_value(vertex_y) OVER w) AS ny FROM v_polygons WINDOW w AS (PARTITION BY cell_id ORDER BY vertex_ord)) GROUP BY cell_id)""",
    ),
    "noise_fraction": (lambda s, d: _rounded(stats.noise_fraction(view(s, d, "v_molecules")), "noise_fraction"), "SELECT round(count(*) FILTER (WHERE cell_id = 'UNASSIGNED') / count(*), 6) AS noise_fraction FROM v_molecules"),
    "count_prior": (
        lambda s, d: _rounded(stats.count_prior(view(s, d, "v_molecules"), view(s, d, "v_cells")), "mean_count", "sigma"),
        """SELECT cell_type, count(*) AS n_cells, round(avg(n) FILTER (WHERE n > 0), 6) AS mean_count, round(stddev_pop(ln(1 + n)), 6) AS sigma FROM (
        SELECT c.cell_type, coalesce(m.n, 0) AS n FROM v_cells c LEFT JOIN (SELECT cell_id, count(*) AS n FROM v_molecules WHERE cell_id <> 'UNASSIGNED' GROUP BY 1) m USING (cell_id) WHERE c.cell_type IS NOT NULL) GROUP BY 1""",
    ),
    "factor_gene_rates": (
        lambda s, d: _rounded(stats.factor_gene_rates(view(s, d, "v_molecules")), "rate"),
        "SELECT factor, feature_name, round(count(*) / sum(count(*)) OVER (PARTITION BY factor), 6) AS rate FROM v_molecules GROUP BY 1, 2",
    ),
    "nuclear_fraction": (
        lambda s, d: _rounded(stats.nuclear_fraction(view(s, d, "v_molecules")), "nuclear_fraction"),
        "SELECT feature_name, round(CASE WHEN count(*) >= 10 THEN avg(overlaps_nucleus) ELSE 0.5e0 END, 6) AS nuclear_fraction FROM v_molecules GROUP BY 1",
    ),
    "type_summary_quantiles": (
        lambda s, d: _rounded(stats.type_quantiles(view(s, d, "v_cells")), "p10", "p50", "p90"),
        "SELECT cell_type, count(*) AS n, " + ", ".join(f"round(quantile_cont(nucleus_area, {q}), 6) AS {n}" for q, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))) + " FROM v_cells WHERE cell_type IS NOT NULL GROUP BY 1",
    ),
    "factor_fractions_pivot": (
        lambda s, d: _rounded(stats.factor_fractions(view(s, d, "v_molecules"), FACTORS), *(f"factor_{f}" for f in FACTORS)),
        "SELECT cell_id, " + ", ".join(f"round(count(*) FILTER (WHERE factor = {f}) / count(*), 6) AS factor_{f}" for f in FACTORS) + " FROM v_molecules WHERE cell_id <> 'UNASSIGNED' GROUP BY 1",
    ),
    "label_centroids": (
        lambda s, d: _rounded(geometry.label_centroids(view(s, d, "v_pixels")), "cy", "cx"),
        "SELECT scene_id, label, count(*) AS area, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, CAST(sum(nucleus) AS BIGINT) AS nucleus_area FROM v_pixels WHERE label > 0 GROUP BY 1, 2",
    ),
    "coarse_field": (
        lambda s, d: _rounded(geometry.coarse_field(view(s, d, "v_pixels"), 4), "share"),
        "SELECT scene_id, CAST(floor(y / 4) AS INTEGER) AS by, CAST(floor(x / 4) AS INTEGER) AS bx, label, round(count(*) / 16, 6) AS share FROM v_pixels GROUP BY 1, 2, 3, 4",
    ),
    "z_upsert": (_upsert, "SELECT cell_id, z_center_um, z_extent_um, CASE WHEN z_confidence < 0.3 THEN 1.0e0 ELSE z_confidence END AS z_confidence FROM v_z_attrs"),
}

ALL |= analysis.ALL | tables.ALL | measures.ALL | loops.ALL | selection.ALL | images.ALL | rules.ALL | context.ALL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    # A SQL text that starts with a table expression of its own goes on with the views' list.
    texts = {k: with_views(sql) if sql.lstrip().startswith("SELECT") else with_views(f",{sql}").replace("\n,e AS", ",\ne AS") for k, (_, sql) in ALL.items() if sql}
    return {k: sql.replace("WITH ", "WITH RECURSIVE ", 1) if k in selection.RECURSIVE | images.RECURSIVE | loops.RECURSIVE else sql for k, sql in texts.items()}
