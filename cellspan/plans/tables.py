"""Queries on tables of cells, molecules and labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.functions import columns
from cellspan.operators import cells as ops
from cellspan.operators import geometry, spatial, stats
from cellspan.operators.quantiles import quantile_table
from cellspan.operators.staging import cut
from cellspan.sources import bundle
from cellspan.sources.views import view


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_BOUNDS = "b AS (SELECT min(centroid_x) AS xmin, max(centroid_x) AS xmax, min(centroid_y) AS ymin, max(centroid_y) AS ymax FROM v_cells)"
_STATS = """q AS (SELECT cell_id, avg(vertex_x) AS cx, avg(vertex_y) AS cy, (var_pop(vertex_x) + var_pop(vertex_y)) / 2 AS h,
 sqrt(power((var_pop(vertex_x) - var_pop(vertex_y)) / 2, 2) + power(covar_pop(vertex_x, vertex_y), 2)) AS r FROM v_polygons GROUP BY cell_id)"""
_ASSIGNED = "cell_id NOT IN ('', '0', 'cell_0', 'UNASSIGNED', 'None', 'nan')"


def _bounds(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "v_cells")
    return c.agg(*(f(f"centroid_{a}").alias(f"{a}{n}") for a in "xy" for f, n in ((F.min, "min"), (F.max, "max"))))


def _union_bbox(s: SparkSession, d: str) -> DataFrame:
    crops = view(s, d, "v_crops")
    return spatial.crop_counts(bundle.scan_molecules(view(s, d, "v_molecules"), crops).withColumn("qv", F.lit(20.0)), crops)


def _states(s: SparkSession, d: str) -> DataFrame:
    """Per type and state, zeros filled in: aspect and edge contact come from ids, as the views have square cells."""
    c = view(s, d, "v_cells").where("cell_type is not null")
    c = c.withColumns({"aspect": 1 + F.col("cell_idx") % 7 / F.lit(2.0), "edge": F.col("cell_idx") % 10 / F.lit(100.0), "nucleus": F.when(F.col("cell_idx") % 6 == 0, 0.0).otherwise(F.col("nucleus_area"))})
    small = quantile_table(c, [], {"v": F.col("cell_area")}, [0.3]).agg(F.max("value").alias("small"))
    c = c.crossJoin(F.broadcast(small)).withColumn("state", columns.section_state(F.col("cell_area"), F.col("nucleus"), F.col("aspect"), F.col("edge"), F.col("small")))  # one row
    n = c.groupBy("cell_type").agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.col("state") == v).alias(v) for v in _STATE))
    return n.select("cell_type", *((F.col(v) / F.col("all")).alias(v) for v in _STATE))


_STATE = ["full", "nucleus_rich", "sliver", "membrane_only", "nucleus_poor"]
_STATE_SQL = """c AS (SELECT *, 1 + cell_idx % 7 / 2.0e0 AS aspect, cell_idx % 10 / 100.0e0 AS edge, CASE WHEN cell_idx % 6 = 0 THEN 0 ELSE nucleus_area END AS nucleus FROM v_cells WHERE cell_type IS NOT NULL),
 g AS (SELECT quantile_cont(cell_area, 0.3) AS small FROM c),
 q AS (SELECT cell_type, CASE WHEN cell_area <= 0 THEN 'unknown' WHEN nucleus > 0 AND nucleus / cell_area > 0.6 THEN 'nucleus_rich' WHEN nucleus > 0 AND nucleus / cell_area BETWEEN 0.2 AND 0.6 AND edge < 0.05 THEN 'full'
 WHEN cell_area < small AND aspect > 3 THEN 'sliver' WHEN nucleus = 0 AND cell_area < small THEN 'membrane_only' WHEN nucleus = 0 OR nucleus / cell_area < 0.1 THEN 'nucleus_poor' ELSE 'full' END AS state FROM c, g)"""


def _edits(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "v_cells").where("cell_idx % 10 < 4")
    action = F.element_at(F.array(*map(F.lit, ("remove", "retype", "move", "copy"))), (F.col("cell_idx") % 10 + 1).cast("int"))
    return c.select("cell_id", action.alias("action"), F.lit("EDITED").alias("cell_type"), F.lit(2.5).alias("dx"), F.lit(-1.5).alias("dy"))


def _anchors(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "v_polygons")
    notes = view(s, d, "v_cells").where("cell_type is not null").select("cell_id", "cell_type")
    return ops.anchor_records(p, p.where("cell_idx % 3 > 0 and vertex_ord < 6"), notes)


def _lookup(s: SparkSession, d: str) -> DataFrame:
    m = view(s, d, "v_molecules").join(view(s, d, "v_cells").select("cell_id", "cell_type").hint("shuffle_hash"), "cell_id", "left")
    # One pass over the molecules: those of a gene and type have one rate.
    m = cut(m.groupBy("feature_name", "cell_type").agg(F.count(F.lit(1)).alias("n"), F.sum("overlaps_nucleus").alias("inside")), "counts")
    rate = lambda g, name, least: g.where(F.col("n") >= least).withColumn(name, F.col("inside") / F.col("n")).drop("n", "inside")
    gene = m.groupBy("feature_name").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))
    out = ops.compartment_lookup(m, rate(m, "pair_rate", 20), rate(gene, "gene_rate", 200), 0.25)
    return out.groupBy("feature_name", F.coalesce("cell_type", F.lit("none")).alias("cell_type")).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("p"))


def _violations(s: SparkSession, d: str) -> DataFrame:
    c, z, p = view(s, d, "v_cells"), view(s, d, "v_z_attrs"), view(s, d, "v_polygons")
    return ops.contract(
        {"type is known": c.where("cell_type is null"), "nucleus within cell": c.where("nucleus_area > cell_area"), "extent is positive": z.where("z_extent_um <= 0"),
         "z has a cell": z.join(c, "cell_id", "left_anti"), "cell has z": c.join(z, "cell_id", "left_anti"), "ring has three corners": p.groupBy("cell_id").count().where("count < 3")},
        "cell_id",
    )


def _classified(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", F.concat(F.lit("t"), F.col("label").cast("string")).alias("cell_type"))
    each = e.select("cell_type", F.posexplode("embedding").alias("i", "x")).groupBy("cell_type", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = each.groupBy("cell_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("c"))
    return ops.cosine_classify(e.select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("h")), mean)


def _resolved(s: SparkSession, d: str) -> DataFrame:
    """Tiers with confidences: the annotation of every third cell, a share of molecules, training labels of every fifth, neighbours."""
    c = view(s, d, "v_cells")
    n = view(s, d, "v_molecules").where("cell_id <> 'UNASSIGNED'").groupBy("cell_id", "factor").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("cell_id").agg(F.max_by("factor", F.struct("n", -F.col("factor"))).alias("top"), (F.max("n") / F.sum("n")).alias("share"), F.sum("n").alias("n"))
    i = F.col("cell_idx")
    tiers = [
        ("annotation", F.when(i % 3 == 0, F.when(i % 2 == 0, F.lit("Unknown")).otherwise(F.col("cell_type"))), F.lit(1.0)),
        ("transcripts", F.when(F.col("n") >= 5, F.concat(F.lit("factor_"), F.col("top").cast("string"))), F.col("share") * 1.5),
        ("training", F.when(i % 5 == 0, F.lit("trained")), F.lit(0.7)), ("neighbor", F.when(i % 7 == 0, F.col("cell_type")), F.lit(0.4)),
    ]
    return ops.resolve_types(c.join(top, "cell_id", "left"), tiers).select("cell_id", "resolved", "source", "confidence", "evidence")


_RESOLVED = """n AS (SELECT cell_id, factor, count(*) AS n FROM v_molecules WHERE cell_id <> 'UNASSIGNED' GROUP BY 1, 2), k AS (SELECT cell_id, first(factor ORDER BY n DESC, factor) AS top, max(n) / sum(n) AS share, sum(n) AS n FROM n GROUP BY 1),
 t AS (SELECT cell_id, CASE WHEN cell_idx % 3 = 0 AND cell_idx % 2 <> 0 THEN cell_type END AS a, CASE WHEN n >= 5 THEN concat('factor_', top) END AS t, least(share * 1.5, 1) AS tc, CASE WHEN cell_idx % 5 = 0 THEN 'trained' END AS r,
 CASE WHEN cell_idx % 7 = 0 THEN cell_type END AS k FROM v_cells LEFT JOIN k USING (cell_id)),
 w AS (SELECT cell_id, coalesce(a, t, r, k) AS resolved, CASE WHEN a IS NOT NULL THEN 'annotation' WHEN t IS NOT NULL THEN 'transcripts' WHEN r IS NOT NULL THEN 'training' WHEN k IS NOT NULL THEN 'neighbor' ELSE 'unresolved' END AS source,
 CASE WHEN a IS NOT NULL THEN 1e0 WHEN t IS NOT NULL THEN tc WHEN r IS NOT NULL THEN 0.7e0 WHEN k IS NOT NULL THEN 0.4e0 ELSE 0e0 END AS confidence,
 concat('{', concat_ws(',', CASE WHEN a IS NOT NULL THEN concat('"annotation":"', a, '"') END, CASE WHEN k IS NOT NULL THEN concat('"neighbor":"', k, '"') END, CASE WHEN r IS NOT NULL THEN concat('"training":"', r, '"') END, CASE WHEN t IS NOT NULL THEN concat('"transcripts":"', t, '"') END), '}') AS evidence FROM t)"""


def _admixed(s: SparkSession, d: str) -> DataFrame:
    from cellspan.plans.analysis import _alpha

    return ops.scale_admixture(_alpha(s, d, False).withColumn("admixed", F.col("factor").isin(2, 5) & (F.col("cell_type") != "BUILDING")), 2.0)


#: name: (query, SQL without the views)
ALL = {
    "read_cells_alias": (
        lambda s, d: bundle.normalise_cells(view(s, d, "v_cells").select(F.when(F.col("cell_idx") % 50 > 0, F.col("cell_id")).otherwise("").alias("cell"), F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), F.col("cell_type").alias("celltype"))),
        "SELECT cell_id, centroid_x, centroid_y, coalesce(cell_type, '') AS cell_type FROM v_cells WHERE cell_idx % 50 > 0",
    ),
    "molecule_qv_filter": (lambda s, d: view(s, d, "v_molecules").where("qv >= 20").groupBy("feature_name").agg(F.count(F.lit(1)).alias("n")), "SELECT feature_name, count(*) AS n FROM v_molecules WHERE qv >= 20 GROUP BY 1"),
    "assigned_flag": (
        lambda s, d: view(s, d, "v_molecules").groupBy(columns.assigned(F.col("cell_id")).alias("assigned")).agg(F.count(F.lit(1)).alias("n")),
        f"SELECT {_ASSIGNED} AS assigned, count(*) AS n FROM v_molecules GROUP BY 1",
    ),
    "crop_counts_union_bbox": (
        _union_bbox,
        """SELECT c.crop_id, count(m.o) AS total, count(m.o) FILTER (WHERE m.cell_id <> 'UNASSIGNED') AS assigned FROM v_crops c LEFT JOIN (
        SELECT cell_id, (SELECT min(crop_ord) FROM v_crops WHERE x_location BETWEEN xmin AND xmax AND y_location BETWEEN ymin AND ymax) AS o FROM v_molecules WHERE qv >= 20) m ON m.o = c.crop_ord GROUP BY c.crop_id""",
    ),
    "crop_counts_halfopen": (
        lambda s, d: spatial.points_in_boxes(view(s, d, "v_molecules"), view(s, d, "v_crops"), "x_location", "y_location", 40.0).where(columns.in_box_halfopen(F.col("x_location"), F.col("y_location"))).groupBy("crop_id").agg(F.count(F.lit(1)).alias("n")),
        "SELECT crop_id, count(*) AS n FROM v_crops JOIN v_molecules ON x_location >= xmin AND x_location < xmax AND y_location >= ymin AND y_location < ymax GROUP BY 1",
    ),
    "decode_cell_id": (
        lambda s, d: view(s, d, "v_cells").select("cell_idx", columns.packed_cell_id(F.col("cell_idx") * 104729, F.col("cell_idx") % 3 + 1).alias("packed")),
        "SELECT cell_idx, concat(translate(lpad(lower(to_hex(cell_idx * 104729)), 8, '0'), '0123456789abcdef', 'abcdefghijklmnop'), '-', cell_idx % 3 + 1) AS packed FROM v_cells",
    ),
    "cells_left_type": (
        lambda s, d: view(s, d, "v_cells").select("cell_id").join(view(s, d, "v_cells").where("cell_idx % 4 > 0 and cell_type is not null").select("cell_id", "cell_type"), "cell_id", "left"),
        "SELECT cell_id, CASE WHEN cell_idx % 4 > 0 THEN cell_type END AS cell_type FROM v_cells",
    ),
    "polygon_vertex_clip": (
        lambda s, d: bundle.read_boundaries(view(s, d, "v_polygons"), (50.0, 150.0, 20.0, 90.0), 2.0).select("cell_id", F.size("ring").alias("n_vertices")),
        "SELECT cell_id, CAST(count(*) AS INTEGER) AS n_vertices FROM v_polygons WHERE vertex_x BETWEEN 48 AND 152 AND vertex_y BETWEEN 18 AND 92 GROUP BY 1 HAVING count(*) >= 3",
    ),
    "polygon_lookup": (
        lambda s, d: view(s, d, "v_polygons").join(view(s, d, "v_cells").where("cell_type = 'BUILDING'").select("cell_id"), "cell_id", "left_semi").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_vertices")),
        "SELECT cell_id, count(*) AS n_vertices FROM v_polygons WHERE cell_id IN (SELECT cell_id FROM v_cells WHERE cell_type = 'BUILDING') GROUP BY 1",
    ),
    "anchor_records": (
        lambda s, d: _r(_anchors(s, d), "cx", "cy"),
        "SELECT cell_id, round(avg(vertex_x), 6) AS cx, round(avg(vertex_y), 6) AS cy, count(*) AS n_cell, CASE WHEN any_value(p.cell_idx) % 3 > 0 THEN 6 ELSE 8 END AS n_nucleus, coalesce(any_value(cell_type), 'unknown') AS cell_type FROM v_polygons p JOIN v_cells USING (cell_id) GROUP BY 1",
    ),
    "unassigned_with_factors": (
        lambda s, d: _r(ops.unassigned_with_factors(view(s, d, "v_molecules"), 20.0).groupBy("feature_name", "gene_factor").agg(F.count(F.lit(1)).alias("n"), F.avg("margin").alias("margin")), "margin"),
        """c AS (SELECT feature_name, factor, count(*) AS n, row_number() OVER (PARTITION BY feature_name ORDER BY count(*) DESC, factor) AS r FROM v_molecules GROUP BY 1, 2), t AS (SELECT a.feature_name, a.factor AS gene_factor, (a.n - coalesce(b.n, 0)) / (a.n + coalesce(b.n, 0) + 1e-12) AS margin FROM c a LEFT JOIN c b ON a.feature_name = b.feature_name AND b.r = 2 WHERE a.r = 1)
        SELECT feature_name, gene_factor, count(*) AS n, round(avg(margin), 6) AS margin FROM v_molecules JOIN t USING (feature_name) WHERE cell_id = 'UNASSIGNED' AND qv >= 20 GROUP BY 1, 2""",
    ),
    "molecule_factors_union": (
        lambda s, d: view(s, d, "v_molecules").where("cell_id <> 'UNASSIGNED'").select("feature_name", "factor", F.lit("cell").alias("kind")).unionByName(ops.unassigned_with_factors(view(s, d, "v_molecules"), 20.0).select("feature_name", F.col("gene_factor").alias("factor"), F.lit("free").alias("kind"))).groupBy("kind", "factor").agg(F.count(F.lit(1)).alias("n")),
        """c AS (SELECT feature_name, factor, row_number() OVER (PARTITION BY feature_name ORDER BY count(*) DESC, factor) AS r FROM v_molecules GROUP BY 1, 2)
        SELECT 'cell' AS kind, factor, count(*) AS n FROM v_molecules WHERE cell_id <> 'UNASSIGNED' GROUP BY 2 UNION ALL SELECT 'free', c.factor, count(*) FROM v_molecules m JOIN c ON c.feature_name = m.feature_name AND r = 1 WHERE cell_id = 'UNASSIGNED' AND qv >= 20 GROUP BY 2""",
    ),
    "transcripts_table": (
        lambda s, d: bundle.transcripts_table(view(s, d, "v_molecules")).groupBy("cell_id", "overlaps_nucleus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("nucleus_distance").cast("double")).alias("distance")),
        f"SELECT CASE WHEN {_ASSIGNED} THEN cell_id ELSE 'UNASSIGNED' END AS cell_id, overlaps_nucleus, count(*) AS n, sum(CASE WHEN overlaps_nucleus = 1 THEN 0e0 ELSE 5e0 END) AS distance FROM v_molecules GROUP BY 1, 2",
    ),
    "polygons_long": (
        lambda s, d: bundle.polygons_long(view(s, d, "v_polygons")).groupBy("cell_id", "label_id").agg(F.count(F.lit(1)).alias("n_vertices")),
        "SELECT cell_id, dense_rank() OVER (ORDER BY cell_idx) AS label_id, n_vertices FROM (SELECT cell_id, cell_idx, count(*) AS n_vertices FROM v_polygons GROUP BY 1, 2)",
    ),
    "cells_table": (
        lambda s, d: bundle.cells_table(view(s, d, "v_cells"), view(s, d, "v_molecules")),
        f"SELECT cell_id, centroid_x AS x_centroid, centroid_y AS y_centroid, coalesce(n, 0) AS transcript_counts, coalesce(n, 0) AS total_counts, cell_area, nucleus_area FROM v_cells LEFT JOIN (SELECT cell_id, count(*) AS n FROM v_molecules WHERE {_ASSIGNED} GROUP BY 1) USING (cell_id)",
    ),
    "ground_truth_cells": (
        lambda s, d: _r(_resolved(s, d), "confidence"),
        f"{_RESOLVED} SELECT cell_id, resolved, source, round(confidence, 6) AS confidence, evidence FROM w",
    ),
    "molecule_provenance": (
        lambda s, d: view(s, d, "v_molecules").withColumn("tile_idx", F.floor(F.col("x_location") / 100) * 1000 + F.floor(F.col("y_location") / 100)).groupBy("tile_idx", (F.col("cell_id") == "UNASSIGNED").alias("is_ghost")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("feature_name").alias("genes")),
        "SELECT CAST(floor(x_location / 100) * 1000 + floor(y_location / 100) AS BIGINT) AS tile_idx, cell_id = 'UNASSIGNED' AS is_ghost, count(*) AS n, count(DISTINCT feature_name) AS genes FROM v_molecules GROUP BY 1, 2",
    ),
    "edge_fit_crops": (
        lambda s, d: ops.crops_within(view(s, d, "v_crops"), _bounds(s, d).selectExpr("xmin - 60 as xmin", "xmax + 60 as xmax", "ymin - 60 as ymin", "ymax + 60 as ymax")).select("crop_id"),
        f"{_BOUNDS} SELECT crop_id FROM v_crops c, b WHERE c.xmin >= b.xmin - 60 AND c.xmax <= b.xmax + 60 AND c.ymin >= b.ymin - 60 AND c.ymax <= b.ymax + 60",
    ),
    "edge_touching": (
        lambda s, d: ops.edge_touching(geometry.polygon_stats(view(s, d, "v_polygons")), _bounds(s, d)).select("cell_id", "touches_edge"),
        f"{_BOUNDS}, {_STATS} SELECT cell_id, cx - sqrt(h + r) < xmin OR cx + sqrt(h + r) > xmax OR cy - sqrt(h + r) < ymin OR cy + sqrt(h + r) > ymax AS touches_edge FROM q, b",
    ),
    "split_checkerboard": (
        lambda s, d: ops.checkerboard(view(s, d, "v_crops")).select("crop_id", "split"),
        "m AS (SELECT quantile_cont((xmin + xmax) / 2, 0.5) AS mx, quantile_cont((ymin + ymax) / 2, 0.5) AS my FROM v_crops) SELECT crop_id, CASE WHEN (ymin + ymax) / 2 < my THEN 'train' WHEN (xmin + xmax) / 2 >= mx THEN 'test' ELSE 'val' END AS split FROM v_crops, m",
    ),
    "split_region_override": (
        lambda s, d: ops.override_splits(view(s, d, "v_crops").withColumn("split", F.lit("train")), s.createDataFrame([(0.0, 100.0, 0.0, 100.0, "val"), (80.0, 160.0, 0.0, 300.0, "test")], "xmin double, xmax double, ymin double, ymax double, region_split string")).select("crop_id", "split"),
        "SELECT crop_id, CASE WHEN (xmin + xmax) / 2 BETWEEN 80 AND 160 AND (ymin + ymax) / 2 BETWEEN 0 AND 300 THEN 'test' WHEN (xmin + xmax) / 2 BETWEEN 0 AND 100 AND (ymin + ymax) / 2 BETWEEN 0 AND 100 THEN 'val' ELSE 'train' END AS split FROM v_crops",
    ),
    "pixel_bounds": (
        lambda s, d: ops.pixel_bounds(view(s, d, "v_crops"), 0.2125),
        "SELECT crop_id, CAST(floor(xmin / 0.2125e0) AS BIGINT) AS x0, CAST(ceil(xmax / 0.2125e0) AS BIGINT) AS x1, CAST(floor(ymin / 0.2125e0) AS BIGINT) AS y0, CAST(ceil(ymax / 0.2125e0) AS BIGINT) AS y1 FROM v_crops",
    ),
    "molecule_pixels": (
        lambda s, d: view(s, d, "v_molecules").groupBy(ops.px(F.col("x_location"), F.lit(0.0), 16.0).alias("px"), ops.px(F.col("y_location"), F.lit(0.0), 16.0).alias("py")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT CAST(round_even(x_location / 16e0, 0) AS INTEGER) AS px, CAST(round_even(y_location / 16e0, 0) AS INTEGER) AS py, count(*) AS n FROM v_molecules GROUP BY 1, 2",
    ),
    "sectioning_distribution": (lambda s, d: _r(_states(s, d), *_STATE), f"{_STATE_SQL} SELECT cell_type, " + ", ".join(f"round(count(*) FILTER (WHERE state = '{v}') / count(*), 6) AS {v}" for v in _STATE) + " FROM q GROUP BY 1"),
    "ridge_object_class": (
        lambda s, d: view(s, d, "v_cells").select("cell_id", columns.ridge_object(F.col("cell_area") - 20, F.col("cell_idx") % 20 + 0.5, F.col("cell_idx") % 9 / F.lit(40.0), F.col("cell_idx") % 11 == 0).alias("kind")),
        "SELECT cell_id, CASE WHEN cell_area - 20 <= 12 THEN 'debris_or_puncta' WHEN cell_idx % 11 = 0 OR cell_idx % 20 + 0.5 <= 3 THEN 'boundary_offset' WHEN cell_idx % 9 / 40e0 > 0.1 THEN 'membrane_only_or_sliver_near_nucleus' WHEN cell_idx % 20 + 0.5 <= 12 THEN 'out_of_plane_membrane' ELSE 'unassigned_membrane_ridge' END AS kind FROM v_cells",
    ),
    "ablate_labels": (
        lambda s, d: ops.ablate(view(s, d, "v_pixels"), view(s, d, "v_pixels").where("label % 5 = 2").select("scene_id", "label")).groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n")),
        "SELECT scene_id, CASE WHEN label % 5 = 2 THEN 0 ELSE label END AS label, count(*) AS n FROM v_pixels GROUP BY 1, 2",
    ),
    "merge_labels": (
        lambda s, d: ops.merge_labels(view(s, d, "v_pixels"), view(s, d, "v_pixels").where("label > 0 and label % 2 = 0").select("scene_id", F.col("label").alias("from"), (F.col("label") - 1).alias("to")).distinct()).groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n")),
        "SELECT scene_id, CASE WHEN label > 0 AND label % 2 = 0 THEN label - 1 ELSE label END AS label, count(*) AS n FROM v_pixels GROUP BY 1, 2",
    ),
    "split_labels": (
        lambda s, d: ops.split_labels(view(s, d, "v_pixels"), geometry.label_centroids(view(s, d, "v_pixels")), 1000).groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n")),
        "c AS (SELECT scene_id, label, avg(x) AS cx FROM v_pixels WHERE label > 0 GROUP BY 1, 2) SELECT p.scene_id, CASE WHEN p.x > cx THEN p.label + 1000 ELSE p.label END AS label, count(*) AS n FROM v_pixels p LEFT JOIN c ON p.scene_id = c.scene_id AND p.label = c.label GROUP BY 1, 2",
    ),
    "scene_edits": (
        lambda s, d: ops.move_cells(view(s, d, "v_cells"), _edits(s, d)),
        """SELECT cell_id, CASE WHEN cell_idx % 10 = 1 THEN 'EDITED' ELSE cell_type END AS cell_type, centroid_x + CASE WHEN cell_idx % 10 = 2 THEN 2.5e0 ELSE 0e0 END AS centroid_x, centroid_y - CASE WHEN cell_idx % 10 = 2 THEN 1.5e0 ELSE 0e0 END AS centroid_y FROM v_cells WHERE cell_idx % 10 > 0
        UNION ALL SELECT concat(cell_id, '_copy'), cell_type, centroid_x + 2.5e0, centroid_y - 1.5e0 FROM v_cells WHERE cell_idx % 10 = 3""",
    ),
    "cross_section_z": (
        lambda s, d: _r(ops.cross_section(view(s, d, "v_z_attrs").withColumns({"t_x": F.col("z_confidence"), "t_z": 1 - F.col("z_confidence")}), 15.0), "tau", "shift_x"),
        "SELECT cell_id, round(sqrt(greatest(0, 1 - power(15 - z_center_um, 2) / power(z_extent_um / 2, 2))), 6) AS tau, round((15 - z_center_um) * z_confidence / greatest(1 - z_confidence, 1e-3), 6) AS shift_x FROM v_z_attrs WHERE abs(15 - z_center_um) < z_extent_um / 2",
    ),
    "type_params_map": (
        lambda s, d: ops.type_params(view(s, d, "v_cells"), {"BUILDING": 2.5, "MACHINERY": 0.5}, 1.0).groupBy("param").agg(F.count(F.lit(1)).alias("n")),
        "SELECT CASE cell_type WHEN 'BUILDING' THEN 2.5e0 WHEN 'MACHINERY' THEN 0.5e0 ELSE 1e0 END AS param, count(*) AS n FROM v_cells GROUP BY 1",
    ),
    "template_bank": (
        lambda s, d: _r(ops.template_bank(view(s, d, "v_polygons"), view(s, d, "v_cells"), view(s, d, "v_cells").where("cell_idx % 3 > 0").select("cell_id", (F.col("cell_idx") % 4).alias("zone"))).withColumn("reach", F.array_max("vertex_x_rel")).drop("vertex_x_rel", "vertex_y_rel"), "centroid_x", "centroid_y", "reach"),
        "SELECT cell_id, round(avg(vertex_x), 6) AS centroid_x, round(avg(vertex_y), 6) AS centroid_y, CAST(count(*) AS INTEGER) AS n_vertices, coalesce(any_value(cell_type), 'unknown') AS cell_type, CASE WHEN any_value(p.cell_idx) % 3 > 0 THEN any_value(p.cell_idx) % 4 ELSE 0 END AS zone, round(max(vertex_x) - avg(vertex_x), 6) AS reach FROM v_polygons p JOIN v_cells USING (cell_id) GROUP BY 1",
    ),
    "stats_join_z": (
        lambda s, d: _r(geometry.polygon_stats(view(s, d, "v_polygons")).join(view(s, d, "v_z_attrs"), "cell_id").select("cell_id", "major", "z_extent_um"), "major"),
        f"{_STATS} SELECT cell_id, round(2 * sqrt(h + r), 6) AS major, z_extent_um FROM q JOIN v_z_attrs USING (cell_id)",
    ),
    "observed_left_z": (
        lambda s, d: view(s, d, "v_cells").join(view(s, d, "v_z_attrs"), "cell_id", "left").select("cell_id", F.coalesce("z_center_um", F.lit(12.0)).alias("z_center_um"), F.coalesce("z_extent_um", F.lit(15.0)).alias("z_extent_um")),
        "SELECT cell_id, coalesce(z_center_um, 12e0) AS z_center_um, coalesce(z_extent_um, 15e0) AS z_extent_um FROM v_cells LEFT JOIN v_z_attrs USING (cell_id)",
    ),
    "owned_molecules_semi": (
        lambda s, d: view(s, d, "v_molecules").join(view(s, d, "v_cells").where("centroid_x < 200").select("cell_id"), "cell_id", "left_semi").groupBy("feature_name").agg(F.count(F.lit(1)).alias("n")),
        "SELECT feature_name, count(*) AS n FROM v_molecules WHERE cell_id IN (SELECT cell_id FROM v_cells WHERE centroid_x < 200) GROUP BY 1",
    ),
    "drop_ghosts_anti": (
        lambda s, d: ops.drop_ghosts(view(s, d, "v_molecules"), view(s, d, "v_cells").where("cell_type is null")).groupBy("feature_name").agg(F.count(F.lit(1)).alias("n")),
        "SELECT feature_name, count(*) AS n FROM v_molecules WHERE cell_id NOT IN (SELECT cell_id FROM v_cells WHERE cell_type IS NULL) GROUP BY 1",
    ),
    "compartment_lookup": (
        lambda s, d: _r(_lookup(s, d), "p"),
        """m AS (SELECT feature_name, cell_type, overlaps_nucleus AS o FROM v_molecules LEFT JOIN v_cells USING (cell_id)), a AS (SELECT feature_name, cell_type, avg(o) AS r FROM m WHERE cell_type IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20), g AS (SELECT feature_name, avg(o) AS r FROM m GROUP BY 1 HAVING count(*) >= 200)
        SELECT m.feature_name, coalesce(m.cell_type, 'none') AS cell_type, count(*) AS n, round(avg(coalesce(a.r, g.r, 0.25)), 6) AS p FROM m LEFT JOIN a ON a.feature_name = m.feature_name AND a.cell_type = m.cell_type LEFT JOIN g ON g.feature_name = m.feature_name GROUP BY 1, 2""",
    ),
    "contract_violations": (
        _violations,
        """SELECT 'type is known' AS rule, count(*) AS n, min(cell_id) AS sample FROM v_cells WHERE cell_type IS NULL UNION ALL SELECT 'nucleus within cell', count(*), min(cell_id) FROM v_cells WHERE nucleus_area > cell_area UNION ALL SELECT 'extent is positive', count(*), min(cell_id) FROM v_z_attrs WHERE z_extent_um <= 0
        UNION ALL SELECT 'z has a cell', count(*), min(cell_id) FROM v_z_attrs WHERE cell_id NOT IN (SELECT cell_id FROM v_cells) UNION ALL SELECT 'cell has z', count(*), min(cell_id) FROM v_cells WHERE cell_id NOT IN (SELECT cell_id FROM v_z_attrs) UNION ALL SELECT 'ring has three corners', count(*), min(cell_id) FROM (SELECT cell_id FROM v_polygons GROUP BY 1 HAVING count(*) < 3)""",
    ),
    "cosine_classify": (
        lambda s, d: _r(_classified(s, d).drop("best_types"), "cosine_top", "uncertainty_margin", "uncertainty"),
        """u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2), l AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1), v AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM u GROUP BY 1),
        k AS (SELECT u.vec_id, c.label, sum(u.x * c.m) / any_value(l.n * v.n) AS cos FROM u JOIN c USING (i) JOIN l ON l.label = c.label JOIN v ON v.vec_id = u.vec_id GROUP BY 1, 2),
        r AS (SELECT *, max(cos) OVER w AS top, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, label) AS r, count(*) OVER w AS t FROM k WINDOW w AS (PARTITION BY vec_id)), e AS (SELECT *, exp(8 * (cos - top)) / sum(exp(8 * (cos - top))) OVER (PARTITION BY vec_id) AS p FROM r)
        SELECT vec_id AS cell_id, concat('t', max(label) FILTER (WHERE r = 1)) AS cell_type, round(any_value(top), 6) AS cosine_top, round(greatest(0, 1 - any_value(top) + max(cos) FILTER (WHERE r = 2)), 6) AS uncertainty_margin,
        round(-sum(p * ln(p + 1e-12)) / ln(any_value(t)) * (1 + greatest(0, least(1, 1 - any_value(top)))), 6) AS uncertainty FROM e GROUP BY 1""",
    ),
    "scale_admixture": (
        lambda s, d: _r(_admixed(s, d).select("cell_type", "factor", "scaled"), "scaled"),
        """f AS (SELECT c.cell_type, c.cell_id, factor, count(*) AS n, sum(count(*)) OVER (PARTITION BY c.cell_id) AS total FROM v_molecules m JOIN v_cells c USING (cell_id) WHERE cell_type IS NOT NULL GROUP BY 1, 2, 3),
        a AS (SELECT cell_type, factor, sum(n / total) / any_value(k) AS a, factor IN (2, 5) AND cell_type <> 'BUILDING' AS bad FROM f JOIN (SELECT cell_type, count(DISTINCT cell_id) AS k FROM f GROUP BY 1) USING (cell_type) GROUP BY 1, 2),
        m AS (SELECT *, coalesce(sum(a) FILTER (WHERE bad) OVER (PARTITION BY cell_type), 0) AS mass, bool_or(bad) OVER (PARTITION BY cell_type) AS has, sum(a) OVER (PARTITION BY cell_type) AS whole FROM a)
        SELECT cell_type, factor, round(CASE WHEN NOT has THEN a WHEN bad THEN a * least(0.95, 2 * mass) / mass ELSE a * (1 - least(0.95, 2 * mass)) / (whole - mass) END, 6) AS scaled FROM m""",
    ),
    "sorted_cells_z": (lambda s, d: view(s, d, "v_z_attrs").orderBy("cell_id"), "SELECT cell_id, z_center_um, z_extent_um, z_confidence FROM v_z_attrs ORDER BY cell_id"),
    "distinct_types": (lambda s, d: view(s, d, "v_cells").agg(F.count_distinct("cell_type").alias("types"), F.count_distinct("cell_id").alias("cells")), "SELECT count(DISTINCT cell_type) AS types, count(DISTINCT cell_id) AS cells FROM v_cells"),
    "upsert_counts": (
        lambda s, d: stats.upsert(view(s, d, "v_z_attrs").select("cell_id", F.lit("old").alias("state")), view(s, d, "v_cells").where("cell_idx % 6 = 0").select("cell_id", F.lit("new").alias("state")), "cell_id").groupBy("state").agg(F.count(F.lit(1)).alias("n")),
        "SELECT state, count(*) AS n FROM (SELECT cell_id, 'new' AS state FROM v_cells WHERE cell_idx % 6 = 0 UNION ALL SELECT cell_id, 'old' FROM v_z_attrs WHERE cell_id NOT IN (SELECT cell_id FROM v_cells WHERE cell_idx % 6 = 0)) GROUP BY 1",
    ),
}
