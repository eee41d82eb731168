"""Queries on tiles, ranks, rules and calibration, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.functions import columns
from cellspan.operators import evidence, ranks, spatial, tiles
from cellspan.operators.quantiles import wide_quantiles
from cellspan.operators.staging import cut
from cellspan.sources.views import view

TIERS = ["annotation", "transcripts", "neighbor", "unresolved"]

_GRID = str([i / 32 for i in range(33)])
_TILES = """m AS (SELECT p.*, tx, ty, tx = floor(x / 60) AND ty = floor(y / 60) AS owned FROM (SELECT cell_id, centroid_x AS x, centroid_y AS y,
 unnest(generate_series(CAST(floor((centroid_x - 80) / 60) AS BIGINT) + 1, CAST(floor(centroid_x / 60) AS BIGINT))) AS tx FROM v_cells) p,
 generate_series(CAST(floor((y - 80) / 60) AS BIGINT) + 1, CAST(floor(y / 60) AS BIGINT)) t(ty))"""
_NEAR = """e AS (SELECT a.cell_idx AS src, b.cell_idx AS dst, (a.centroid_x - b.centroid_x) * (a.centroid_x - b.centroid_x) + (a.centroid_y - b.centroid_y) * (a.centroid_y - b.centroid_y) AS d2
 FROM v_cells a JOIN v_cells b ON a.cell_idx <> b.cell_idx AND b.centroid_x BETWEEN a.centroid_x - 25 AND a.centroid_x + 25 AND b.centroid_y BETWEEN a.centroid_y - 25 AND a.centroid_y + 25)"""
_FRACTIONS = """f AS (SELECT c.cell_type, c.cell_id, factor, count(*) AS n, sum(count(*)) OVER (PARTITION BY c.cell_id) AS total FROM v_molecules m JOIN v_cells c USING (cell_id) WHERE cell_type IS NOT NULL GROUP BY 1, 2, 3)"""
_RULES = """g AS (SELECT factor, feature_name, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY factor) AS share, avg(qv) / 50 AS quality, avg(overlaps_nucleus) AS nuclear FROM v_molecules GROUP BY 1, 2)"""
_CASCADE = f"""{_NEAR}, d AS (SELECT cell_id, first(factor ORDER BY n DESC, factor) AS top, sum(n) AS n FROM (SELECT cell_id, factor, count(*) AS n FROM v_molecules WHERE cell_id <> 'UNASSIGNED' GROUP BY 1, 2) GROUP BY 1),
 k AS (SELECT src, first(b.cell_type ORDER BY d2, dst) AS near FROM e JOIN v_cells b ON dst = b.cell_idx WHERE d2 <= 625 AND b.cell_type IS NOT NULL GROUP BY 1),
 r AS (SELECT cell_idx, CASE WHEN cell_idx % 3 = 0 THEN cell_type END AS a, CASE WHEN cell_idx % 2 = 0 AND d.n >= 5 THEN concat('factor_', top) END AS t, near FROM v_cells c LEFT JOIN d USING (cell_id) LEFT JOIN k ON src = cell_idx),
 w AS (SELECT cell_idx, coalesce(a, t, near) AS resolved, CASE WHEN a IS NOT NULL THEN 'annotation' WHEN t IS NOT NULL THEN 'transcripts' WHEN near IS NOT NULL THEN 'neighbor' ELSE 'unresolved' END AS source FROM r)"""


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _tiled(s: SparkSession, d: str) -> DataFrame:
    return tiles.tile_members(view(s, d, "v_cells"), "centroid_x", "centroid_y", 60.0, 80.0)


def _fractions(s: SparkSession, d: str) -> DataFrame:
    """(cell_type, cell_id, factor, n, share) of typed cells' molecules."""
    typed = view(s, d, "v_cells").where("cell_type is not null").select("cell_id", "cell_type")
    f = view(s, d, "v_molecules").join(typed, "cell_id").groupBy("cell_type", "cell_id", "factor").agg(F.count(F.lit(1)).alias("n"))
    return f.join(f.groupBy("cell_id").agg(F.sum("n").alias("total")), "cell_id").withColumn("share", F.col("n") / F.col("total"))


def _alpha(s: SparkSession, d: str, weighted: bool) -> DataFrame:
    """Mean factor fractions of each type, or their mean over types weighted by cells."""
    f = _fractions(s, d)
    cells = f.groupBy("cell_type").agg(F.count_distinct("cell_id").alias("cells"))
    a = f.groupBy("cell_type", "factor").agg(F.sum("share").alias("share")).join(F.broadcast(cells), "cell_type")  # as many rows as types
    if weighted:
        n = cells.agg(F.sum("cells").alias("all"))
        return a.groupBy("factor").agg(F.sum("share").alias("share")).crossJoin(F.broadcast(n)).select("factor", (F.col("share") / F.col("all")).alias("alpha"))
    return a.select("cell_type", "factor", (F.col("share") / F.col("cells")).alias("alpha"))


def _rules(s: SparkSession, d: str) -> dict[str, DataFrame]:
    m = view(s, d, "v_molecules").groupBy("factor", "feature_name").agg(F.count(F.lit(1)).alias("n"), (F.avg("qv") / 50).alias("quality"), F.avg("overlaps_nucleus").alias("nuclear"))
    m = cut(m, "rates")  # factors times genes rows, from one pass over the molecules
    m = m.join(m.groupBy("factor").agg(F.sum("n").alias("all")), "factor").withColumn("share", F.col("n") / F.col("all"))
    pick = lambda c, low: m.where(F.col(c) >= low).withColumn("strength", F.col(c))
    return {"share": pick("share", 0.04), "quality": pick("quality", 0.51), "nuclear": pick("nuclear", 0.5)}


def _keys(s: SparkSession, d: str, name: str) -> DataFrame:
    return _rules(s, d)[name].select("factor", "feature_name")


def _resolved(s: SparkSession, d: str) -> DataFrame:
    cells, m = view(s, d, "v_cells"), view(s, d, "v_molecules").where("cell_id <> 'UNASSIGNED'")
    n = m.groupBy("cell_id", "factor").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("cell_id").agg(F.max_by("factor", F.struct("n", -F.col("factor"))).alias("top"), F.sum("n").alias("n"))
    near = spatial.knn_join(cells, cells.where("cell_type is not null"), 1, 25.0).select(F.col("src").alias("cell_idx"), F.col("dst"))
    near = near.join(cells.select(F.col("cell_idx").alias("dst"), F.col("cell_type").alias("near")), "dst").drop("dst")
    of = cells.join(top, "cell_id", "left").join(near, "cell_idx", "left")
    transcripts = F.when((F.col("cell_idx") % 2 == 0) & (F.col("n") >= 5), F.concat(F.lit("factor_"), F.col("top").cast("string")))
    type_, source = evidence.cascade({"annotation": F.when(F.col("cell_idx") % 3 == 0, F.col("cell_type")), "transcripts": transcripts, "neighbor": F.col("near")})
    return of.select("cell_idx", type_.alias("resolved"), source.alias("source"))


def _welch(s: SparkSession, d: str) -> DataFrame:
    cells = view(s, d, "v_cells").where("cell_type is not null")
    marked = spatial.radius_join(cells, cells.where("cell_type = 'BUILDING'"), 12.0).select(F.col("src").alias("cell_idx")).distinct().withColumn("near", F.lit(True))
    return evidence.welch(cells.join(marked, "cell_idx", "left").withColumn("near", F.coalesce("near", F.lit(False))), "cell_type", "cell_area", "near")


def _inside(s: SparkSession, d: str) -> DataFrame:
    m = view(s, d, "v_molecules").where("qv >= 20 and cell_id <> 'UNASSIGNED'")
    hit = tiles.points_in_rings(m.select("cell_id", "x_location", "y_location"), view(s, d, "v_polygons"), "cell_id")
    return hit.groupBy("cell_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("inside").alias("inside"))


def _outer(s: SparkSession, d: str) -> DataFrame:
    m = view(s, d, "v_molecules")
    side = lambda f, n: m.where(F.col("factor") == f).groupBy("feature_name").agg(F.count(F.lit(1)).alias(n))
    return side(1, "n_a").join(side(7, "n_b"), "feature_name", "full_outer").na.fill(0, ["n_a", "n_b"])


def _slabs(s: SparkSession, d: str) -> DataFrame:
    z, half = view(s, d, "v_z_attrs").withColumn("slab", F.explode(F.array(*(F.lit(v) for v in range(0, 30, 5))))), F.col("z_extent_um") / 2
    part = columns.overlap(F.col("z_center_um") - half, F.col("z_center_um") + half, F.col("slab").cast("double"), F.col("slab") + 5.0)
    return z.withColumn("part", part).groupBy("slab").agg(F.sum("part").alias("length"), F.count_if(F.col("part") > 0).alias("n_cells"))


def _lut(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "v_pixels")
    lut = wide_quantiles(p, ["scene_id"], {"v": F.col("value")}, {"low": 0.01, "high": 0.998}).select("scene_id", F.col("v_low").alias("low"), F.col("v_high").alias("high"))
    v = columns.lut_normalize(F.col("value"), F.col("low"), F.col("high"))
    return p.join(lut, "scene_id").where("label > 0").groupBy("scene_id", "label").agg(F.avg(v).alias("mean"))


def _scatter(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "v_pixels").where("label > 0 and value > 0").groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.ln("value")).alias("mu"), F.stddev_pop(F.ln("value")).alias("sigma"))
    return p.withColumn("sigma", F.when(F.col("n") < 4, 0.3).otherwise(columns.clip(F.col("sigma"), 0.1, 1.2)))


def _threshold(s: SparkSession, d: str) -> DataFrame:
    n = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("n_chars").alias("score"))
    return ranks.best_f1(s.read.parquet(f"{d}/labels.parquet").join(n, "doc_id").select("score", F.col("quality").cast("long").alias("truth")))


#: name: (query, SQL without the views)
ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "bundle_summary": (
        lambda s, d: _r(view(s, d, "v_cells").agg(F.count(F.lit(1)).alias("n_cells"), F.count("cell_type").alias("n_typed"), *(f(f"centroid_{c}").alias(f"{c}{n}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max")))), "xmin", "xmax", "ymin", "ymax"),
        "SELECT count(*) AS n_cells, count(cell_type) AS n_typed, round(min(centroid_x), 6) AS xmin, round(max(centroid_x), 6) AS xmax, round(min(centroid_y), 6) AS ymin, round(max(centroid_y), 6) AS ymax FROM v_cells",
    ),
    "tile_grid_assign": (lambda s, d: _tiled(s, d).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n")), f"{_TILES} SELECT tx, ty, count(*) AS n FROM m GROUP BY 1, 2"),
    "tile_ownership": (lambda s, d: _tiled(s, d).where("owned").select("cell_id", "tx", "ty"), f"{_TILES} SELECT cell_id, tx, ty FROM m WHERE owned"),
    "halo_membership": (lambda s, d: _tiled(s, d).where("not owned").select("cell_id", "tx", "ty"), f"{_TILES} SELECT cell_id, tx, ty FROM m WHERE NOT owned"),
    "points_in_polygon": (
        _inside,
        """v AS (SELECT p.cell_id, p.vertex_x AS x1, p.vertex_y AS y1, q.vertex_x AS x2, q.vertex_y AS y2 FROM v_polygons p JOIN v_polygons q ON p.cell_id = q.cell_id AND q.vertex_ord = (p.vertex_ord + 1) % 8),
        m AS (SELECT row_number() OVER () AS id, * FROM v_molecules WHERE qv >= 20 AND cell_id <> 'UNASSIGNED'),
        h AS (SELECT id, cell_id, count(*) FILTER (WHERE (y1 > y_location) <> (y2 > y_location) AND x_location < (x2 - x1) / (y2 - y1 + 1e-12) * (y_location - y1) + x1) % 2 = 1 AS hit FROM m JOIN v USING (cell_id) GROUP BY 1, 2)
        SELECT cell_id, count(*) AS total, count(*) FILTER (WHERE hit) AS inside FROM h GROUP BY 1""",
    ),
    "molecule_enriched": (
        lambda s, d: _r(view(s, d, "v_molecules").join(view(s, d, "v_cells").select("cell_id", "cell_type"), "cell_id", "left").groupBy(F.coalesce("cell_type", F.lit("unknown")).alias("cell_type"), "feature_name").agg(F.count(F.lit(1)).alias("n"), F.avg("qv").alias("mean_qv")), "mean_qv"),
        "SELECT coalesce(cell_type, 'unknown') AS cell_type, feature_name, count(*) AS n, round(avg(qv), 6) AS mean_qv FROM v_molecules LEFT JOIN v_cells USING (cell_id) GROUP BY 1, 2",
    ),
    "gene_counts_full_outer": (
        _outer,
        "SELECT feature_name, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM (SELECT feature_name, count(*) AS n_a FROM v_molecules WHERE factor = 1 GROUP BY 1) FULL JOIN (SELECT feature_name, count(*) AS n_b FROM v_molecules WHERE factor = 7 GROUP BY 1) USING (feature_name)",
    ),
    "cells_without_z": (lambda s, d: view(s, d, "v_cells").join(view(s, d, "v_z_attrs"), "cell_id", "left_anti").select("cell_id", "cell_type"), "SELECT cell_id, cell_type FROM v_cells WHERE cell_id NOT IN (SELECT cell_id FROM v_z_attrs)"),
    "radius_pairs": (
        lambda s, d: spatial.radius_join(view(s, d, "v_cells"), view(s, d, "v_cells"), 8.0).groupBy("src").agg(F.count(F.lit(1)).alias("n")),
        f"{_NEAR} SELECT src, count(*) AS n FROM e WHERE d2 <= 64 GROUP BY 1",
    ),
    "local_density": (
        lambda s, d: tiles.bin_density(view(s, d, "v_cells"), "cell_idx", "centroid_x", "centroid_y", 30.0),
        "b AS (SELECT cell_idx, floor(centroid_x / 30) AS gx, floor(centroid_y / 30) AS gy FROM v_cells), g AS (SELECT gx, gy, count(*) AS n FROM b GROUP BY 1, 2) SELECT cell_idx, CAST(sum(n) AS BIGINT) AS density FROM b JOIN g ON g.gx BETWEEN b.gx - 1 AND b.gx + 1 AND g.gy BETWEEN b.gy - 1 AND b.gy + 1 GROUP BY 1",
    ),
    "window_candidates": (
        lambda s, d: _r(tiles.windows(view(s, d, "v_cells"), 100.0, 25), "top_share"),
        """m AS (SELECT cell_type, tx, ty FROM (SELECT *, unnest(generate_series(CAST(floor((centroid_x - 100) / 50) AS BIGINT) + 1, CAST(floor(centroid_x / 50) AS BIGINT))) AS tx FROM v_cells) c, generate_series(CAST(floor((centroid_y - 100) / 50) AS BIGINT) + 1, CAST(floor(centroid_y / 50) AS BIGINT)) t(ty)),
        n AS (SELECT tx, ty, cell_type, count(*) AS n FROM m GROUP BY 1, 2, 3) SELECT tx, ty, CAST(sum(n) AS BIGINT) AS n_cells, round(coalesce(max(n) FILTER (WHERE cell_type IS NOT NULL), 0) / sum(n), 6) AS top_share FROM n GROUP BY 1, 2 HAVING sum(n) >= 25""",
    ),
    "per_type_alpha": (lambda s, d: _r(_alpha(s, d, False), "alpha"), f"{_FRACTIONS} SELECT cell_type, factor, round(sum(n / total) / any_value(cells), 6) AS alpha FROM f JOIN (SELECT cell_type, count(DISTINCT cell_id) AS cells FROM f GROUP BY 1) USING (cell_type) GROUP BY 1, 2"),
    "default_alpha": (lambda s, d: _r(_alpha(s, d, True), "alpha"), f"{_FRACTIONS} SELECT factor, round(sum(n / total) / (SELECT count(DISTINCT cell_id) FROM f), 6) AS alpha FROM f GROUP BY 1"),
    "display_lut": (
        lambda s, d: _r(_lut(s, d), "mean"),
        "l AS (SELECT scene_id, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.998) AS high FROM v_pixels GROUP BY 1) SELECT scene_id, label, round(avg(greatest(0, least(1, (value - low) / CASE WHEN high > low THEN high - low ELSE 1 END))), 6) AS mean FROM v_pixels JOIN l USING (scene_id) WHERE label > 0 GROUP BY 1, 2",
    ),
    "intensity_scatter": (
        lambda s, d: _r(_scatter(s, d), "mu", "sigma"),
        "SELECT scene_id, label, count(*) AS n, round(avg(ln(value)), 6) AS mu, round(CASE WHEN count(*) < 4 THEN 0.3e0 ELSE greatest(0.1e0, least(1.2e0, stddev_pop(ln(value)))) END, 6) AS sigma FROM v_pixels WHERE label > 0 AND value > 0 GROUP BY 1, 2",
    ),
    "top2_margin": (
        lambda s, d: _r(ranks.top2_margin(view(s, d, "v_molecules").groupBy("feature_name", "factor").agg(F.count(F.lit(1)).alias("n")), "feature_name", "factor"), "margin"),
        """n AS (SELECT feature_name, factor, count(*) AS n, row_number() OVER (PARTITION BY feature_name ORDER BY count(*) DESC, factor) AS r FROM v_molecules GROUP BY 1, 2)
        SELECT a.feature_name, a.factor AS first, b.factor AS second, round((a.n - coalesce(b.n, 0)) / (a.n + coalesce(b.n, 0) + 1e-12), 6) AS margin FROM n a LEFT JOIN n b ON a.feature_name = b.feature_name AND b.r = 2 WHERE a.r = 1""",
    ),
    "uniform_rank": (
        lambda s, d: _r(ranks.uniform_rank(view(s, d, "v_cells").where("cell_type is not null"), "cell_type", "cell_area", "cell_idx"), "rank"),
        "SELECT cell_idx, cell_type, round((row_number() OVER (PARTITION BY cell_type ORDER BY cell_area, cell_idx) - 1) / greatest(count(*) OVER (PARTITION BY cell_type) - 1, 1), 6) AS rank FROM v_cells WHERE cell_type IS NOT NULL",
    ),
    "cdf_histogram": (
        lambda s, d: _r(ranks.cumulative_histogram(view(s, d, "v_pixels"), "scene_id", "value", 16), "cdf"),
        "SELECT scene_id, bin, n, round(sum(n) OVER (PARTITION BY scene_id ORDER BY bin) / sum(n) OVER (PARTITION BY scene_id), 6) AS cdf FROM (SELECT scene_id, CAST(least(floor(value * 16), 15) AS INTEGER) AS bin, count(*) AS n FROM v_pixels GROUP BY 1, 2)",
    ),
    "f1_threshold": (
        lambda s, d: _r(_threshold(s, d), "f1"),
        """j AS (SELECT n_chars AS score, quality AS truth FROM labels JOIN documents USING (doc_id)), r AS (SELECT a.score, 2 * sum(b.truth) / (count(*) + (SELECT sum(truth) FROM j)) AS f1 FROM (SELECT DISTINCT score FROM j) a JOIN j b ON b.score >= a.score GROUP BY 1)
        SELECT score AS threshold, round(f1, 6) AS f1 FROM r ORDER BY r.f1 DESC, score DESC LIMIT 1""",
    ),
    "ordered_split": (
        lambda s, d: ranks.ordered_split(view(s, d, "v_cells").where("cell_type is not null"), "cell_type", ["centroid_x", "cell_idx"]).select("cell_idx", "split"),
        """SELECT cell_idx, CASE WHEN l < h THEN 'test' WHEN l < 2 * h THEN 'val' ELSE 'train' END AS split FROM (SELECT cell_idx, count(*) OVER w - row_number() OVER (PARTITION BY cell_type ORDER BY centroid_x, cell_idx) AS l, greatest(1, round_even(count(*) OVER w * 0.15e0, 0)) AS h FROM v_cells WHERE cell_type IS NOT NULL WINDOW w AS (PARTITION BY cell_type))""",
    ),
    "spread_crops": (
        lambda s, d: ranks.spread_picks(view(s, d, "v_cells").where("cell_type is not null"), "cell_type", ["centroid_x", "centroid_y", "cell_id"], 4).select("cell_type", "cell_id"),
        "SELECT cell_type, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY centroid_x, centroid_y, cell_id) - 1 AS i, count(*) OVER (PARTITION BY cell_type) - 1 AS last FROM v_cells WHERE cell_type IS NOT NULL) WHERE i IN (0, round_even(last / 3, 0), round_even(2 * last / 3, 0), last)",
    ),
    "compact_labels": (lambda s, d: ranks.compact_labels(view(s, d, "v_pixels")), "SELECT DISTINCT scene_id, label, CAST(dense_rank() OVER (PARTITION BY scene_id ORDER BY label) AS INTEGER) AS compact FROM v_pixels WHERE label > 0"),
    "local_maxima": (
        lambda s, d: ranks.local_maxima(view(s, d, "v_pixels"), 1).select("scene_id", "y", "x"),
        "SELECT a.scene_id, a.y, a.x FROM v_pixels a JOIN v_pixels b ON a.scene_id = b.scene_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.scene_id, a.y, a.x, a.value HAVING a.value = max(b.value)",
    ),
    "label_overlap": (
        lambda s, d: _r(tiles.label_overlap(view(s, d, "v_pixels").where("scene_id = 0"), view(s, d, "v_pixels").where("scene_id = 1")), "iou"),
        """p AS (SELECT a.label AS la, b.label AS lb, count(*) AS n FROM v_pixels a JOIN v_pixels b ON a.y = b.y AND a.x = b.x AND a.scene_id = 0 AND b.scene_id = 1 WHERE a.label > 0 AND b.label > 0 GROUP BY 1, 2),
        s AS (SELECT scene_id, label, count(*) AS n FROM v_pixels GROUP BY 1, 2), i AS (SELECT la, lb, p.n / (s.n + t.n - p.n) AS iou FROM p JOIN s ON s.scene_id = 0 AND s.label = la JOIN s t ON t.scene_id = 1 AND t.label = lb)
        SELECT la, lb, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY la ORDER BY iou DESC, lb) AS r FROM i) WHERE r = 1""",
    ),
    "consensus_rules": (
        lambda s, d: _r(evidence.consensus(_rules(s, d), ["factor", "feature_name"]), "score"),
        f"""{_RULES}, u AS (SELECT factor, feature_name, 'share' AS m, share AS v FROM g WHERE share >= 0.04e0 UNION ALL SELECT factor, feature_name, 'quality', quality FROM g WHERE quality >= 0.51e0 UNION ALL SELECT factor, feature_name, 'nuclear', nuclear FROM g WHERE nuclear >= 0.5e0)
        SELECT factor, feature_name, bool_or(m = 'share') AS by_share, bool_or(m = 'quality') AS by_quality, bool_or(m = 'nuclear') AS by_nuclear, count(*) AS n_methods, round(exp(avg(ln(v))), 6) AS score, CASE count(*) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS tier FROM u GROUP BY 1, 2""",
    ),
    "rule_intersect": (lambda s, d: _keys(s, d, "share").intersect(_keys(s, d, "nuclear")), f"{_RULES} SELECT factor, feature_name FROM g WHERE share >= 0.04e0 AND nuclear >= 0.5e0"),
    "rule_except": (lambda s, d: _keys(s, d, "share").exceptAll(_keys(s, d, "nuclear")), f"{_RULES} SELECT factor, feature_name FROM g WHERE share >= 0.04e0 AND nuclear < 0.5e0"),
    "rule_union_distinct": (lambda s, d: _keys(s, d, "share").union(_keys(s, d, "nuclear")).distinct(), f"{_RULES} SELECT factor, feature_name FROM g WHERE share >= 0.04e0 OR nuclear >= 0.5e0"),
    "welch_stats": (
        lambda s, d: _r(_welch(s, d), "t", "df"),
        f"""{_NEAR}, b AS (SELECT DISTINCT src FROM e JOIN v_cells ON dst = cell_idx WHERE d2 <= 144 AND cell_type = 'BUILDING'), c AS (SELECT cell_type, cell_area AS a, src IS NOT NULL AS near FROM v_cells LEFT JOIN b ON src = cell_idx WHERE cell_type IS NOT NULL),
        q AS (SELECT cell_type, count(*) FILTER (WHERE near) AS n1, count(*) FILTER (WHERE NOT near) AS n0, avg(a) FILTER (WHERE near) - avg(a) FILTER (WHERE NOT near) AS dm, var_samp(a) FILTER (WHERE near) AS v1, var_samp(a) FILTER (WHERE NOT near) AS v0 FROM c GROUP BY 1)
        SELECT cell_type, n1 AS n_with, n0 AS n_without, round(dm / sqrt(v1 / n1 + v0 / n0), 6) AS t, round((v1 / n1 + v0 / n0) * (v1 / n1 + v0 / n0) / (v1 / n1 * v1 / n1 / (n1 - 1) + v0 / n0 * v0 / n0 / (n0 - 1)), 6) AS df FROM q WHERE n1 > 1 AND n0 > 1 AND v1 + v0 > 0""",
    ),
    "type_cascade": (_resolved, f"{_CASCADE} SELECT cell_idx, resolved, source FROM w"),
    "type_source_pivot": (
        lambda s, d: _resolved(s, d).groupBy(F.coalesce("resolved", F.lit("none")).alias("resolved")).pivot("source", TIERS).count().na.fill(0),
        f"{_CASCADE} SELECT coalesce(resolved, 'none') AS resolved, " + ", ".join(f"count(*) FILTER (WHERE source = '{t}') AS {t}" for t in TIERS) + " FROM w GROUP BY 1",
    ),
    "slab_projection": (
        lambda s, d: _r(_slabs(s, d), "length"),
        "p AS (SELECT CAST(slab AS INTEGER) AS slab, greatest(0, least(z_center_um + z_extent_um / 2, slab + 5) - greatest(z_center_um - z_extent_um / 2, slab)) AS part FROM v_z_attrs, generate_series(0, 25, 5) t(slab)) SELECT slab, round(sum(part), 6) AS length, count(*) FILTER (WHERE part > 0) AS n_cells FROM p GROUP BY 1",
    ),
    "z_tilt": (
        lambda s, d: _r(view(s, d, "v_z_attrs").select("cell_id", columns.tilt_z(F.col("z_extent_um")).alias("tilt")), "tilt"),
        "SELECT cell_id, round(greatest(0.1e0, least(1e0, z_extent_um / (7.2e0 * power(390e0 / (14.4e0 * pi()), 1e0 / 3)))), 6) AS tilt FROM v_z_attrs",
    ),
    "compartment_posterior": (
        lambda s, d: _r(evidence.shrunk_rates(view(s, d, "v_molecules").join(view(s, d, "v_cells").select("cell_id", "cell_type"), "cell_id", "left"), 50.0, 20), "rate"),
        """n AS (SELECT feature_name, cell_type, count(*) AS n, sum(overlaps_nucleus) AS k FROM v_molecules LEFT JOIN v_cells USING (cell_id) GROUP BY 1, 2), g AS (SELECT feature_name, sum(k) / sum(n) AS r FROM n GROUP BY 1)
        SELECT feature_name, cell_type, n, round((k + 50 * r) / (n + 50), 6) AS rate FROM n JOIN g USING (feature_name) WHERE n >= 20 AND cell_type IS NOT NULL""",
    ),
    "feature_l2": (
        lambda s, d: _r(evidence.mean_distance(s.read.parquet(f"{d}/embeddings.parquet"), "label", "embedding"), "distance"),
        """u AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), a AS (SELECT i, avg(x) AS m FROM u GROUP BY 1), l AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2)
        SELECT label, round(sqrt(sum((l.m - a.m) * (l.m - a.m))), 6) AS distance FROM l JOIN a USING (i) GROUP BY 1""",
    ),
    "wasserstein_quantile": (
        lambda s, d: _r(evidence.quantile_distance(view(s, d, "v_cells").where("cell_type is not null"), "cell_type", "cell_area", 33), "distance"),
        f"q AS (SELECT quantile_cont(cell_area, {_GRID}) AS w FROM v_cells WHERE cell_type IS NOT NULL) SELECT cell_type, round(list_avg([abs(o[i] - w[i]) FOR i IN range(1, 34)]), 6) AS distance FROM (SELECT cell_type, quantile_cont(cell_area, {_GRID}) AS o FROM v_cells WHERE cell_type IS NOT NULL GROUP BY 1), q",
    ),
    "radial_ridge": (
        lambda s, d: _r(view(s, d, "v_pixels").where("label > 0").groupBy("scene_id").agg(*(f(F.ln(F.col("value") + 0.01), F.pow(F.col("x") - 12.0, 2) + F.pow(F.col("y") - 12.0, 2)).alias(n) for f, n in ((F.regr_slope, "slope"), (F.regr_intercept, "intercept")))), "slope", "intercept"),
        "SELECT scene_id, " + ", ".join(f"round(regr_{n}(ln(value + 0.01e0), (x - 12) * (x - 12) + (y - 12) * (y - 12)), 6) AS {n}" for n in ("slope", "intercept")) + " FROM v_pixels WHERE label > 0 GROUP BY 1",
    ),
    "area_histogram": (
        lambda s, d: view(s, d, "v_cells").groupBy("cell_type", F.width_bucket("cell_area", F.lit(0.0), F.lit(120.0), F.lit(12)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT cell_type, CAST(floor(cell_area / 10) + 1 AS BIGINT) AS bucket, count(*) AS n FROM v_cells GROUP BY 1, 2",
    ),
}
