"""Queries on statistics of types, pixels, depths and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.functions import columns
from cellspan.operators import cells as cell_ops
from cellspan.operators import evidence, geometry, spatial
from cellspan.operators import measures as ops
from cellspan.plans.analysis import _FRACTIONS, _NEAR, _alpha, _fractions, _rules
from cellspan.plans.analysis import _RULES as _RULE_SQL
from cellspan.plans.tables import _BOUNDS, _STATS, _bounds
from cellspan.operators.quantiles import quantile_table, wide_quantiles
from cellspan.sources.views import view


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_TYPE = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]  # the views' types, by label % 5
_TYPED = "t AS (SELECT DISTINCT label, CASE label % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPE)) + " END AS cell_type FROM v_pixels WHERE label > 0)"
_ALPHA = f"{_FRACTIONS}, a AS (SELECT cell_type, factor, sum(n / total) / any_value(cells) AS alpha FROM f JOIN (SELECT cell_type, count(DISTINCT cell_id) AS cells FROM f GROUP BY 1) USING (cell_type) GROUP BY 1, 2)"


def _types(s: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _TYPE)), (F.col("label") % 5 + 1).cast("int"))
    return view(s, d, "v_pixels").where("label > 0").select("label", name.alias("cell_type")).distinct()


def _stats(s: SparkSession, d: str) -> DataFrame:
    p = cell_ops.edge_touching(geometry.polygon_stats(view(s, d, "v_polygons")), _bounds(s, d))
    return p.withColumn("ratio", F.col("major") / F.col("minor")).join(view(s, d, "v_cells").select("cell_id", "cell_type"), "cell_id")


def _zs(s: SparkSession, d: str) -> DataFrame:
    z = view(s, d, "v_z_attrs").join(view(s, d, "v_cells").where("cell_type is not null").select("cell_id", "cell_type"), "cell_id")
    wide = wide_quantiles(z, ["cell_type"], {"extent": F.col("z_extent_um"), "center": F.col("z_center_um")}, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return wide.withColumnRenamed("extent_n", "n").drop("center_n")


def _samples(s: SparkSession, d: str) -> DataFrame:
    m = view(s, d, "v_molecules").where("cell_id <> 'UNASSIGNED'").join(view(s, d, "v_cells").where("cell_type is not null").select("cell_id", "cell_type"), "cell_id")
    return m.select("cell_type", F.col("cell_id").alias("cell"), F.col("nucleus_distance").alias("distance"), (F.col("qv") / 50 * F.exp(-F.col("nucleus_distance") / 4) + 0.05).alias("value"))


def _welch_rules(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "v_cells").where("cell_type is not null")
    marked = spatial.radius_join(c, c.where("cell_type = 'BUILDING'"), 12.0).select(F.col("src").alias("cell_idx")).distinct().withColumn("near", F.lit(True))
    rows = c.where("cell_type <> 'BUILDING'").join(marked, "cell_idx", "left").withColumn("near", F.coalesce("near", F.lit(False))).withColumn("v", F.col("cell_area") + F.when(F.col("near"), 12.0).otherwise(0.0))
    delta = rows.groupBy("cell_type").agg((F.avg(F.when(F.col("near"), F.col("v"))) - F.avg(F.when(~F.col("near"), F.col("v")))).alias("delta"))
    t = evidence.welch(rows, "cell_type", "v", "near").join(delta, "cell_type")
    return ops.welch_rules(t, 2 * columns.normal_tail(F.abs("t")), 5, 0.005, 0.2).select("cell_type", "n_with", "n_without", "t", "delta")


def _profiles(s: SparkSession, d: str) -> DataFrame:
    """A value per label and plane: pixels of the five scenes as planes."""
    return view(s, d, "v_pixels").where("label > 0").groupBy("label", F.col("scene_id").alias("z")).agg((F.avg("value") * 10).alias("v"))


def _roundtrip(s: SparkSession, d: str) -> DataFrame:
    rules, key = _rules(s, d), ["factor", "feature_name"]
    return ops.roundtrip(rules["share"], rules["nuclear"].select(*key), key).select(*key, "detected", "strength", "other_rules")


def _calibrated(s: SparkSession, d: str) -> DataFrame:
    rules, key = _rules(s, d), ["factor", "feature_name"]
    truth = rules["share"].join(rules["nuclear"].select(*key), key, "left_semi").select(*key)
    return ops.f1_calibration(rules["quality"], truth, key)


def _target(s: SparkSession, d: str, points: int) -> DataFrame:
    t = quantile_table(view(s, d, "v_pixels").where("label > 0"), ["scene_id"], {"v": F.col("value") * 2}, [i / (points - 1) for i in range(points)])
    return t.select("scene_id", F.rint(F.col("q") * (points - 1)).cast("int").alias("q"), F.col("value").alias("t"))


def _flags(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "v_cells")
    return c.select((F.col("cell_idx") % 3 == 0).alias("a"), (F.col("cell_idx") % 4 < 2).alias("b"), (F.col("cell_area") > 70).alias("c"), ((F.col("cell_idx") % 3 == 0) & (F.col("cell_idx") % 8 < 5)).alias("truth"))


def _matches(s: SparkSession, d: str) -> DataFrame:
    """The best overlap of each scene's labels with those of the next scene, all scenes."""
    p = view(s, d, "v_pixels").where("label > 0")
    a, b = p.select("scene_id", "y", "x", F.col("label").alias("la")), p.select((F.col("scene_id") - 1).alias("scene_id"), "y", "x", F.col("label").alias("lb"))
    n = a.join(b, ["scene_id", "y", "x"]).groupBy("scene_id", "la", "lb").agg(F.count(F.lit(1)).alias("both"))
    n = n.join(a.groupBy("scene_id", "la").agg(F.count(F.lit(1)).alias("na")), ["scene_id", "la"]).join(b.groupBy("scene_id", "lb").agg(F.count(F.lit(1)).alias("nb")), ["scene_id", "lb"])
    return n.withColumn("iou", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).groupBy("scene_id", "la").agg(F.max_by(F.struct("lb", "iou"), F.struct("iou", -F.col("lb"))).alias("m")).select("scene_id", "la", "m.lb", "m.iou")


_MATCH = """p AS (SELECT a.scene_id, a.label AS la, b.label AS lb, count(*) AS n FROM v_pixels a JOIN v_pixels b ON a.scene_id = b.scene_id - 1 AND a.y = b.y AND a.x = b.x WHERE a.label > 0 AND b.label > 0 GROUP BY 1, 2, 3), z AS (SELECT scene_id, label, count(*) AS n FROM v_pixels WHERE label > 0 GROUP BY 1, 2),
 i AS (SELECT p.scene_id, la, lb, p.n / (s.n + t.n - p.n) AS iou FROM p JOIN z s ON s.scene_id = p.scene_id AND s.label = la JOIN z t ON t.scene_id = p.scene_id + 1 AND t.label = lb), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, la ORDER BY iou DESC, lb) AS r FROM i) WHERE r = 1)"""


def _summary(s: SparkSession, d: str) -> DataFrame:
    n = lambda c: view(s, d, "v_pixels").where(f"label > 0 and {c}").select("scene_id", "label").distinct().agg(F.count(F.lit(1)).alias("n"))
    return ops.match_summary(_matches(s, d), n("scene_id < 4"), n("scene_id > 0"))


def _trials(s: SparkSession, d: str) -> DataFrame:
    m = _matches(s, d).join(_types(s, d).withColumnRenamed("label", "la"), "la").withColumn("size", F.element_at(F.array(*map(F.lit, (1, 4, 12))), (F.col("scene_id") % 3 + 1).cast("int")))
    return m.groupBy("size", "cell_type").agg(F.sum("iou").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("iou") >= 0.5).alias("hits"))


def _rollup(s: SparkSession, d: str) -> DataFrame:
    t = _trials(s, d)
    side = lambda c, k: t.groupBy(F.col(c).cast("string").alias("key")).agg(F.lit(k).alias("by"), F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean_iou"), (F.sum("hits") / F.sum("n")).alias("recall"))
    return side("size", "size").unionByName(side("cell_type", "type"))


def _breakdown(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "v_cells").select("cell_id", F.coalesce("cell_type", F.lit("unknown")).alias("cell_type"))
    n = view(s, d, "v_molecules").where("qv >= 20").join(c, "cell_id").groupBy("cell_type").agg(F.count(F.lit(1)).alias("molecules"))
    return c.groupBy("cell_type").agg(F.count(F.lit(1)).alias("cells")).join(n, "cell_type", "left").select("cell_type", "cells", F.coalesce("molecules", F.lit(0)).alias("molecules"), (F.coalesce("molecules", F.lit(0)) / F.col("cells")).alias("per_cell"))


def _histograms(s: SparkSession, d: str) -> DataFrame:
    """Per-cell molecule counts in 60 logarithmic bins up to their 99th percentile."""
    n = view(s, d, "v_molecules").where("cell_id <> 'UNASSIGNED'").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    top = quantile_table(n, [], {"n": F.col("n")}, [0.99]).agg(F.ln(F.max("value") + 1).alias("top"))
    b = F.least(F.floor(F.ln(F.col("n") + 1) / F.col("top") * 60), F.lit(60)).alias("bin")
    return n.crossJoin(F.broadcast(top)).groupBy(b).agg(F.count(F.lit(1)).alias("cells"))  # one row


ALL = {
    "quantile_targets": (
        lambda s, d: _r(ops.quantile_targets(_stats(s, d), ["area", "ratio"], [0.1, 0.5, 0.9], 20), *(f"{v}_p{q}" for v in ("area", "ratio") for q in (10, 50, 90))),
        f"""{_BOUNDS}, {_STATS}, w AS (SELECT cell_id, abs(sum(vertex_x * ny - nx * vertex_y)) / 2 AS area FROM (SELECT *, coalesce(lead(vertex_x) OVER w, first_value(vertex_x) OVER w) AS nx, coalesce(lead(vertex_y) OVER w, first_value(vertex_y) OVER w) AS ny FROM v_polygons WINDOW w AS (PARTITION BY cell_id ORDER BY vertex_ord)) GROUP BY 1),
        e AS (SELECT cell_type, area, 2 * sqrt(h + r) / (2 * sqrt(greatest(h - r, 1e-12))) AS ratio FROM q JOIN w USING (cell_id) JOIN v_cells USING (cell_id), b WHERE cell_type IS NOT NULL AND NOT (cx - sqrt(h + r) < xmin OR cx + sqrt(h + r) > xmax OR cy - sqrt(h + r) < ymin OR cy + sqrt(h + r) > ymax))
        SELECT cell_type, count(*) AS n, """ + ", ".join(f"round(quantile_cont({v}, {q}), 6) AS {v}_p{int(q * 100)}" for v in ("area", "ratio") for q in (0.1, 0.5, 0.9)) + " FROM e GROUP BY 1 HAVING count(*) >= 20",
    ),
    "type_z_summary": (
        lambda s, d: _r(_zs(s, d), *(f"{k}_p{q}" for k in ("extent", "center") for q in (10, 50, 90))),
        "SELECT cell_type, count(*) AS n, " + ", ".join(f"round(quantile_cont(z_{k}_um, {q}), 6) AS {k}_p{int(q * 100)}" for k in ("extent", "center") for q in (0.1, 0.5, 0.9)) + " FROM v_z_attrs JOIN v_cells USING (cell_id) WHERE cell_type IS NOT NULL GROUP BY 1",
    ),
    "admix_rate": (
        lambda s, d: _r(ops.admixture_rate(_alpha(s, d, False), s.createDataFrame([(2, "BUILDING"), (5, "BUILDING"), (3, "MACHINERY")], "factor int, target string")), "rate"),
        f"{_ALPHA} SELECT cell_type, round(sum(CASE WHEN (cell_type = 'BUILDING' AND factor IN (2, 5)) OR (cell_type = 'MACHINERY' AND factor = 3) THEN alpha ELSE 0 END), 6) AS rate FROM a GROUP BY 1",
    ),
    "typical_area": (
        lambda s, d: _r(ops.typical_area(view(s, d, "v_pixels"), 25, 0.5), "area"),
        "n AS (SELECT scene_id, label, count(*) * 0.25e0 AS area, bool_or(y IN (0, 24) OR x IN (0, 24)) AS border FROM v_pixels WHERE label > 0 GROUP BY 1, 2) SELECT label, round(coalesce(quantile_cont(area, 0.5) FILTER (WHERE NOT border), (SELECT quantile_cont(area, 0.5) FROM n WHERE NOT border)), 6) AS area FROM n GROUP BY 1",
    ),
    "tile_alpha": (
        lambda s, d: _r(ops.tile_alpha(_fractions(s, d), view(s, d, "v_cells").select("cell_id", F.floor(F.col("centroid_x") / 100).alias("tile")), _alpha(s, d, False)), "alpha"),
        f"{_ALPHA}, c AS (SELECT DISTINCT f.cell_id, f.cell_type, CAST(floor(centroid_x / 100) AS BIGINT) AS tile FROM f JOIN v_cells v ON v.cell_id = f.cell_id), n AS (SELECT tile, cell_type, count(*) AS n FROM c GROUP BY 1, 2), o AS (SELECT tile, f.cell_type, factor, sum(n / total) AS share FROM f JOIN c ON c.cell_id = f.cell_id GROUP BY 1, 2, 3) SELECT n.tile, n.cell_type, a.factor, round(0.7 * coalesce(share, 0) / n + 0.3 * alpha, 6) AS alpha FROM n JOIN a USING (cell_type) LEFT JOIN o ON o.tile = n.tile AND o.cell_type = n.cell_type AND o.factor = a.factor",
    ),
    "channel_means": (
        lambda s, d: _r(ops.channel_means(view(s, d, "v_pixels"), _types(s, d), 22), "mean"),
        f"{_TYPED}, c AS (SELECT scene_id, label, avg(value) AS m FROM v_pixels WHERE label > 0 GROUP BY 1, 2 HAVING count(*) >= 22) SELECT t.cell_type, round(coalesce(avg(m), (SELECT avg(m) FROM c)), 6) AS mean FROM t LEFT JOIN c USING (label) GROUP BY 1",
    ),
    "render_mean_calibration": (
        lambda s, d: _r(ops.render_ratio(*(view(s, d, "v_pixels").where(f"label > 0 and scene_id {c}").groupBy("scene_id", "label").agg((F.avg("value") * k).alias("m")).join(_types(s, d), "label") for c, k in (("< 3", 1.0), (">= 3", 0.45))), 3), "ratio"),
        f"{_TYPED}, c AS (SELECT scene_id, label, avg(value) AS m FROM v_pixels WHERE label > 0 GROUP BY 1, 2), e AS (SELECT cell_type, avg(m) FILTER (WHERE scene_id < 3) AS m1, avg(m * 0.45) FILTER (WHERE scene_id >= 3) AS m2, count(*) FILTER (WHERE scene_id < 3) AS n1, count(*) FILTER (WHERE scene_id >= 3) AS n2 FROM c JOIN t USING (label) GROUP BY 1) SELECT cell_type, round(CASE WHEN n1 >= 3 AND n2 >= 3 THEN greatest(0.5, least(2.5, m1 / m2)) ELSE 1 END, 6) AS ratio FROM e",
    ),
    "type_efficiencies": (
        lambda s, d: _r(ops.relative_efficiency(view(s, d, "v_cells").where("cell_type is not null"), "cell_type", "nucleus_area"), "efficiency", "log_mean", "log_std"),
        "SELECT cell_type, round(greatest(0.25, least(4, quantile_cont(nucleus_area, 0.5) / (SELECT quantile_cont(nucleus_area, 0.5) FROM v_cells WHERE cell_type IS NOT NULL))), 6) AS efficiency, round(avg(ln(nucleus_area)), 6) AS log_mean, round(stddev_pop(ln(nucleus_area)), 6) AS log_std FROM v_cells WHERE cell_type IS NOT NULL GROUP BY 1",
    ),
    "crop_stats": (
        lambda s, d: _r(view(s, d, "v_pixels").groupBy("scene_id").agg(*(f(F.when(c, F.col("value"))).alias(k) for k, f, c in (("cell_mean", F.avg, F.col("label") > 0), ("cell_std", F.stddev_pop, F.col("label") > 0), ("nucleus_mean", F.avg, F.col("nucleus") == 1), ("background_mean", F.avg, F.col("label") == 0)))), "cell_mean", "cell_std", "nucleus_mean", "background_mean"),
        "SELECT scene_id, round(avg(value) FILTER (WHERE label > 0), 6) AS cell_mean, round(stddev_pop(value) FILTER (WHERE label > 0), 6) AS cell_std, round(avg(value) FILTER (WHERE nucleus = 1), 6) AS nucleus_mean, round(avg(value) FILTER (WHERE label = 0), 6) AS background_mean FROM v_pixels GROUP BY 1",
    ),
    "ridge_ols": (
        lambda s, d: _r(ops.ridge_fit(_samples(s, d), [0, 1, 2, 3, 4, 5, 6], 0.04, 8), "amplitude", "width"),
        """z AS (SELECT cell_type, cell_id, nucleus_distance AS d, qv / 50 * exp(-nucleus_distance / 4) + 0.05 AS v FROM v_molecules JOIN v_cells USING (cell_id) WHERE cell_type IS NOT NULL), e AS (SELECT cell_type, floor(d) + 0.5e0 AS c, quantile_cont(v, 0.5) - 0.04e0 AS x FROM z WHERE d < 6 GROUP BY 1, 2),
        g AS (SELECT cell_type, count(*) AS n, regr_slope(ln(x), c * c) AS b, regr_intercept(ln(x), c * c) AS a FROM e WHERE x > 1e-4 GROUP BY 1) SELECT cell_type, round(least(2, exp(a)), 6) AS amplitude, round(greatest(0.5, least(20, sqrt(-1 / (2 * b)))), 6) AS width FROM g JOIN (SELECT cell_type FROM z GROUP BY 1 HAVING count(DISTINCT cell_id) >= 8) USING (cell_type) WHERE n >= 2 AND b < -1e-4""",
    ),
    "admixture_neighbor": (
        lambda s, d: _r(_welch_rules(s, d), "t", "delta"),
        f"""{_NEAR}, b AS (SELECT DISTINCT src FROM e JOIN v_cells ON dst = cell_idx WHERE d2 <= 144 AND cell_type = 'BUILDING'), c AS (SELECT cell_type, cell_area + CASE WHEN src IS NOT NULL THEN 12 ELSE 0 END AS a, src IS NOT NULL AS near FROM v_cells LEFT JOIN b ON src = cell_idx WHERE cell_type <> 'BUILDING'),
        q AS (SELECT cell_type, count(*) FILTER (WHERE near) AS n1, count(*) FILTER (WHERE NOT near) AS n0, avg(a) FILTER (WHERE near) - avg(a) FILTER (WHERE NOT near) AS dm, var_samp(a) FILTER (WHERE near) AS v1, var_samp(a) FILTER (WHERE NOT near) AS v0 FROM c GROUP BY 1)
        SELECT cell_type, n1 AS n_with, n0 AS n_without, round(dm / sqrt(v1 / n1 + v0 / n0), 6) AS t, round(dm, 6) AS delta FROM q WHERE n1 >= 5 AND n0 >= 5 AND dm >= 0.005 AND dm / sqrt(v1 / n1 + v0 / n0) > 1.2815515655""",
    ),
    "f1_calibration": (
        lambda s, d: _r(_calibrated(s, d), "threshold", "f1", "precision", "recall"),
        f"""{_RULE_SQL}, t AS (SELECT factor, feature_name FROM g WHERE share >= 0.04e0 AND nuclear >= 0.5e0), s AS (SELECT quality AS v, (factor, feature_name) IN (SELECT (factor, feature_name) FROM t) AS real FROM g WHERE quality >= 0.51e0),
        r AS (SELECT a.v, count(*) AS n, count(*) FILTER (WHERE b.real) AS tp FROM (SELECT DISTINCT v FROM s) a JOIN s b ON b.v >= a.v GROUP BY 1) SELECT round(v, 6) AS threshold, round(2 * tp / (n + k), 6) AS f1, round(tp / n, 6) AS precision, round(tp / k, 6) AS recall, n AS n_detected FROM r, (SELECT count(*) AS k FROM t) WHERE tp > 0 ORDER BY 2 * tp / (n + k) DESC, v LIMIT 1""",
    ),
    "naive_bayes": (
        lambda s, d: _r(ops.naive_bayes(_flags(s, d), ["a", "b", "c"]), "posterior"),
        "f AS (SELECT cell_idx % 3 = 0 AS a, cell_idx % 4 < 2 AS b, cell_area > 70 AS c, cell_idx % 3 = 0 AND cell_idx % 8 < 5 AS t FROM v_cells), r AS (SELECT avg(t::INT) AS prior, " + ", ".join(f"greatest(0.02, least(0.98, count(*) FILTER (WHERE {m} AND {w}) / greatest(count(*) FILTER (WHERE {w}), 1))) AS {m}{k}" for m in "abc" for k, w in ((1, "t"), (0, "NOT t"))) + """ FROM f)
        SELECT x.v AS a, y.v AS b, z.v AS c, round(1 / (1 + exp(-(ln(greatest(prior, 0.02)) - ln(greatest(1 - prior, 0.02)) + """ + " + ".join(f"CASE WHEN {k}.v THEN ln({m}1 / {m}0) ELSE ln((1 - {m}1) / (1 - {m}0)) END" for k, m in zip("xyz", "abc", strict=True)) + "))), 6) AS posterior FROM r, (VALUES (true), (false)) x(v), (VALUES (true), (false)) y(v), (VALUES (true), (false)) z(v)",
    ),
    "consensus_posterior": (lambda s, d: _r(ops.calibrated_consensus(_rules(s, d), ["factor", "feature_name"]), "share_calibrated", "quality_calibrated", "nuclear_calibrated", "combined_score", "posterior"), None),
    "roundtrip_eval": (
        lambda s, d: _r(_roundtrip(s, d), "strength"),
        f"{_RULE_SQL} SELECT factor, feature_name, share >= 0.04e0 AS detected, round(CASE WHEN share >= 0.04e0 THEN share ELSE 0 END, 6) AS strength, (SELECT count(*) FROM g WHERE share >= 0.04e0 AND NOT nuclear >= 0.5e0) AS other_rules FROM g WHERE nuclear >= 0.5e0",
    ),
    "binomial_tail": (
        lambda s, d: view(s, d, "v_molecules").groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"), F.sum("overlaps_nucleus").alias("k")).select("feature_name", "n", "k", F.round(columns.binomial_tail(F.col("k"), F.col("n"), F.lit(0.5)), 5).alias("p")), None,
    ),
    "intensity_quantiles": (
        lambda s, d: _r(_target(s, d, 17), "t"),
        "SELECT scene_id, q, round(t, 6) AS t FROM (SELECT scene_id, unnest(quantile_cont(value * 2, [" + ", ".join(f"{i / 16}" for i in range(17)) + "])) AS t, unnest(range(17))::INT AS q FROM v_pixels WHERE label > 0 GROUP BY 1)",
    ),
    "sensor_noise": (
        lambda s, d: _r(ops.sensor_noise(view(s, d, "v_pixels").withColumn("value", F.col("value") * 400), 300, 10, 60.0), "read_std", "dark_mean", "shot_k"),
        """p AS (SELECT scene_id, value * 400 AS v FROM v_pixels WHERE value > 0), q AS (SELECT scene_id, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.5) AS p50, count(*) AS n FROM p GROUP BY 1), d AS (SELECT scene_id, any_value(p50) AS p50, any_value(n) AS n, count(*) FILTER (WHERE v < p5 + 1) AS nd, stddev_pop(v) FILTER (WHERE v < p5 + 1) AS sd, avg(v) FILTER (WHERE v < p5 + 1) AS md, count(*) FILTER (WHERE v BETWEEN greatest(p50 - 60, 1) AND p50 + 60) AS nm, var_pop(v) FILTER (WHERE v BETWEEN greatest(p50 - 60, 1) AND p50 + 60) AS vm FROM p JOIN q USING (scene_id) GROUP BY 1),
        e AS (SELECT *, CASE WHEN n >= 300 AND nd > 10 THEN sd ELSE 0 END AS rs FROM d) SELECT scene_id, round(rs, 6) AS read_std, round(CASE WHEN n >= 300 AND nd > 10 THEN md ELSE 0 END, 6) AS dark_mean, round(CASE WHEN n >= 300 AND nm > 300 THEN sqrt(greatest(vm - rs * rs, 0) / p50) ELSE 0 END, 6) AS shot_k FROM e""",
    ),
    "geometry_summary": (
        lambda s, d: _r(view(s, d, "v_pixels").groupBy("scene_id").agg(F.avg((F.col("label") > 0).cast("double")).alias("cell_fraction"), F.avg(F.col("nucleus").cast("double")).alias("nucleus_fraction"), F.avg(((F.col("label") > 0) & (F.col("nucleus") == 0)).cast("double")).alias("cytoplasm_fraction")), "cell_fraction", "nucleus_fraction", "cytoplasm_fraction"),
        "SELECT scene_id, round(avg((label > 0)::INT), 6) AS cell_fraction, round(avg(nucleus), 6) AS nucleus_fraction, round(avg((label > 0 AND nucleus = 0)::INT), 6) AS cytoplasm_fraction FROM v_pixels GROUP BY 1",
    ),
    "slice_guide": (
        lambda s, d: _r(view(s, d, "v_pixels").where("label > 0").join(_types(s, d), "label").withColumn("k", F.explode(F.array(F.lit(4), F.lit(8), F.lit(16)))).groupBy("scene_id", "k", F.floor(F.col("y") / F.col("k")).alias("by"), F.floor(F.col("x") / F.col("k")).alias("bx"), "cell_type").agg((F.count(F.lit(1)) / F.first(F.col("k") * F.col("k"))).alias("share")), "share"),
        f"{_TYPED} SELECT scene_id, k, CAST(floor(y / k) AS BIGINT) AS by, CAST(floor(x / k) AS BIGINT) AS bx, cell_type, round(count(*) / (k * k), 6) AS share FROM v_pixels JOIN t USING (label), (VALUES (4), (8), (16)) f(k) GROUP BY 1, 2, 3, 4, 5",
    ),
    "z_profile": (lambda s, d: _r(_profiles(s, d), "v"), "SELECT label, scene_id AS z, round(avg(value) * 10, 6) AS v FROM v_pixels WHERE label > 0 GROUP BY 1, 2"),
    "fwhm_islands": (
        lambda s, d: _r(ops.fwhm(_profiles(s, d), 0.2, 3.0).select("label", "z_extent", "z_confidence"), "z_extent", "z_confidence"),
        """p AS (SELECT label, scene_id AS z, avg(value) * 10 AS v FROM v_pixels WHERE label > 0 GROUP BY 1, 2), b AS (SELECT *, v - min(v) OVER w AS b, min(v) OVER w AS base FROM p WINDOW w AS (PARTITION BY label)), m AS (SELECT *, max(b) OVER (PARTITION BY label) AS peak FROM b),
        a AS (SELECT label, any_value(peak) AS peak, any_value(base) AS base, min(z) FILTER (WHERE b = peak) AS pk FROM m GROUP BY 1), l AS (SELECT m.label, coalesce(max(z) FILTER (WHERE z < pk AND b <= m.peak / 2), -1) AS lo, coalesce(min(z) FILTER (WHERE z > pk AND b <= m.peak / 2), 5) AS hi FROM m JOIN a USING (label) GROUP BY 1)
        SELECT label, (hi - lo - 2) * 3e0 AS z_extent, round(peak / greatest(base, 1), 6) AS z_confidence FROM a JOIN l USING (label) WHERE peak > 0.2""",
    ),
    "axial_profile": (
        lambda s, d: _r(view(s, d, "v_pixels").where("nucleus = 1").groupBy(F.abs(F.col("scene_id") - 2).alias("dz")).agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n")).where("n >= 20").crossJoin(F.broadcast(view(s, d, "v_pixels").where("nucleus = 1").groupBy(F.abs(F.col("scene_id") - 2).alias("z")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("k")).where("k >= 20").agg(F.max("v").alias("peak")))).select("dz", (F.col("m") / F.col("peak")).alias("share")), "share"),
        "a AS (SELECT abs(scene_id - 2) AS dz, avg(value) AS m FROM v_pixels WHERE nucleus = 1 GROUP BY 1 HAVING count(*) >= 20) SELECT dz, round(m / (SELECT max(m) FROM a), 6) AS share FROM a",
    ),
    "match_summary": (
        lambda s, d: _r(_summary(s, d), "match_rate_a", "match_rate_b", "mean_iou", "median_iou", "iou_at_50", "iou_at_75"),
        f"{_MATCH}, n AS (SELECT count(*) FILTER (WHERE scene_id < 4) AS na, count(*) FILTER (WHERE scene_id > 0) AS nb FROM z) SELECT count(*) AS matched, round(count(*) / any_value(na), 6) AS match_rate_a, round(count(*) / any_value(nb), 6) AS match_rate_b, round(avg(iou), 6) AS mean_iou, round(quantile_cont(iou, 0.5), 6) AS median_iou, round(avg((iou >= 0.5)::INT), 6) AS iou_at_50, round(avg((iou >= 0.75)::INT), 6) AS iou_at_75, any_value(nb - na) AS count_delta FROM m, n",
    ),
    "bench_rollup": (
        lambda s, d: _r(_rollup(s, d), "mean_iou", "recall"),
        f"{_MATCH}, {_TYPED}, e AS (SELECT CASE scene_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 12 END AS size, cell_type, iou FROM m JOIN t ON t.label = la) SELECT CAST(size AS VARCHAR) AS key, 'size' AS by, count(*) AS n, round(avg(iou), 6) AS mean_iou, round(avg((iou >= 0.5)::INT), 6) AS recall FROM e GROUP BY size UNION ALL SELECT cell_type, 'type', count(*), round(avg(iou), 6), round(avg((iou >= 0.5)::INT), 6) FROM e GROUP BY cell_type",
    ),
    "type_breakdown": (
        lambda s, d: _r(_breakdown(s, d), "per_cell"),
        "c AS (SELECT cell_id, coalesce(cell_type, 'unknown') AS cell_type FROM v_cells), m AS (SELECT cell_type, count(*) AS n FROM v_molecules JOIN c USING (cell_id) WHERE qv >= 20 GROUP BY 1) SELECT cell_type, count(*) AS cells, coalesce(any_value(n), 0) AS molecules, round(coalesce(any_value(n), 0) / count(*), 6) AS per_cell FROM c LEFT JOIN m USING (cell_type) GROUP BY 1",
    ),
    "count_histogram": (
        _histograms,
        "n AS (SELECT count(*) AS n FROM v_molecules WHERE cell_id <> 'UNASSIGNED' GROUP BY cell_id), t AS (SELECT ln(quantile_cont(n, 0.99) + 1) AS top FROM n) SELECT CAST(least(floor(ln(n + 1) / top * 60), 60) AS BIGINT) AS bin, count(*) AS cells FROM n, t GROUP BY 1",
    ),
    "channel_histogram": (
        lambda s, d: view(s, d, "v_pixels").groupBy("scene_id", F.width_bucket("value", F.lit(0.0), F.lit(1.0), F.lit(32)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT scene_id, CAST(floor(value * 32) + 1 AS BIGINT) AS bucket, count(*) AS n FROM v_pixels GROUP BY 1, 2",
    ),
    "quantile_remap": (
        lambda s, d: _r(ops.quantile_remap(view(s, d, "v_pixels").where("label > 0"), _target(s, d, 17), "scene_id", ["y", "x"], 17).groupBy("scene_id", "label").agg(F.avg("remapped").alias("mean")), "mean"),
        """g AS (SELECT scene_id, quantile_cont(value * 2, [""" + ", ".join(f"{i / 16}" for i in range(17)) + """]) AS t FROM v_pixels WHERE label > 0 GROUP BY 1), r AS (SELECT scene_id, label, (row_number() OVER (PARTITION BY scene_id ORDER BY value, y, x) - 1) / (count(*) OVER (PARTITION BY scene_id) - 1) * 16 AS a FROM v_pixels WHERE label > 0),
        k AS (SELECT *, CAST(least(floor(a), 15) AS INT) AS q FROM r) SELECT scene_id, label, round(avg(t[q + 1] + (a - q) * (t[q + 2] - t[q + 1])), 6) AS mean FROM k JOIN g USING (scene_id) GROUP BY 1, 2""",
    ),
    "cumulative_categorical": (
        lambda s, d: ops.inverse_cdf(view(s, d, "v_cells").where("cell_type is not null").select("cell_idx", "cell_type", (F.pmod(F.col("cell_idx") * 7919, F.lit(10007)) / 10007).alias("u")), _alpha(s, d, False).withColumnRenamed("alpha", "weight"), "cell_type", "factor", "u").groupBy("cell_type", "factor").agg(F.count(F.lit(1)).alias("n")),
        f"{_ALPHA}, c AS (SELECT cell_type, factor, sum(alpha) OVER (PARTITION BY cell_type ORDER BY factor) / sum(alpha) OVER (PARTITION BY cell_type) AS cdf FROM a) SELECT cell_type, factor, count(*) AS n FROM (SELECT v.cell_type, (SELECT min(factor) FROM c WHERE c.cell_type = v.cell_type AND cdf > (cell_idx * 7919 % 10007) / 10007e0) AS factor FROM v_cells v WHERE cell_type IS NOT NULL) GROUP BY 1, 2",
    ),
}
