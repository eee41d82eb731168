"""Queries on choices: nearest neighbours of any distance, optimal matches, thinning and crops, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.operators import admixture, assignment, cells, crops, fields, nearest, sampling, spatial, stats, suppression
from cellspan.operators.staging import cut, shared_path
from cellspan.sources import bundle, versioned
from cellspan.sources.views import view
from cellspan.streaming import strips


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _cells(s: SparkSession, d: str) -> DataFrame:
    """The cells as the choice of crops wants them."""
    n = view(s, d, "v_molecules").where("cell_id <> 'UNASSIGNED'").groupBy("cell_id").agg(F.count(F.lit(1)).alias("molecules"))
    c = view(s, d, "v_cells").join(n, "cell_id", "left")
    return c.select("cell_id", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), F.coalesce("molecules", F.lit(0)).alias("molecules"), "cell_type", F.col("cell_area").alias("area"))


_CELLS = """n0 AS (SELECT cell_id, count(*) AS molecules FROM v_molecules WHERE cell_id <> 'UNASSIGNED' GROUP BY 1),
c AS (SELECT cell_id, centroid_x AS x, centroid_y AS y, coalesce(molecules, 0) AS molecules, cell_type, cell_area AS area FROM v_cells LEFT JOIN n0 USING (cell_id))"""


def _knn(s: SparkSession, d: str) -> DataFrame:
    """The 8 nearest cells within a crop of 100 um, however far."""
    c = view(s, d, "v_cells").withColumn("crop", F.concat_ws("_", F.floor(F.col("centroid_x") / 100), F.floor(F.col("centroid_y") / 100)))
    return nearest.nearest(c, c, 8, within=["crop"]).select("src", "dst", "rank")


def _lone_types(s: SparkSession, d: str) -> DataFrame:
    """For each cell without a type the nearest one of the rarest type, however far."""
    c = view(s, d, "v_cells")
    return nearest.nearest(c.where("cell_type is null"), c.where("cell_type = 'MACHINERY' and cell_idx % 4 = 0"), 1).select("src", "dst", F.sqrt("d2").alias("d"))


def _pairs(s: SparkSession, d: str, far: float) -> DataFrame:
    """Candidates of two segmentations: even against odd cells within reach, at their distance."""
    c = view(s, d, "v_cells").select("cell_idx", "centroid_x", "centroid_y")
    near = nearest.nearest(c.where("cell_idx % 2 = 0"), c.where("cell_idx % 2 = 1"), 12, far=far)
    return near.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.round(F.sqrt("d2"), 9).alias("cost"))


def _match(s: SparkSession, d: str) -> DataFrame:
    return assignment.match(_pairs(s, d, 11.0))


def _match_rates(s: SparkSession, d: str) -> DataFrame:
    m = _match(s, d).agg(F.count(F.lit(1)).alias("matched"), F.avg("cost").alias("mean_distance"))
    n = view(s, d, "v_cells").agg(F.count_if(F.col("cell_idx") % 2 == 0).alias("n_a"), F.count_if(F.col("cell_idx") % 2 == 1).alias("n_b"))
    return m.crossJoin(F.broadcast(n)).select("matched", "mean_distance", (F.col("matched") / F.col("n_a")).alias("rate_a"), (F.col("matched") / F.col("n_b")).alias("rate_b"), ((F.col("n_b") - F.col("matched")) / F.col("n_b")).alias("spurious_b"))  # one row


def _apart(s: SparkSession, d: str) -> DataFrame:
    """Cells by falling area, none nearer than 25 um to a kept one."""
    return suppression.suppress(view(s, d, "v_cells"), 25.0, [-F.col("cell_area")]).select("cell_idx")


def _crops(s: SparkSession, d: str, selection: str, n: int = 20, size: float = 60.0) -> DataFrame:
    return _rounded(crops.choose_crops(_cells(s, d), n, size, selection=selection), "xmin", "xmax", "ymin", "ymax")


def _regions(s: SparkSession, d: str) -> DataFrame:
    return _rounded(crops.bench_regions(_cells(s, d), 4, 100.0), "xmin", "ymin")


def _override(s: SparkSession, d: str) -> DataFrame:
    """Splits of crops by regions, of which there are more than are broadcast: each supplier's square is one."""
    c = _cells(s, d).select(F.col("cell_id").alias("crop_id"), (F.col("x") - 5).alias("xmin"), (F.col("x") + 5).alias("xmax"), (F.col("y") - 5).alias("ymin"), (F.col("y") + 5).alias("ymax"), F.lit("train").alias("split"))
    r = s.read.parquet(f"{d}/part.parquet").select(((F.col("p_partkey") * 37) % 400 - 4.0).alias("xmin"), ((F.col("p_partkey") * 61) % 300 - 4.0).alias("ymin"), F.when(F.col("p_partkey") % 3 == 0, "test").otherwise("val").alias("region_split"))
    r = r.withColumns({"xmax": F.col("xmin") + 8.0, "ymax": F.col("ymin") + 8.0})
    return cells.override_splits(c, r, most=10).select("crop_id", "split")


def _many_boxes(s: SparkSession, d: str) -> DataFrame:
    """Counts in a crop around every 15th cell, over molecules in Parquet: beyond 64 crops the scan gets their common bounds."""
    molecules = cut(view(s, d, "v_molecules").select("x_location", "y_location", "qv", "cell_id"), "molecules")
    c = view(s, d, "v_cells").where("cell_idx % 15 = 1")
    boxes = c.select(F.col("cell_idx").alias("crop_ord"), F.col("cell_id").alias("crop_id"), *((F.col(f"centroid_{a}") + h).alias(f"{a}{n}") for a in "xy" for n, h in (("min", -12.0), ("max", 12.0))))
    boxes = cut(boxes, "boxes")
    return spatial.crop_counts(bundle.scan_molecules(molecules, boxes).withColumn("qv", F.lit(20.0)), boxes)


def _strata(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "v_cells").where("cell_type is not null").select("cell_id", "cell_idx", "cell_type", "centroid_x", "centroid_y")
    n = view(s, d, "v_molecules").join(c.select("cell_id", "cell_type"), "cell_id").groupBy("cell_id", "cell_type", "factor").agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy("cell_id").agg(F.sum("n").alias("all"))
    fractions = cut(n.join(whole, "cell_id").select("cell_id", "cell_type", "factor", (F.col("n") / F.col("all")).alias("share")), "fractions")
    edges = spatial.radius_join(c, c, 15.0, "cell_id").select("src", "dst")
    rules = admixture.neighbor_rules(admixture.cooccurrence(fractions, edges, c.select("cell_id", "cell_type"), admixture.native_types(fractions)))
    return _rounded(rules, "mean_with", "mean_without", "delta", "t", "df").drop("p")


def _cached_z(s: SparkSession, d: str) -> DataFrame:
    """A cache of depths: a region first, then an update of some, then the whole; the rest is fitted only once."""
    folder = shared_path(s, "z-cache")
    z = view(s, d, "v_z_attrs").join(view(s, d, "v_cells").select("cell_id", "centroid_x", "centroid_y"), "cell_id")

    def fit(box: tuple | None) -> DataFrame:
        inside = z if box is None else z.where(F.col("centroid_x").between(*box[:2]) & F.col("centroid_y").between(*box[2:]))
        return inside.select("cell_id", "z_center_um", "z_extent_um", "z_confidence")

    region = versioned.load_or_fit(s, folder, "cell_id", fit, (100.0, 200.0, 0.0, 1e9))
    versioned.upsert(region.where("z_confidence < 0.5").withColumn("z_confidence", F.lit(1.0)), folder, "cell_id")
    return versioned.load_or_fit(s, folder, "cell_id", fit, (150.0, 260.0, 0.0, 1e9))


def _strips(s: SparkSession, d: str) -> DataFrame:
    """Strips of a grid of 7 tiles a row whose molecules have arrived: tiles of 60 um that hold any."""
    m = view(s, d, "v_molecules").where("x_location >= 0 and x_location < 420 and y_location >= 0")
    tile = (F.floor(F.col("y_location") / 60) * 7 + F.floor(F.col("x_location") / 60)).alias("tile")
    tiles = cut(m.groupBy(tile).agg(F.count(F.lit(1)).alias("value")), "tiles")
    rows = tiles.agg(F.max("tile")).first()[0]
    return strips.ready(tiles, (rows or 0) // 7 + 1, 7)


def _neighbours(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = view(s, d, "v_cells")
    return c, spatial.knn_join(c, c, 6, 15.0).select("src", "dst")


def _gibbs(s: SparkSession, d: str) -> DataFrame:
    """Types drawn by the marginal of the cells' types and what their neighbours are, then held to the marginal."""
    c, edges = _neighbours(s, d)
    n = {r["cell_type"]: float(r["n"]) for r in c.where("cell_type is not null").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    cond = {(r["type_a"], r["type_b"]): r["share"] for r in stats.neighbor_matrix(edges, c).collect()}  # types squared rows
    drawn = fields.gibbs_types(c.select(F.col("cell_idx").alias("node")), edges, n, cond, 2)
    return drawn.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _tilts(s: SparkSession, d: str) -> DataFrame:
    c, edges = _neighbours(s, d)
    start = c.select(F.col("cell_idx").alias("node"), (F.col("cell_area") / 40).alias("angle"), (F.col("cell_area") / F.col("nucleus_area")).alias("ratio"))
    return _rounded(fields.sample_tilts(edges, start, sweeps=5), "angle")


def _coloured(s: SparkSession, d: str) -> DataFrame:
    c, edges = _neighbours(s, d)
    return fields.colours(edges, c.select(F.col("cell_idx").alias("node")))


def _states(s: SparkSession, d: str) -> DataFrame:
    """States of cells, drawn by weights that differ by type."""
    c = view(s, d, "v_cells").select(F.col("cell_idx").alias("key"), "cell_type")
    types = c.where("cell_type is not null").select("cell_type").distinct()
    names = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("state"), F.lit(p).alias("p")) for i, (n, p) in enumerate((("full", 5.0), ("nucleus_poor", 2.0), ("sliver", 1.0))))))
    weights = types.select("cell_type", names.alias("w")).select("cell_type", "w.ord", "w.state", (F.col("w.p") * F.length("cell_type")).alias("p"))
    return sampling.sample_states(c, weights, 7).groupBy("cell_type", "state").agg(F.count(F.lit(1)).alias("n"))


def _templates(s: SparkSession, d: str) -> DataFrame:
    """For cells without a type or nucleus data a template of the observed ones, by type and zone of 100 um."""
    c = view(s, d, "v_cells").withColumn("zone", F.floor(F.col("centroid_x") / 100))
    bank = c.where("cell_idx % 3 <> 0 and cell_type is not null").select(F.col("cell_idx").alias("template"), "cell_type", "zone")
    return sampling.sample_templates(c.where("cell_idx % 3 = 0").select(F.col("cell_idx").alias("key"), "cell_type", "zone"), bank, 7).select("key", "template")


def _split_manifest(s: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("cell_idx") % 5 == 3, "val").when(F.col("cell_idx") % 5 == 4, "test").otherwise("train")
    m = sampling.split_manifest(view(s, d, "v_cells").select(F.col("cell_id").alias("crop_id"), split.alias("split")))
    return m.select("split", "n", F.array_join("crops", ",").alias("crops"))


def _gene_sides(s: SparkSession, d: str) -> DataFrame:
    """Molecules of every gene within cells and outside, both sides whole."""
    m = view(s, d, "v_molecules")
    side = lambda c, n: m.where(c).groupBy("feature_name").agg(F.count(F.lit(1)).alias(n))
    both = side("cell_id <> 'UNASSIGNED'", "inside").join(side("cell_id = 'UNASSIGNED'", "outside"), "feature_name", "full")
    inside, outside = F.coalesce("inside", F.lit(0)), F.coalesce("outside", F.lit(0))
    return both.select("feature_name", inside.alias("inside"), outside.alias("outside"), F.round(F.log2((inside + 1) / (outside + 1)), 6).alias("log_ratio"))


def _crop_sql() -> str:
    return f"SELECT concat('crop_', lpad(CAST(row_number() OVER (ORDER BY pick) AS VARCHAR), 5, '0')) AS crop_id, round(x - 30, 6) AS xmin, round(x + 30, 6) AS xmax, round(y - 30, 6) AS ymin, round(y + 30, 6) AS ymax FROM k"


_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
#: The greedy choice in an order, step by step; d2: what a squared distance to a kept one must not be below (a leading "=": nor equal).
GREEDY = """r AS (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM {rows}),
g AS (SELECT i, [{{'x': x, 'y': y}}] AS held FROM r WHERE i = 1 UNION ALL
  SELECT n.i, list_append(g.held, {{'x': n.x, 'y': n.y}}) FROM g, LATERAL (SELECT i, x, y FROM r WHERE r.i > g.i AND len([h FOR h IN g.held IF (h.x - r.x) * (h.x - r.x) + (h.y - r.y) * (h.y - r.y) <{d2}]) = 0 ORDER BY i LIMIT 1) n{stop})"""

#: Queries whose SQL goes step by step.
RECURSIVE = {"min_distance_cells", "grid_crop_boxes", "density_crop_boxes"}

#: Queries without SQL are held against plain Python in tests/test_crops.py, test_greedy.py, test_fields.py and test_sampling.py.
ALL = {
    "knn_uncapped_per_crop": (
        _knn,
        """c AS (SELECT cell_idx, centroid_x AS x, centroid_y AS y, floor(centroid_x / 100) AS gx, floor(centroid_y / 100) AS gy FROM v_cells)
        SELECT src, dst, CAST(rank AS INTEGER) AS rank FROM (SELECT a.cell_idx AS src, b.cell_idx AS dst, row_number() OVER (PARTITION BY a.cell_idx ORDER BY """ + _D2 + """, b.cell_idx) AS rank
        FROM c a JOIN c b ON a.gx = b.gx AND a.gy = b.gy AND a.cell_idx <> b.cell_idx) WHERE rank <= 8""",
    ),
    "nearest_of_rare_type": (
        lambda s, d: _rounded(_lone_types(s, d), "d"),
        """c AS (SELECT *, centroid_x AS x, centroid_y AS y FROM v_cells) SELECT src, dst, round(sqrt(d2), 6) AS d FROM (SELECT a.cell_idx AS src, b.cell_idx AS dst, """ + _D2 + """ AS d2,
        row_number() OVER (PARTITION BY a.cell_idx ORDER BY """ + _D2 + """, b.cell_idx) AS rank FROM c a JOIN c b ON a.cell_type IS NULL AND b.cell_type = 'MACHINERY' AND b.cell_idx % 4 = 0) WHERE rank = 1""",
    ),
    "hungarian_match": (lambda s, d: _rounded(_match(s, d), "cost"), None),
    "hungarian_summary": (lambda s, d: _rounded(_match_rates(s, d), "mean_distance", "rate_a", "rate_b", "spurious_b"), None),
    "min_distance_cells": (
        _apart,
        "c AS (SELECT cell_idx, cell_area, centroid_x AS x, centroid_y AS y FROM v_cells), " + GREEDY.format(order="cell_area DESC, cell_idx", rows="c", d2=625, stop="") + " SELECT cell_idx FROM r JOIN g USING (i)",
    ),
    "spread_crop_boxes": (
        lambda s, d: _crops(s, d, "spread"),
        f"{_CELLS}, r AS (SELECT *, row_number() OVER (ORDER BY x, y, cell_id) - 1 AS i, count(*) OVER () AS n FROM c), k AS (SELECT *, j AS pick FROM r, range(20) t(j) WHERE i = round_even(j * (n - 1) / 19.0e0, 0)) {_crop_sql()}",
    ),
    "grid_crop_boxes": (
        lambda s, d: _crops(s, d, "grid"),
        f"""{_CELLS}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, greatest(1, ceil(sqrt(20 * greatest(max(x) - min(x) + 60, 60) / greatest(max(y) - min(y) + 60, 60)))) AS nc FROM c),
        f AS (SELECT *, greatest(1, ceil(20 / nc)) AS nr FROM e),
        t AS (SELECT j, CASE WHEN nc > 1 THEN x0 + (x1 - x0) * (j % nc) / (nc - 1) ELSE x0 END AS tx, CASE WHEN nr > 1 THEN y0 + (y1 - y0) * floor(j / nc) / (nr - 1) ELSE y0 END AS ty FROM f, range(20) s(j)),
        g AS (SELECT -1 AS j, CAST([] AS VARCHAR[]) AS used, '' AS cell_id UNION ALL SELECT t.j, list_append(g.used, n.cell_id), n.cell_id FROM g JOIN t ON t.j = g.j + 1,
          LATERAL (SELECT c.cell_id FROM c WHERE NOT list_contains(g.used, c.cell_id) ORDER BY (x - t.tx) * (x - t.tx) + (y - t.ty) * (y - t.ty), c.cell_id LIMIT 1) n),
        k AS (SELECT x, y, g.j AS pick FROM g JOIN c USING (cell_id)) {_crop_sql()}""",
    ),
    "density_crop_boxes": (
        lambda s, d: _crops(s, d, "density"),
        f"""{_CELLS}, q AS (SELECT floor(x / 30) AS gx, floor(y / 30) AS gy, count(*) AS n FROM c GROUP BY 1, 2),
        v AS (SELECT c.*, (SELECT sum(n) FROM q WHERE gx BETWEEN floor(x / 30) - 1 AND floor(x / 30) + 1 AND gy BETWEEN floor(y / 30) - 1 AND floor(y / 30) + 1) AS density FROM c),
        {GREEDY.format(order="density DESC, molecules DESC, x, y, cell_id", rows="v", d2=3600, stop=" WHERE len(g.held) < 20")},
        k AS (SELECT x, y, row_number() OVER (ORDER BY own DESC, i) AS pick FROM (SELECT r.*, (i IN (SELECT i FROM g)) AS own FROM r) QUALIFY pick <= 20) {_crop_sql()}""",
    ),
    "stratified_crop_boxes": (lambda s, d: _crops(s, d, "stratified"), None),
    "bench_regions": (
        _regions,
        f"""{_CELLS}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c),
        m AS (SELECT wx, wy, molecules, area FROM (SELECT c.*, e.*, unnest([CAST(floor((x - x0) / 50) AS BIGINT) - 1, CAST(floor((x - x0) / 50) AS BIGINT)]) AS wx FROM c, e) h, LATERAL (SELECT unnest([CAST(floor((y - y0) / 50) AS BIGINT) - 1, CAST(floor((y - y0) / 50) AS BIGINT)]) AS wy)
          WHERE wx >= 0 AND wy >= 0 AND wx <= floor(greatest(0, x1 - 100 - x0 + 1e-6) / 50) AND wy <= floor(greatest(0, y1 - 100 - y0 + 1e-6) / 50)),
        w0 AS (SELECT wx, wy, count(*) AS n_cells, avg(molecules) AS molecules, avg(area) AS area FROM m GROUP BY 1, 2 HAVING count(*) >= 25),
        w AS (SELECT * FROM w0 WHERE (SELECT count(*) FROM w0) <= 4 OR n_cells >= (SELECT quantile_cont(n_cells, 0.4) FROM w0) OR (SELECT count(*) FILTER (WHERE n_cells >= (SELECT quantile_cont(n_cells, 0.4) FROM w0)) FROM w0) < 4),
        z AS (SELECT wx, wy, n_cells, {", ".join(f"({v} - avg({v}) OVER ()) / CASE WHEN stddev_pop({v}) OVER () = 0 THEN 1 ELSE stddev_pop({v}) OVER () END AS f{i}" for i, v in enumerate(("CAST(wx AS DOUBLE)", "CAST(wy AS DOUBLE)", "ln(1 + n_cells)", "molecules", "area")))} FROM w),
        p1 AS (SELECT * FROM z ORDER BY n_cells DESC, wy, wx LIMIT 1),
        """
        + ", ".join(
            f"""p{k} AS (SELECT * FROM z WHERE (wx, wy) NOT IN (SELECT (wx, wy) FROM u{k - 1}) ORDER BY round((SELECT min(sqrt({" + ".join(f"power(z.f{i} - u.f{i}, 2)" for i in range(5))})) FROM u{k - 1} u), 9) DESC, wy, wx LIMIT 1), u{k} AS (SELECT * FROM u{k - 1} UNION ALL SELECT *, {k} AS turn FROM p{k})"""
            for k in (2, 3, 4)
        ).replace("p2 AS", "u1 AS (SELECT *, 1 AS turn FROM p1), p2 AS", 1)
        + " SELECT concat('region', row_number() OVER (ORDER BY n_cells DESC, turn)) AS region, round(x0 + wx * 50, 6) AS xmin, round(y0 + wy * 50, 6) AS ymin, n_cells FROM u4, e",
    ),
    "crop_counts_many_boxes": (
        _many_boxes,
        """b AS (SELECT cell_idx AS o, cell_id AS crop_id, centroid_x AS x, centroid_y AS y FROM v_cells WHERE cell_idx % 15 = 1),
        m AS (SELECT cell_id, (SELECT min(o) FROM b WHERE x_location BETWEEN x - 12 AND x + 12 AND y_location BETWEEN y - 12 AND y + 12) AS o FROM v_molecules WHERE qv >= 20)
        SELECT crop_id, count(m.o) AS total, count(m.o) FILTER (WHERE m.cell_id <> 'UNASSIGNED') AS assigned FROM b LEFT JOIN m USING (o) GROUP BY 1""",
    ),
    "neighbor_cooccurrence": (
        _strata,
        """c AS (SELECT cell_id, cell_type, centroid_x AS x, centroid_y AS y FROM v_cells WHERE cell_type IS NOT NULL),
        n AS (SELECT cell_id, cell_type, factor, count(*) AS n FROM v_molecules JOIN c USING (cell_id) GROUP BY 1, 2, 3), f AS (SELECT cell_id, cell_type, factor, n / sum(n) OVER (PARTITION BY cell_id) AS share FROM n),
        k AS (SELECT cell_type, count(DISTINCT cell_id) AS cells FROM f GROUP BY 1),
        s AS (SELECT factor, first(cell_type ORDER BY round(-v / cells, 9), cell_type) AS source FROM (SELECT factor, cell_type, sum(share) AS v FROM f GROUP BY 1, 2) JOIN k USING (cell_type) GROUP BY 1),
        e AS (SELECT DISTINCT a.cell_id, b.cell_type AS source FROM c a JOIN c b ON a.cell_id <> b.cell_id AND """ + _D2 + """ <= 225),
        g AS (SELECT factor, source, c.cell_type AS target, e.cell_id IS NOT NULL AS near, coalesce(share, 0) AS share FROM c JOIN s ON c.cell_type <> source LEFT JOIN e USING (cell_id, source) LEFT JOIN f USING (cell_id, factor)),
        q AS (SELECT factor, source, target, count(*) FILTER (WHERE near) AS n1, count(*) FILTER (WHERE NOT near) AS n0, avg(share) FILTER (WHERE near) AS m1, avg(share) FILTER (WHERE NOT near) AS m0,
          var_samp(share) FILTER (WHERE near) AS v1, var_samp(share) FILTER (WHERE NOT near) AS v0 FROM g GROUP BY 1, 2, 3),
        u AS (SELECT *, v1 / n1 + v0 / n0 AS w, CASE WHEN n1 > 1 AND n0 > 1 AND v1 / n1 + v0 / n0 > 0 THEN (m1 - m0) / sqrt(v1 / n1 + v0 / n0) END AS t,
          CASE WHEN n1 > 1 AND n0 > 1 AND v1 / n1 + v0 / n0 > 0 THEN power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)) END AS df FROM q),
        p AS (SELECT *, df / 2 AS a, df / (df + t * t) AS x FROM u),
        r AS (SELECT *, exp(a * ln(x) - lgamma(a) - lgamma(0.5e0) + lgamma(a + 0.5e0)) / a * list_sum([1 / sqrt(1 - x * power((i + 0.5e0) / 4000, 1 / a)) FOR i IN range(4000)]) / 4000 AS p FROM p)
        SELECT factor, source, target, n1 AS n_with, n0 AS n_without, round(m1, 6) AS mean_with, round(m0, 6) AS mean_without, round(m1 - m0, 6) AS delta, round(t, 6) AS t, round(df, 6) AS df,
        coalesce(n1 >= 30 AND n0 >= 30 AND t > 0 AND m1 - m0 >= 0.005 AND p < 0.01, false) AS is_rule FROM r""",
    ),
    "gene_counts_sides": (
        _gene_sides,
        """a AS (SELECT feature_name, count(*) AS n FROM v_molecules WHERE cell_id <> 'UNASSIGNED' GROUP BY 1), b AS (SELECT feature_name, count(*) AS n FROM v_molecules WHERE cell_id = 'UNASSIGNED' GROUP BY 1)
        SELECT feature_name, coalesce(a.n, 0) AS inside, coalesce(b.n, 0) AS outside, round(log2((coalesce(a.n, 0) + 1) / (coalesce(b.n, 0) + 1)), 6) AS log_ratio FROM a FULL JOIN b USING (feature_name)""",
    ),
    "gibbs_types_drawn": (_gibbs, None),
    "tilt_sweeps": (_tilts, None),
    "graph_colours": (_coloured, None),
    "sampled_states": (_states, None),
    "sampled_templates": (_templates, None),
    "split_manifest": (
        _split_manifest,
        """s AS (SELECT cell_id, CASE cell_idx % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split FROM v_cells)
        SELECT split, count(*) AS n, string_agg(cell_id, ',' ORDER BY cell_id) AS crops FROM s GROUP BY 1""",
    ),
    "z_cache": (
        _cached_z,
        """SELECT cell_id, z_center_um, z_extent_um, CASE WHEN centroid_x < 125 AND z_confidence < 0.5 THEN 1.0e0 ELSE z_confidence END AS z_confidence
        FROM v_z_attrs JOIN v_cells USING (cell_id) WHERE centroid_x BETWEEN 75 AND 285 AND centroid_y >= -25""",
    ),
    "strips_ready": (
        _strips,
        """t AS (SELECT CAST(floor(y_location / 60) * 7 + floor(x_location / 60) AS BIGINT) AS tile, count(*) AS v FROM v_molecules WHERE x_location >= 0 AND x_location < 420 AND y_location >= 0 GROUP BY 1),
        n AS (SELECT max(tile) // 7 + 1 AS rows FROM t), b AS (SELECT tile // 7 + k AS strip, v FROM t, (VALUES (0), (1)) s(k))
        SELECT strip, count(*) AS tiles, CAST(sum(v) AS DOUBLE) AS total FROM b, n WHERE strip <= rows - 1 GROUP BY strip HAVING count(*) = CASE WHEN strip = 0 THEN 7 ELSE 14 END""",
    ),
    "split_many_regions": (
        _override,
        f"""{_CELLS}, r AS (SELECT (p_partkey * 37) % 400 - 4e0 AS xmin, (p_partkey * 61) % 300 - 4e0 AS ymin, CASE WHEN p_partkey % 3 = 0 THEN 'test' ELSE 'val' END AS s FROM part)
        SELECT cell_id AS crop_id, coalesce(min(s), 'train') AS split FROM c LEFT JOIN r ON x BETWEEN xmin AND xmin + 8 AND y BETWEEN ymin AND ymin + 8 GROUP BY 1""",
    ),
}
