"""Queries on loops, draws, selections, tiles and pixels, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellspan.operators import models as ops
from cellspan.operators import nearest, ranks, raster, spatial, stats, tiles
from cellspan.plans.analysis import _NEAR, _r
from cellspan.plans.measures import _MATCH, _matches
from cellspan.plans.selection import GREEDY
from cellspan.plans.tables import _BOUNDS, _bounds
from cellspan.sources.views import view


def _outside(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "v_molecules").where("overlaps_nucleus = 0")


def _mixture(s: SparkSession, d: str) -> DataFrame:
    parts = ops.mixture(_outside(s, d), "nucleus_distance", 2)
    return s.createDataFrame([(k, *p) for k, p in enumerate(parts)], "part int, share double, centre double, scale double")


def _pdf(v: str, w: str, m: str, c: str) -> str:
    return f"{w} * exp(-0.5 * power(({v} - {m}) / {c}, 2)) / {c}"


def _gmm_sql(rounds: int) -> str:
    """The rounds unrolled: responsibilities, then shares, centres and scales sorted by centre."""
    sql, par = "d AS (SELECT nucleus_distance AS v FROM v_molecules WHERE overlaps_nucleus = 0), p0 AS (SELECT 0.5e0 AS w0, 0.4e0 AS m0, 0.4e0 AS c0, 0.3e0 AS w1, 1.5e0 AS m1, 1.0e0 AS c1, 0.2e0 AS w2, 4.0e0 AS m2, 2.5e0 AS c2)", "p0"
    for k in range(rounds):
        f = [_pdf("v", f"w{i}", f"m{i}", f"c{i}") for i in range(3)]
        sql += f", e{k} AS (SELECT v, " + ", ".join(f"{x} / ({f[0]} + {f[1]} + {f[2]}) AS r{i}" for i, x in enumerate(f)) + f" FROM d, {par})"
        sql += f", s{k} AS (SELECT " + ", ".join(f"greatest(sum(r{i}), 1) AS n{i}, sum(r{i} * v) / greatest(sum(r{i}), 1) AS m{i}" for i in range(3)) + f" FROM e{k})"
        sql += f", q{k} AS (SELECT " + ", ".join(f"any_value(n{i}) / any_value(n0 + n1 + n2) AS w{i}, any_value(m{i}) AS m{i}, sqrt(greatest(sum(r{i} * (v - m{i}) * (v - m{i})) / any_value(n{i}), 1e-6)) AS c{i}" for i in range(3)) + f" FROM e{k}, s{k})"
        par = f"p{k + 1}"
        l = "list_sort([" + ", ".join(f"{{'m': m{i}, 'w': w{i}, 'c': c{i}}}" for i in range(3)) + "])"  # noqa: E741
        sql += f", {par} AS (SELECT " + ", ".join(f"l[{i + 1}].w AS w{i}, l[{i + 1}].m AS m{i}, l[{i + 1}].c AS c{i}" for i in range(3)) + f" FROM (SELECT {l} AS l FROM q{k}))"
    return sql + " " + " UNION ALL ".join(f"SELECT {i} AS part, round(w{i}, 6) AS share, round(m{i}, 6) AS centre, round(c{i}, 6) AS scale FROM {par}" for i in range(3))


def _posterior(s: SparkSession, d: str) -> DataFrame:
    m = view(s, d, "v_molecules").join(view(s, d, "v_cells").where("cell_type is not null").select("cell_id", "cell_type").hint("shuffle_hash"), "cell_id")
    return ops.compartment_posterior(m, [(0.5, 0.4, 0.4), (0.3, 1.5, 1.0), (0.2, 4.0, 2.5)])


def _molecules(s: SparkSession, d: str) -> DataFrame:
    """Molecules of cells by a number of their own from the table's keys (rows that agree in all of them are one)."""
    m = view(s, d, "v_molecules").where("cell_id <> 'UNASSIGNED'")
    return m.groupBy("mol_key", "l_partkey", "l_suppkey", "cell_id", "factor").agg(F.min("x_location").alias("x"), F.min("y_location").alias("y")).select((F.col("mol_key") * 100_000 + F.col("l_partkey") % 1000 * 100 + F.col("l_suppkey") % 100).alias("mol"), "factor", "cell_id", "x", "y")


_MOLS = "m AS (SELECT DISTINCT mol_key * 100000 + l_partkey % 1000 * 100 + l_suppkey % 100 AS mol, factor, c.cell_idx AS cell FROM v_molecules JOIN v_cells c USING (cell_id))"


def _reassigned(s: SparkSession, d: str) -> DataFrame:
    cells = view(s, d, "v_cells")
    m = _molecules(s, d).join(cells.select("cell_id", F.col("cell_idx").alias("cell")), "cell_id").groupBy("mol").agg(F.min("factor").alias("factor"), F.min("cell").alias("cell"))
    m = ops.cut(m, "molecules")
    near = spatial.radius_join(cells, cells, 8.0).select(F.col("src").alias("cell"), F.col("dst"))
    others = m.join(near, "cell").select("mol", F.col("dst").alias("cell"), F.lit(False).alias("own"))
    out = ops.reassign(m, m.select("mol", "cell", F.lit(True).alias("own")).unionByName(others), 2.0, 1)
    moved = out.join(m.withColumnRenamed("cell", "was"), ["mol", "factor"]).where("cell <> was")
    return moved.groupBy("was", "factor").agg(F.count(F.lit(1)).alias("n"))


def _points(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "v_cells").select("cell_idx", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), (F.col("cell_idx") % 7 + 1).alias("factor"))


def _clusters(s: SparkSession, d: str) -> DataFrame:
    return ops.dbscan(_points(s, d), 9.0, 3, "cell_idx", "x", "y")


_DB = """e AS (SELECT a.cell_idx AS a, b.cell_idx AS b FROM v_cells a JOIN v_cells b ON a.cell_idx <> b.cell_idx AND power(a.centroid_x - b.centroid_x, 2) + power(a.centroid_y - b.centroid_y, 2) <= 81),
 k AS (SELECT a FROM e GROUP BY 1 HAVING count(*) + 1 >= 3), n AS (SELECT e.a, e.b FROM e JOIN k x ON x.a = e.a JOIN k y ON y.a = e.b),
 w AS (WITH RECURSIVE r(node, seed) USING KEY (node) AS (SELECT a, a FROM k UNION (SELECT n.b, min(r.seed) FROM r JOIN n ON n.a = r.node JOIN recurring.r AS old ON old.node = n.b WHERE r.seed < old.seed GROUP BY n.b)) SELECT * FROM r),
 z AS (SELECT node, seed FROM w UNION ALL SELECT e.a, min(seed) FROM e JOIN w ON node = e.b WHERE e.a NOT IN (SELECT a FROM k) GROUP BY 1)"""


def _relaxed(s: SparkSession, d: str) -> DataFrame:
    cells = view(s, d, "v_cells")
    edges = spatial.knn_join(cells, cells, 6, 15.0).select("src", "dst")
    start = cells.select(F.col("cell_idx").alias("node"), F.coalesce("cell_type", F.lit("BUILDING")).alias("type"))
    affinity = stats.neighbor_matrix(edges, cells).select("type_a", "type_b", F.col("share").alias("p"))
    return ops.relax_types(edges, start, affinity, 1.5, 3).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _tilts(s: SparkSession, d: str) -> DataFrame:
    cells = view(s, d, "v_cells")
    start = cells.select(F.col("cell_idx").alias("node"), (ops.uniform(F.col("cell_idx"), 3) * 3.141592653589793).alias("angle"))
    return ops.smooth_angles(spatial.knn_join(cells, cells, 6, 15.0).select("src", "dst"), start, 0.5)


def _votes(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet")
    near = ops.nearest_vectors(e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("v")), 10)
    n = near.join(e.select(F.col("vec_id").alias("b"), "label"), "b").groupBy("q", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.col("q").alias("vec_id")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("voted"))


_COS = """u AS (SELECT a.vec_id AS q, b.vec_id AS b, a.label AS la, b.label AS lb, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, b) AS r FROM u)"""


def _two_sample(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", (F.col("label") < 5).alias("side"))
    near = ops.nearest_vectors(e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("v")), 1)
    j = near.join(e.select(F.col("vec_id").alias("q"), F.col("side").alias("sq")), "q").join(e.select(F.col("vec_id").alias("b"), F.col("side").alias("sb")), "b")
    return j.agg(F.round(F.avg((F.col("sq") == F.col("sb")).cast("double")), 6).alias("accuracy"))


def _in_crop(s: SparkSession, d: str) -> DataFrame:
    """The 8 nearest of each cell among those of its 100 um crop."""
    c = view(s, d, "v_cells").withColumn("crop", F.floor(F.col("centroid_x") / 100) * 10_000 + F.floor(F.col("centroid_y") / 100))
    return nearest.nearest(c, c, 8, within=["crop"], far=40.0).select("src", "dst", "rank")


def _dominant(s: SparkSession, d: str) -> DataFrame:
    """The nucleus with most pixels in each cell, more than 5: nuclei are numbered as the cells of the next scene."""
    p = view(s, d, "v_pixels")
    n = p.where("nucleus = 1 and label > 0").select((F.col("scene_id") - 1).alias("scene_id"), "y", "x", F.col("label").alias("nucleus_id"))
    j = p.where("label > 0").join(n, ["scene_id", "y", "x"]).groupBy("scene_id", "label", "nucleus_id").agg(F.count(F.lit(1)).alias("n")).where("n > 5")
    return j.groupBy("scene_id", "label").agg(F.max_by(F.struct("nucleus_id", "n"), F.struct("n", -F.col("nucleus_id"))).alias("m")).select("scene_id", "label", "m.*")


def _centroid_pairs(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "v_cells")
    moved = c.select((F.col("cell_idx") + 1_000_000).alias("cell_idx"), (F.col("centroid_x") + F.col("cell_idx") % 5 - 2).alias("centroid_x"), (F.col("centroid_y") + F.col("cell_idx") % 3 - 1).alias("centroid_y"))
    return spatial.radius_join(c, moved, 5.0).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.sqrt("d2").alias("d"))


def _enriched(s: SparkSession, d: str) -> DataFrame:
    m = tiles.tile_members(view(s, d, "v_cells").where("cell_type is not null"), "centroid_x", "centroid_y", 50.0, 100.0)
    n = m.groupBy("tx", "ty", "cell_type").agg(F.count(F.lit(1)).alias("n"))
    share = n.join(n.groupBy("tx", "ty").agg(F.sum("n").alias("all")), ["tx", "ty"]).where("all >= 10").withColumn("share", F.round(F.col("n") / F.col("all"), 9))
    w = Window.partitionBy("cell_type").orderBy(F.desc("share"), "tx", "ty")
    return share.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("cell_type", "tx", "ty", F.round("share", 6).alias("share"), "rank")


def _ablation(s: SparkSession, d: str) -> DataFrame:
    """A seed cell of each type, the one of smallest number, and the four cells nearest to it."""
    c = view(s, d, "v_cells")
    seeds = c.where("cell_type is not null").groupBy("cell_type").agg(F.min("cell_idx").alias("cell_idx"))
    near = spatial.knn_join(c.join(seeds.select("cell_idx"), "cell_idx", "left_semi"), c, 4, 40.0)
    return near.select(F.col("src").alias("seed"), F.col("dst").alias("cell_idx"), "rank")


def _tile_pixels(s: SparkSession, d: str) -> DataFrame:
    """Scenes as 16 x 16 tiles of one image, a tile each 12 pixels, four to a row."""
    p = view(s, d, "v_pixels").where("y < 16 and x < 16")
    return p.select((F.col("scene_id") % 4 * 12).cast("int").alias("x0"), (F.floor(F.col("scene_id") / 4) * 12).cast("int").alias("y0"), F.col("y").alias("i"), F.col("x").alias("j"), "value")


def _proposed(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d).withColumnRenamed("cell_idx", "mol")
    return ops.propose(p, _clusters(s, d).withColumnRenamed("cell_idx", "mol"), 3)


def _ghosts(s: SparkSession, d: str, share: float = 0.1) -> DataFrame:
    """Per type: how many ghosts make up for the share of free molecules, and which cells, by hashed order, lend their outline."""
    c = view(s, d, "v_cells").where("cell_type is not null")
    n = c.groupBy("cell_type").agg(F.count(F.lit(1)).alias("cells")).withColumn("ghosts", F.rint(F.col("cells") * share / (1 - share)).cast("int"))
    w = Window.partitionBy("cell_type").orderBy(ops.uniform(F.col("cell_idx"), 1), "cell_idx")
    return c.withColumn("r", F.row_number().over(w)).join(n, "cell_type").where("r <= ghosts").select("cell_idx", "cell_type", F.round(0.4 + 0.3 * ops.uniform(F.col("cell_idx"), 2), 6).alias("scale"))


def _kept_ghosts(s: SparkSession, d: str) -> DataFrame:
    """Ghosts kept: in hashed order, dropped until the molecules left are at most 60 % of all."""
    n = view(s, d, "v_molecules").where("cell_id <> 'UNASSIGNED'").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")).join(view(s, d, "v_cells").select("cell_id", "cell_idx"), "cell_id")
    # One whole number that orders by the hash, then by the cell: a fraction added to the hash would outgrow its steps.
    by = n.withColumn("u", F.rint(ops.uniform(F.col("cell_idx"), 5) * 10007).cast("long") * (1 << 47) + F.col("cell_idx"))
    from cellspan.operators.measures import running

    run = running(by.select("u", "n"), "u", ["n"]).withColumnRenamed("n", "upto")
    total = n.agg(F.sum("n").alias("all"))
    return by.join(run, "u").crossJoin(F.broadcast(total)).where("upto <= all * 0.6").select("cell_idx", "n")  # one row


def _injected(s: SparkSession, d: str) -> DataFrame:
    """A tenth of the factor-3 molecules of each BUILDING cell, by hashed order, go to the nearest MACHINERY cell within 25 um."""
    c = view(s, d, "v_cells")
    near = spatial.knn_join(c.where("cell_type = 'BUILDING'"), c.where("cell_type = 'MACHINERY'"), 1, 25.0).select(F.col("src").alias("cell_idx"), F.col("dst").alias("to"))
    m = _molecules(s, d).where("factor = 3").join(c.select("cell_id", "cell_idx"), "cell_id").dropDuplicates(["mol"]).join(near, "cell_idx")
    w = Window.partitionBy("cell_idx")
    m = m.withColumn("r", F.row_number().over(w.orderBy(ops.uniform(F.col("mol") % 1_000_003, 7), "mol"))).withColumn("all", F.count(F.lit(1)).over(w))
    return m.where("r <= floor(all * 0.3)").groupBy("cell_idx", "to").agg(F.count(F.lit(1)).alias("n"))


_NMS = "c AS (SELECT cell_idx, centroid_x AS x, centroid_y AS y FROM v_cells), " + GREEDY.format(order="cell_idx", rows="c", d2="= 100", stop="") + " SELECT cell_idx FROM r JOIN g USING (i)"
_RASTER = """e AS (SELECT cell_idx, vertex_x AS ax, vertex_y AS ay, coalesce(lead(vertex_x) OVER w, first_value(vertex_x) OVER w) AS bx, coalesce(lead(vertex_y) OVER w, first_value(vertex_y) OVER w) AS by_
  FROM v_polygons WINDOW w AS (PARTITION BY cell_idx ORDER BY vertex_ord)),
b AS (SELECT cell_idx, CAST(floor(min(vertex_x)) AS BIGINT) AS x0, CAST(floor(max(vertex_x)) AS BIGINT) AS x1, CAST(floor(min(vertex_y)) AS BIGINT) AS y0, CAST(floor(max(vertex_y)) AS BIGINT) AS y1 FROM v_polygons GROUP BY 1),
q AS (SELECT cell_idx, py, unnest(generate_series(x0, x1)) AS px FROM (SELECT *, unnest(generate_series(y0, y1)) AS py FROM b)),
i AS (SELECT cell_idx, px, py FROM q JOIN e USING (cell_idx) GROUP BY ALL HAVING count(*) FILTER (WHERE (ay > py + 0.5e0) <> (by_ > py + 0.5e0) AND px + 0.5e0 < (bx - ax) / (by_ - ay + 1e-12) * (py + 0.5e0 - ay) + ax) % 2 = 1)
SELECT cell_idx, count(*) AS area FROM (SELECT px, py, max(cell_idx) AS cell_idx FROM i GROUP BY 1, 2) GROUP BY 1"""

#: Queries whose SQL goes step by step.
RECURSIVE = {"nms_thinning"}

ALL = {
    "gmm_em_fixed2": (lambda s, d: _r(_mixture(s, d), "share", "centre", "scale"), _gmm_sql(2)),
    "compartment_responsibilities": (
        lambda s, d: _r(_posterior(s, d), "p0", "p1", "p2", "p3"),
        "m AS (SELECT feature_name, cell_type, overlaps_nucleus AS o, nucleus_distance AS v FROM v_molecules JOIN v_cells USING (cell_id) WHERE cell_type IS NOT NULL), f AS (SELECT *, " + ", ".join(f"{_pdf('v', str(w), str(m), str(c))} AS f{k}" for k, (w, m, c) in enumerate(((0.5, 0.4, 0.4), (0.3, 1.5, 1.0), (0.2, 4.0, 2.5)), 1))
        + " FROM m), g AS (SELECT avg(o) AS g FROM m) SELECT feature_name, cell_type, count(*) AS n, round((50 * any_value(g) + sum(o)) / (50 + count(*)), 6) AS p0, " + ", ".join(f"round((50 * (1 - any_value(g)) * {w} + sum((1 - o) * f{k} / (f1 + f2 + f3))) / (50 + count(*)), 6) AS p{k}" for k, w in enumerate((0.5, 0.3, 0.2), 1)) + " FROM f, g GROUP BY 1, 2 HAVING count(*) >= 20",
    ),
    "em_reassign_1": (
        _reassigned,
        f"""{_MOLS}, u AS (SELECT mol, min(factor) AS factor, min(cell) AS cell FROM m GROUP BY 1), h AS (SELECT cell, factor, count(*) / sum(count(*)) OVER (PARTITION BY cell) AS h FROM u GROUP BY 1, 2),
        {_NEAR}, c AS (SELECT mol, factor, cell AS was, cell, 2 AS b FROM u UNION ALL SELECT mol, factor, cell, dst, 1 FROM u JOIN e ON src = cell AND d2 <= 64),
        s AS (SELECT c.*, row_number() OVER (PARTITION BY mol ORDER BY round(coalesce(h, 1e-6) * b, 12) DESC, c.cell) AS r FROM c LEFT JOIN h ON h.cell = c.cell AND h.factor = c.factor) SELECT was, factor, count(*) AS n FROM s WHERE r = 1 AND cell <> was GROUP BY 1, 2""",
    ),
    "dbscan_components": (_clusters, f"{_DB} SELECT node AS cell_idx, seed AS cluster FROM z"),
    "transcript_proposer": (lambda s, d: _r(_proposed(s, d), "cx", "cy", "radius"), f"{_DB}, p AS (SELECT seed AS cluster, centroid_x AS x, centroid_y AS y, cell_idx % 7 + 1 AS factor FROM z JOIN v_cells ON node = cell_idx), f AS (SELECT cluster, factor, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, factor) AS r FROM p GROUP BY 1, 2) SELECT cluster, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(sqrt(var_pop(x) + var_pop(y)), 6) AS radius, any_value(f.factor) AS factor FROM p JOIN f USING (cluster) WHERE r = 1 GROUP BY 1 HAVING count(*) >= 3"),
    "gibbs_types": (_relaxed, None),
    "tilt_mrf": (lambda s, d: _r(_tilts(s, d), "angle"), None),
    "latent_knn_vote": (_votes, f"{_COS} SELECT q AS vec_id, first(lb ORDER BY n DESC, lb) AS voted FROM (SELECT q, lb, count(*) AS n FROM k WHERE r <= 10 GROUP BY 1, 2) GROUP BY 1"),
    "two_sample_nn": (_two_sample, f"{_COS} SELECT round(avg(((la < 5) = (lb < 5))::INT), 6) AS accuracy FROM k WHERE r = 1"),
    "knn_in_crop": (
        _in_crop,
        "c AS (SELECT *, CAST(floor(centroid_x / 100) * 10000 + floor(centroid_y / 100) AS BIGINT) AS crop FROM v_cells), k AS (SELECT a.cell_idx AS src, b.cell_idx AS dst, row_number() OVER (PARTITION BY a.cell_idx ORDER BY (a.centroid_x - b.centroid_x) * (a.centroid_x - b.centroid_x) + (a.centroid_y - b.centroid_y) * (a.centroid_y - b.centroid_y), b.cell_idx) AS rank FROM c a JOIN c b ON a.crop = b.crop AND a.cell_idx <> b.cell_idx AND power(a.centroid_x - b.centroid_x, 2) + power(a.centroid_y - b.centroid_y, 2) <= 1600) SELECT src, dst, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 8",
    ),
    "dominant_nucleus": (
        _dominant,
        "n AS (SELECT a.scene_id, a.label, b.label AS nucleus_id, count(*) AS n FROM v_pixels a JOIN v_pixels b ON b.scene_id = a.scene_id + 1 AND a.y = b.y AND a.x = b.x WHERE a.label > 0 AND b.label > 0 AND b.nucleus = 1 GROUP BY 1, 2, 3 HAVING count(*) > 5) SELECT scene_id, label, nucleus_id, n FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, label ORDER BY n DESC, nucleus_id) AS r FROM n) WHERE r = 1",
    ),
    "centroid_match": (lambda s, d: _r(ops.greedy_matches(_centroid_pairs(s, d)), "d"), None),
    "density_rank": (
        lambda s, d: tiles.bin_density(view(s, d, "v_cells"), "cell_idx", "centroid_x", "centroid_y", 40.0).join(view(s, d, "v_cells").select("cell_idx", "cell_id", "centroid_x", "centroid_y"), "cell_idx").orderBy(F.desc("density"), "centroid_x", "centroid_y", "cell_id").limit(20).select("cell_id", "density"),
        "g AS (SELECT floor(centroid_x / 40) AS gx, floor(centroid_y / 40) AS gy, count(*) AS n FROM v_cells GROUP BY 1, 2) SELECT cell_id, CAST(sum(n) AS BIGINT) AS density FROM v_cells JOIN g ON gx BETWEEN floor(centroid_x / 40) - 1 AND floor(centroid_x / 40) + 1 AND gy BETWEEN floor(centroid_y / 40) - 1 AND floor(centroid_y / 40) + 1 GROUP BY cell_id, centroid_x, centroid_y ORDER BY density DESC, centroid_x, centroid_y, cell_id LIMIT 20",
    ),
    "enriched_windows": (
        _enriched,
        """m AS (SELECT cell_type, tx, ty FROM (SELECT *, unnest(generate_series(CAST(floor((centroid_x - 100) / 50) AS BIGINT) + 1, CAST(floor(centroid_x / 50) AS BIGINT))) AS tx FROM v_cells WHERE cell_type IS NOT NULL) c, generate_series(CAST(floor((centroid_y - 100) / 50) AS BIGINT) + 1, CAST(floor(centroid_y / 50) AS BIGINT)) t(ty)),
        n AS (SELECT tx, ty, cell_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY tx, ty) AS total FROM m GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY round(n / total, 9) DESC, tx, ty) AS rank FROM n WHERE total >= 10) SELECT cell_type, tx, ty, round(n / total, 6) AS share, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""",
    ),
    "nms_thinning": (lambda s, d: ops.thin(view(s, d, "v_cells"), 10.0, "cell_idx", "centroid_x", "centroid_y").select("cell_idx"), _NMS),
    "top_objects": (lambda s, d: view(s, d, "v_cells").select("cell_idx", (F.col("cell_area") * F.col("nucleus_area")).alias("score")).orderBy(F.desc("score"), "cell_idx").limit(64), "SELECT cell_idx, cell_area * nucleus_area AS score FROM v_cells ORDER BY score DESC, cell_idx LIMIT 64"),
    "top5_scores": (
        lambda s, d: view(s, d, "v_molecules").where("cell_id <> 'UNASSIGNED'").groupBy("cell_id", "factor").agg(F.count(F.lit(1)).alias("n")).groupBy("cell_id").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "factor"))), 1, 5), lambda v: F.concat_ws(":", v["factor"].cast("string"), (-v["m"]).cast("string"))), ",").alias("top")),
        "SELECT cell_id, string_agg(concat(factor, ':', n), ',' ORDER BY n DESC, factor) AS top FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, factor) AS r FROM (SELECT cell_id, factor, count(*) AS n FROM v_molecules WHERE cell_id <> 'UNASSIGNED' GROUP BY 1, 2)) WHERE r <= 5 GROUP BY 1",
    ),
    "ablation_set": (
        _ablation,
        f"{_NEAR.replace('25 ', '40 ').replace('+ 25', '+ 40').replace('- 25', '- 40')}, s AS (SELECT min(cell_idx) AS i FROM v_cells WHERE cell_type IS NOT NULL GROUP BY cell_type), k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS r FROM e JOIN s ON i = src WHERE d2 <= 1600) SELECT src AS seed, dst AS cell_idx, CAST(r AS INTEGER) AS rank FROM k WHERE r <= 4",
    ),
    "bucket_cap": (
        lambda s, d: ranks.first_of_group(view(s, d, "v_cells").where("cell_type is not null").withColumn("u", ops.uniform(F.col("cell_idx"), 4)), "cell_type", ["u", "cell_idx"], 10).select("cell_type", "cell_idx"),
        "SELECT cell_type, cell_idx FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY (cell_idx * 7919 + 4 * 104729) % 10007, cell_idx) AS r FROM v_cells WHERE cell_type IS NOT NULL) WHERE r <= 10",
    ),
    "tiles_union_all": (
        lambda s, d: tiles.tile_members(view(s, d, "v_cells"), "centroid_x", "centroid_y", 60.0, 80.0).where("owned").select("cell_id", F.lit("owned").alias("kind")).unionByName(tiles.tile_members(view(s, d, "v_cells"), "centroid_x", "centroid_y", 60.0, 80.0).where("not owned").select("cell_id", F.lit("halo").alias("kind"))).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")),
        "SELECT cell_id, CAST((floor(centroid_x / 60) - floor((centroid_x - 80) / 60)) * (floor(centroid_y / 60) - floor((centroid_y - 80) / 60)) AS BIGINT) AS n FROM v_cells",
    ),
    "union_distinct_priority": (
        lambda s, d: view(s, d, "v_cells").where("cell_idx % 2 = 0").select("cell_idx", F.lit("image").alias("kind")).unionByName(view(s, d, "v_cells").where("cell_idx % 2 = 1").join(spatial.radius_join(view(s, d, "v_cells").where("cell_idx % 2 = 1"), view(s, d, "v_cells").where("cell_idx % 2 = 0"), 8.0).select(F.col("src").alias("cell_idx")), "cell_idx", "left_anti").select("cell_idx", F.lit("transcripts").alias("kind"))),
        f"{_NEAR} SELECT cell_idx, 'image' AS kind FROM v_cells WHERE cell_idx % 2 = 0 UNION ALL SELECT cell_idx, 'transcripts' FROM v_cells WHERE cell_idx % 2 = 1 AND cell_idx NOT IN (SELECT src FROM e WHERE d2 <= 64 AND dst % 2 = 0)",
    ),
    "tile_grid": (
        lambda s, d: _r(raster.tile_grid(_bounds(s, d), 80.0, 60.0), "x0", "y0"),
        f"{_BOUNDS}, n AS (SELECT *, greatest(1, CAST(ceil((xmax - xmin - 80) / 60) AS BIGINT) + 1) AS nx, greatest(1, CAST(ceil((ymax - ymin - 80) / 60) AS BIGINT) + 1) AS ny FROM b) SELECT ty * nx + tx AS tile_idx, tx, ty, round(xmin + tx * 60, 6) AS x0, round(ymin + ty * 60, 6) AS y0 FROM (SELECT *, unnest(range(ny)) AS ty FROM n), LATERAL (SELECT unnest(range(nx)) AS tx)",
    ),
    "tile_first_owner": (
        lambda s, d: raster.owners(tiles.tile_members(view(s, d, "v_cells"), "centroid_x", "centroid_y", 60.0, 80.0), 1000),
        "SELECT cell_id, CAST((floor((centroid_y - 80) / 60) + 1) * 1000 + floor((centroid_x - 80) / 60) + 1 AS BIGINT) AS tile FROM v_cells",
    ),
    "ghost_id_remap": (
        lambda s, d: view(s, d, "v_cells").where("cell_type is null").withColumn("tile", F.floor(F.col("centroid_x") / 60)).withColumn("ghost", F.row_number().over(Window.partitionBy("tile").orderBy("cell_idx")) - 1).transform(lambda g: g.join(g.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "tile")).select("cell_idx", (F.col("ghost") + F.col("ahead")).alias("ghost_id")),
        "SELECT cell_idx, row_number() OVER (ORDER BY floor(centroid_x / 60), cell_idx) - 1 AS ghost_id FROM v_cells WHERE cell_type IS NULL",
    ),
    "feather_stitch": (
        lambda s, d: _r(raster.feather(_tile_pixels(s, d), 16, 4), "value"),
        "t AS (SELECT floor(scene_id / 4) * 12 + y AS y, scene_id % 4 * 12 + x AS x, least((x + 1) / 5e0, (16 - x) / 5e0, 1) * least((y + 1) / 5e0, (16 - y) / 5e0, 1) AS w, value FROM v_pixels WHERE y < 16 AND x < 16) SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(sum(w * value) / greatest(sum(w), 1e-6), 6) AS value FROM t GROUP BY 1, 2",
    ),
    "bridge_weights": (
        lambda s, d: _r(view(s, d, "v_pixels").groupBy("scene_id").agg((F.sum(raster.bridge(F.col("x"), 25) * raster.bridge(F.col("y"), 25) * F.col("value")) / F.sum(raster.bridge(F.col("x"), 25) * raster.bridge(F.col("y"), 25))).alias("mean")), "mean"),
        "w AS (SELECT *, power(cos(((x + 0.5) / 25 - 0.5) * pi()), 2) * power(cos(((y + 0.5) / 25 - 0.5) * pi()), 2) AS w FROM v_pixels) SELECT scene_id, round(sum(w * value) / sum(w), 6) AS mean FROM w GROUP BY 1",
    ),
    "strip_ready": (
        lambda s, d: _tile_pixels(s, d).groupBy(F.floor(F.col("y0") / 12).alias("row")).agg(F.count_distinct("x0").alias("tiles")).withColumn("ready", F.col("tiles") + F.coalesce(F.lag("tiles").over(Window.orderBy("row")), F.lit(4)) == 8),
        "r AS (SELECT CAST(floor(scene_id / 4) AS BIGINT) AS row, count(DISTINCT scene_id % 4) AS tiles FROM v_pixels GROUP BY 1) SELECT row, tiles, tiles + coalesce(lag(tiles) OVER (ORDER BY row), 4) = 8 AS ready FROM r",
    ),
    "calibrate_uint16": (
        lambda s, d: view(s, d, "v_pixels").where("label > 0").groupBy("scene_id", "label").agg(*(F.sum(raster.calibrate(F.col("value") - 0.1, m, F.lit(100.0), F.lit(3000.0), F.lit(0.8), F.lit(5000.0))).alias(m) for m in ("none", "lut_native", "lut_zerofloor", "scale"))),
        "p AS (SELECT scene_id, label, greatest(value - 0.1e0, 0) AS v FROM v_pixels WHERE label > 0) SELECT scene_id, label, CAST(sum(round_even(v * 4095, 0)) AS BIGINT) AS none, CAST(sum(floor(100 + v * 2900)) AS BIGINT) AS lut_native, CAST(sum(floor(v * 3000)) AS BIGINT) AS lut_zerofloor, CAST(sum(floor(v * 5000e0 / 0.8e0)) AS BIGINT) AS scale FROM p GROUP BY 1, 2",
    ),
    "pyramid_2x": (lambda s, d: _r(raster.pyramid(view(s, d, "v_pixels")), "value"), "SELECT scene_id, CAST(floor(y / 2) AS BIGINT) AS y2, CAST(floor(x / 2) AS BIGINT) AS x2, round(avg(value), 6) AS value FROM v_pixels GROUP BY 1, 2, 3"),
    "rasterise_last": (lambda s, d: raster.rasterise(view(s, d, "v_polygons"), 1.0, True).groupBy("cell_idx").agg(F.count(F.lit(1)).alias("area")), _RASTER),
    "erode_labels": (
        lambda s, d: raster.erode(view(s, d, "v_pixels")).groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("area")),
        "SELECT scene_id, label, count(*) AS area FROM (SELECT a.scene_id, a.label, a.y, a.x FROM v_pixels a JOIN v_pixels b ON a.scene_id = b.scene_id AND a.label = b.label AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 WHERE a.label > 0 GROUP BY 1, 2, 3, 4 HAVING count(*) = 9) GROUP BY 1, 2",
    ),
    "boundary_pixels": (
        lambda s, d: raster.boundary(view(s, d, "v_pixels")).groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n")),
        "SELECT scene_id, label, count(*) AS n FROM (SELECT a.scene_id, a.label, a.y, a.x FROM v_pixels a JOIN v_pixels b ON a.scene_id = b.scene_id AND a.label = b.label AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 WHERE a.label > 0 GROUP BY 1, 2, 3, 4 HAVING count(*) < 9) GROUP BY 1, 2",
    ),
    "dilate_labels": (
        lambda s, d: raster.dilate(view(s, d, "v_pixels")).groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("area")),
        "g AS (SELECT a.scene_id, a.y, a.x, any_value(a.label) AS own, coalesce(max(b.label), 0) AS near FROM v_pixels a LEFT JOIN v_pixels b ON a.scene_id = b.scene_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND b.label > 0 GROUP BY 1, 2, 3) SELECT scene_id, CASE WHEN own > 0 THEN own ELSE near END AS label, count(*) AS area FROM g GROUP BY 1, 2",
    ),
    "distance_transform": (
        lambda s, d: raster.distance_to_background(view(s, d, "v_pixels"), 6),
        "SELECT a.scene_id, a.y, a.x, CAST(least(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)), 36) AS BIGINT) AS d2 FROM v_pixels a JOIN v_pixels b ON a.scene_id = b.scene_id WHERE a.label > 0 AND b.label = 0 GROUP BY 1, 2, 3",
    ),
    "principal_axis": (
        lambda s, d: _r(raster.principal_axis(view(s, d, "v_polygons").where("vertex_ord <> 1")), "ax", "ay"),
        "s AS (SELECT cell_id, 0.5 * atan2(2 * covar_pop(vertex_x, vertex_y), var_pop(vertex_x) - var_pop(vertex_y)) AS t FROM v_polygons WHERE vertex_ord <> 1 GROUP BY 1) SELECT cell_id, round(cos(t), 6) AS ax, round(sin(t), 6) AS ay FROM s",
    ),
    "label_overlap_scenes": (
        lambda s, d: _r(_matches(s, d), "iou"), f"{_MATCH} SELECT scene_id, la, lb, round(iou, 6) AS iou FROM m",
    ),
    "neighbor_prior": (
        lambda s, d: _r(stats.neighbor_matrix(spatial.knn_join(view(s, d, "v_cells"), view(s, d, "v_cells"), 12, 15.0), view(s, d, "v_cells")).groupBy("type_b").agg(F.sum("n").alias("n")).transform(lambda t: t.crossJoin(F.broadcast(t.agg(F.sum("n").alias("all"))))).select(F.col("type_b").alias("cell_type"), (F.col("n") / F.col("all")).alias("prior")), "prior"),
        f"{_NEAR}, k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS r FROM e WHERE d2 <= 225), n AS (SELECT b.cell_type, count(*) AS n FROM k JOIN v_cells a ON a.cell_idx = src JOIN v_cells b ON b.cell_idx = dst WHERE r <= 12 AND a.cell_type IS NOT NULL AND b.cell_type IS NOT NULL GROUP BY 1) SELECT cell_type, round(n / sum(n) OVER (), 6) AS prior FROM n",
    ),
    "ghost_cells": (
        _ghosts,
        "c AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY (cell_idx * 7919 + 104729) % 10007, cell_idx) AS r, count(*) OVER (PARTITION BY cell_type) AS n FROM v_cells WHERE cell_type IS NOT NULL) SELECT cell_idx, cell_type, round(0.4e0 + 0.3e0 * ((cell_idx * 7919 + 2 * 104729) % 10007) / 10007e0, 6) AS scale FROM c WHERE r <= round_even(n * 0.1e0 / 0.9e0, 0)",
    ),
    "drop_ghosts_to_target": (
        _kept_ghosts,
        "n AS (SELECT cell_idx, count(*) AS n FROM v_molecules m JOIN v_cells c USING (cell_id) GROUP BY 1), r AS (SELECT cell_idx, n, sum(n) OVER (ORDER BY (cell_idx * 7919 + 5 * 104729) % 10007, cell_idx) AS upto, sum(n) OVER () AS total FROM n) SELECT cell_idx, n FROM r WHERE upto <= total * 0.6e0",
    ),
    "inject_admixture": (
        _injected,
        f"""{_NEAR}, t AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS r FROM e JOIN v_cells a ON a.cell_idx = src AND a.cell_type = 'BUILDING' JOIN v_cells b ON b.cell_idx = dst AND b.cell_type = 'MACHINERY' WHERE d2 <= 625) WHERE r = 1),
        {_MOLS}, u AS (SELECT DISTINCT mol, cell FROM m WHERE factor = 3), n AS (SELECT cell, count(*) AS n FROM u GROUP BY 1) SELECT src AS cell_idx, dst AS to, CAST(floor(n * 0.3) AS BIGINT) AS n FROM t JOIN n ON cell = src WHERE floor(n * 0.3) >= 1""",
    ),
    "unobserved_seeds": (
        lambda s, d: view(s, d, "v_cells").where("cell_type is not null").withColumn("zone", F.floor(F.col("centroid_x") / 200)).groupBy("cell_type", "zone").agg(F.count(F.lit(1)).alias("n")).select("cell_type", "zone", F.rint(F.col("n") * 0.35).cast("int").alias("seeds")),
        "SELECT cell_type, CAST(floor(centroid_x / 200) AS BIGINT) AS zone, CAST(round_even(count(*) * 0.35e0, 0) AS INTEGER) AS seeds FROM v_cells WHERE cell_type IS NOT NULL GROUP BY 1, 2",
    ),
}
