"""Rows of cells, molecules and labels: predicates, lookups and tables derived by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspan.functions import columns
from cellspan.operators.quantiles import wide_quantiles


def edge_touching(stats: DataFrame, bounds: DataFrame, margin: float = 0.0) -> DataFrame:
    """stats with touches_edge: half the major axis around the centroid leaves the bounds (one row) less margin."""
    r = F.col("major") / 2
    touches = (F.col("cx") - r < F.col("xmin") + margin) | (F.col("cx") + r > F.col("xmax") - margin) | (F.col("cy") - r < F.col("ymin") + margin) | (F.col("cy") + r > F.col("ymax") - margin)
    return stats.crossJoin(F.broadcast(bounds)).withColumn("touches_edge", touches).drop(*bounds.columns)  # one row


def crops_within(crops: DataFrame, bounds: DataFrame) -> DataFrame:
    """Crops that lie inside the bounds (one row of xmin, xmax, ymin, ymax) as a whole."""
    b = bounds.select(*(F.col(c).alias(f"b{c}") for c in ("xmin", "xmax", "ymin", "ymax")))
    return crops.crossJoin(F.broadcast(b)).where("xmin >= bxmin and xmax <= bxmax and ymin >= bymin and ymax <= bymax").select(*crops.columns)  # one row


def override_splits(crops: DataFrame, regions: DataFrame, split: str = "split", most: int = 10_000) -> DataFrame:
    """crops whose centre lies in a region (xmin, xmax, ymin, ymax, region_split) take its split, test before val.

    Up to ``most`` regions are broadcast; more of them meet the crops in the squares that they cover.
    """
    r = regions.select(*(F.col(c).alias(f"r{c}") for c in ("xmin", "xmax", "ymin", "ymax")), "region_split").distinct()  # equal regions meet a crop once
    x, y = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    inside = (x >= F.col("rxmin")) & (x <= F.col("rxmax")) & (y >= F.col("rymin")) & (y <= F.col("rymax"))
    few = r.limit(most + 1).count() <= most
    if few:
        met = crops.join(F.broadcast(r), inside)  # most rows at most
    else:  # Regions go to the squares that they cover, as large as a region is on average; a crop's centre lies in one.
        side = r.agg(F.avg(F.greatest(F.col("rxmax") - F.col("rxmin"), F.col("rymax") - F.col("rymin")))).first()[0] or 1.0
        cell = lambda v: F.floor(v / side)
        for g, a in (("gx", "x"), ("gy", "y")):
            r = r.withColumn(g, F.explode(F.sequence(cell(F.col(f"r{a}min")), cell(F.col(f"r{a}max")))))
        met = crops.withColumns({"gx": cell(x), "gy": cell(y)}).join(r, ["gx", "gy"]).where(inside)
    # 'test' < 'val'; a least string is found by sorting, so only the unlike splits of a crop go there.
    hit = met.select("crop_id", "region_split").distinct().groupBy("crop_id").agg(F.min("region_split").alias("region_split"))
    return crops.join(hit, "crop_id", "left").withColumn(split, F.coalesce("region_split", split)).drop("region_split")


def checkerboard(crops: DataFrame) -> DataFrame:
    """split of crops by the medians of their centres: high x and y is test, low x and high y is val, the rest train; fewer than three are train."""
    x, y = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    mid = wide_quantiles(crops, [], {"x": x, "y": y}, {"50": 0.5}).select(F.col("x_50").alias("mx"), F.col("y_50").alias("my"), F.col("x_n").alias("n"))
    split = F.when((F.col("n") < 3) | (y < F.col("my")), "train").when(x >= F.col("mx"), "test").otherwise("val")
    return crops.crossJoin(F.broadcast(mid)).withColumn("split", split).drop("mx", "my", "n")  # one row


def px(v: Column, origin: Column, pixel: float) -> Column:
    """Pixel of a position, half to even."""
    return F.rint((v - origin) / pixel).cast("int")


def pixel_bounds(boxes: DataFrame, pixel: float) -> DataFrame:
    """Boxes in pixels: starts rounded down, ends up."""
    low, high = (lambda c: F.floor(F.col(c) / pixel)), (lambda c: F.ceil(F.col(c) / pixel))
    return boxes.select("crop_id", low("xmin").alias("x0"), high("xmax").alias("x1"), low("ymin").alias("y0"), high("ymax").alias("y1"))


def ablate(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """Pixels of the given labels (scene_id, label) become background."""
    gone = labels.select("scene_id", "label").distinct().withColumn("gone", F.lit(True))
    return pixels.join(gone, ["scene_id", "label"], "left").withColumn("label", F.when(F.col("gone"), 0).otherwise(F.col("label"))).drop("gone")


def merge_labels(pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pixels of ``from`` labels take the label that the pair (scene_id, from, to) names."""
    p = pairs.select("scene_id", F.col("from").alias("label"), "to")
    return pixels.join(p, ["scene_id", "label"], "left").withColumn("label", F.coalesce("to", "label")).drop("to")


def split_labels(pixels: DataFrame, centroids: DataFrame, offset: int) -> DataFrame:
    """Labels cut in two at their mean x: the right half's label is raised by offset."""
    c = centroids.select("scene_id", "label", "cx")
    right = (F.col("label") > 0) & (F.col("x") > F.col("cx"))
    return pixels.join(c, ["scene_id", "label"], "left").withColumn("label", F.when(right, F.col("label") + offset).otherwise(F.col("label"))).drop("cx")


def move_cells(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Scene edits (cell_id, action, cell_type, dx, dy): remove drops a cell, retype names its type, move shifts it, copy adds a shifted one."""
    e = edits.select("cell_id", "action", F.col("cell_type").alias("new_type"), "dx", "dy")
    j = cells.join(e, "cell_id", "left")
    shift = lambda c, d, on: F.when(F.col("action").isin(on), F.col(c) + F.col(d)).otherwise(F.col(c)).alias(c)
    type_ = F.when(F.col("action") == "retype", F.col("new_type")).otherwise(F.col("cell_type")).alias("cell_type")
    kept = j.where("action is null or action <> 'remove'").select("cell_id", type_, shift("centroid_x", "dx", ["move"]), shift("centroid_y", "dy", ["move"]))
    copies = j.where("action = 'copy'").select(F.concat("cell_id", F.lit("_copy")).alias("cell_id"), "cell_type", shift("centroid_x", "dx", ["copy"]), shift("centroid_y", "dy", ["copy"]))
    return kept.unionByName(copies)


def cross_section(cells: DataFrame, z: float) -> DataFrame:
    """Radius factor and shift of each cell's section at z: sqrt(1 - (dz / h)^2) within its half extent, shift along its tilt."""
    dz, h = F.lit(z) - F.col("z_center_um"), F.col("z_extent_um") / 2
    tau = F.sqrt(F.greatest(F.lit(0.0), 1 - dz * dz / (h * h)))
    return cells.where(F.abs(dz) < h).select("cell_id", tau.alias("tau"), (dz * F.col("t_x") / F.greatest(F.col("t_z"), F.lit(1e-3))).alias("shift_x"))


def type_params(types: DataFrame, params: dict[str, float], default: float) -> DataFrame:
    """types with the parameter of a map that names it, or the default."""
    table = F.create_map(*(F.lit(v) for kv in params.items() for v in kv))
    return types.withColumn("param", F.coalesce(F.element_at(table, F.col("cell_type")), F.lit(default)))


def template_bank(polygons: DataFrame, annotation: DataFrame, zones: DataFrame) -> DataFrame:
    """Per cell its vertices about their mean, with type ('unknown' if none) and zone (0 if none); the right sides are made unique first."""
    mean = polygons.groupBy("cell_id").agg(F.avg("vertex_x").alias("mx"), F.avg("vertex_y").alias("my"), F.sort_array(F.collect_list(F.struct("vertex_ord", "vertex_x", "vertex_y"))).alias("v"))
    one = lambda d, c: d.groupBy("cell_id").agg(F.min(c).alias(c))
    out = mean.join(one(annotation, "cell_type"), "cell_id", "left").join(one(zones, "zone"), "cell_id", "left")
    rel = lambda c, m: F.transform("v", lambda p: p[c] - F.col(m))
    return out.select(
        "cell_id", F.col("mx").alias("centroid_x"), F.col("my").alias("centroid_y"), rel("vertex_x", "mx").alias("vertex_x_rel"), rel("vertex_y", "my").alias("vertex_y_rel"),
        F.size("v").alias("n_vertices"), F.coalesce("cell_type", F.lit("unknown")).alias("cell_type"), F.coalesce("zone", F.lit(0)).alias("zone"),
    )


def anchor_records(cells: DataFrame, nuclei: DataFrame, annotation: DataFrame) -> DataFrame:
    """(cell_id, cx, cy, n_cell, n_nucleus, cell_type): outlines joined by id; a cell without a nucleus outline takes its own, without a type 'unknown'."""
    ring = lambda d, n: d.groupBy("cell_id").agg(F.avg("vertex_x").alias(f"x{n}"), F.avg("vertex_y").alias(f"y{n}"), F.count(F.lit(1)).alias(n))
    j = ring(cells, "n_cell").join(ring(nuclei, "n_nucleus"), "cell_id", "left").join(annotation, "cell_id", "left")
    return j.select("cell_id", F.col("xn_cell").alias("cx"), F.col("yn_cell").alias("cy"), "n_cell", F.coalesce("n_nucleus", "n_cell").alias("n_nucleus"), F.coalesce("cell_type", F.lit("unknown")).alias("cell_type"))


def unassigned_with_factors(molecules: DataFrame, least_qv: float) -> DataFrame:
    """Molecules of no cell with their gene's best factor and its margin over the second; loadings are counts of a gene's molecules."""
    n = molecules.groupBy("feature_name", "factor").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature_name").orderBy(F.desc("n"), "factor")  # as many rows as factors
    top = n.select("feature_name", "factor", "n", F.row_number().over(w).alias("r"), F.lead("n").over(w).alias("next")).where("r = 1")
    n2 = F.coalesce("next", F.lit(0))
    top = top.select("feature_name", F.col("factor").alias("gene_factor"), ((F.col("n") - n2) / (F.col("n") + n2 + F.lit(1e-12))).alias("margin"))
    free = molecules.where((F.col("cell_id") == "UNASSIGNED") & (F.col("qv") >= least_qv))
    return free.join(top, "feature_name").select("x_location", "y_location", "qv", "feature_name", "gene_factor", "margin")


def drop_ghosts(molecules: DataFrame, ghosts: DataFrame) -> DataFrame:
    return molecules.join(ghosts.select("cell_id"), "cell_id", "left_anti")


def compartment_lookup(molecules: DataFrame, by_pair: DataFrame, by_gene: DataFrame, overall: float) -> DataFrame:
    """Each molecule's rate: that of its gene and type, else of its gene, else overall."""
    j = molecules.join(by_pair, ["feature_name", "cell_type"], "left").join(by_gene, "feature_name", "left")
    return j.withColumn("p", F.coalesce("pair_rate", "gene_rate", F.lit(overall)))


def contract(rules: dict[str, DataFrame], key: str) -> DataFrame:
    """(rule, n, sample) of the rows that break each rule; a frame holds the rows that break its rule."""
    out = None
    for name, rows in rules.items():
        part = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.col(key).cast("string")).alias("sample")).select(F.lit(name).alias("rule"), "n", "sample")
        out = part if out is None else out.unionByName(part)
    return out


def assert_contract(violations: DataFrame) -> None:
    bad = violations.where("n > 0").limit(20).collect()  # a row for each rule
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['n']} rows, such as {r['sample']}" for r in bad))


def evidence_json(sources: dict[str, Column]) -> Column:
    """Sources as JSON with keys in order, nulls left out."""
    return F.to_json(F.struct(*(sources[k].alias(k) for k in sorted(sources))))


def resolve_types(rows: DataFrame, tiers: list[tuple[str, Column, Column]]) -> DataFrame:
    """rows with cell_type, cell_type_source, confidence in [0, 1] and evidence: the first tier (name, type, confidence) that names a type; 'unknown' is none."""
    named = [(n, F.when(~F.lower(F.trim(t)).isin("", "unknown", "nan"), t), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))) for n, t, c in tiers]
    pick = lambda f, last: F.coalesce(*(F.when(t.isNotNull(), f(n, t, c)) for n, t, c in named), last)
    out = rows.withColumns({"resolved": pick(lambda n, t, c: t, F.lit(None).cast("string")), "source": pick(lambda n, t, c: F.lit(n), F.lit("unresolved")), "confidence": pick(lambda n, t, c: c, F.lit(0.0))})
    return out.withColumn("evidence", evidence_json({n: t for n, t, _ in named}))


def cosine_classify(vectors: DataFrame, centroids: DataFrame, temperature: float = 8.0, no_signal: float = 1.0) -> DataFrame:
    """(cell_id, top type, cosine_top, margin, uncertainty, type_scores of the five best) of vectors (cell_id, h) against centroids (cell_type, c).

    uncertainty: entropy of softmax(temperature * cosine) over ln(types), raised where the best cosine is low.  Vectors
    of no length have no result.  centroids has a row for each type.
    """
    long = vectors.where(columns.dot(F.col("h"), F.col("h")) > 1e-24).crossJoin(F.broadcast(centroids))  # a row for each type
    s = long.withColumn("cos", columns.cosine(F.col("h"), F.col("c"))).groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("cos")).alias("m"), F.col("cell_type").alias("t")))).alias("s"))
    top, second = -F.col("s")[0]["m"], F.coalesce(-F.get("s", F.lit(1))["m"], F.lit(0.0))
    e = F.transform("s", lambda v: F.exp(temperature * (-v["m"] - top)))
    s = s.withColumn("e", e).withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    entropy = F.aggregate("e", F.lit(0.0), lambda a, v: a - v / F.col("z") * F.ln(v / F.col("z") + 1e-12))
    lack = F.least(F.greatest(1 - top, F.lit(0.0)), F.lit(1.0))
    return s.select(
        "cell_id", F.col("s")[0]["t"].alias("cell_type"), top.alias("cosine_top"), F.greatest(F.lit(0.0), 1 - (top - second)).alias("uncertainty_margin"),
        F.when(F.size("s") > 1, entropy / F.ln(F.size("s")) * (1 + no_signal * lack)).otherwise(0.0).alias("uncertainty"),
        F.to_json(F.transform(F.slice("s", 1, 5), lambda v: v["t"])).alias("best_types"),
    )


def scale_admixture(alpha: DataFrame, mult: float) -> DataFrame:
    """alpha (cell_type, factor, alpha, admixed) with the mass of admixed factors times mult, 0.95 at most, the rest filled by the others."""
    w = Window.partitionBy("cell_type")
    bad = F.sum(F.when(F.col("admixed"), F.col("alpha")).otherwise(0.0)).over(w)
    own, new = F.sum("alpha").over(w) - bad, F.least(F.lit(0.95), F.greatest(F.lit(0.0), bad * mult))
    scaled = F.when(F.col("admixed"), F.when(bad > 1e-12, F.col("alpha") * new / bad).otherwise(F.col("alpha"))).otherwise(F.when(own > 1e-12, F.col("alpha") * (1 - new) / own).otherwise(F.col("alpha")))
    some = F.max("admixed").over(w)
    rows = alpha.withColumn("scaled", F.when(some, scaled).otherwise(F.col("alpha")))
    return rows.withColumn("scaled", F.when(some, F.col("scaled") / F.greatest(F.sum("scaled").over(w), F.lit(1e-12))).otherwise(F.col("scaled")))
