"""Tiles, stitching and pixels as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspan.functions.columns import clip


def tile_grid(bounds: DataFrame, size: float, step: float) -> DataFrame:
    """(tile_idx, tx, ty, x0, y0) of the tiles over bounds (one row): max(1, ceil((width - size) / step) + 1) a side."""
    n = lambda a, b: F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a) - size) / step) + 1)
    g = bounds.withColumn("nx", n("xmin", "xmax")).withColumn("ny", n("ymin", "ymax"))
    g = g.withColumn("ty", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    return g.select((F.col("ty") * F.col("nx") + F.col("tx")).alias("tile_idx"), "tx", "ty", (F.col("xmin") + F.col("tx") * step).alias("x0"), (F.col("ymin") + F.col("ty") * step).alias("y0"))


def owners(members: DataFrame, tiles_x: int) -> DataFrame:
    """(cell_id, tile): of the tiles that hold a cell, the one of the smallest number claims it."""
    return members.groupBy("cell_id").agg(F.min(F.col("ty") * tiles_x + F.col("tx")).alias("tile"))


def ramp(at: Column, size: int, overlap: int) -> Column:
    """Linear weight of a pixel in a tile of size: (k + 1) / (overlap + 1) towards either side, 1 in the middle."""
    return F.least((at + 1) / (overlap + 1), (F.lit(size) - at) / (overlap + 1), F.lit(1.0))


def feather(tiles: DataFrame, size: int, overlap: int) -> DataFrame:
    """(y, x, value) of tiles (x0, y0, i, j, value) that overlap: weighted means, weights falling towards each tile's edges."""
    w = ramp(F.col("j"), size, overlap) * ramp(F.col("i"), size, overlap)
    p = tiles.select((F.col("y0") + F.col("i")).alias("y"), (F.col("x0") + F.col("j")).alias("x"), w.alias("w"), "value")
    return p.groupBy("y", "x").agg((F.sum(F.col("w") * F.col("value")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("value"))


def bridge(at: Column, size: int) -> Column:
    """cos-squared weight of a pixel: 1 in the middle of a tile, 0 towards its edges."""
    return F.pow(F.cos(((at + 0.5) / size - 0.5) * 3.141592653589793), 2)


def calibrate(v: Column, mode: str, low: Column, high: Column, p99: Column, target: Column) -> Column:
    """Rendered values as 16-bit numbers: none, lut_native (low to high), lut_zerofloor (0 to high) or scale (target over p99)."""
    v = F.greatest(v, F.lit(0.0))
    scaled = {"none": F.rint(v * 4095), "lut_native": low + v * (high - low), "lut_zerofloor": v * high, "scale": v * target / F.greatest(p99, F.lit(1e-6))}[mode]
    return F.floor(clip(scaled, 0.0, 65535.0)).cast("int")


def pyramid(pixels: DataFrame) -> DataFrame:
    """Half the size: means of 2 x 2 pixels."""
    return pixels.groupBy("scene_id", F.floor(F.col("y") / 2).alias("y2"), F.floor(F.col("x") / 2).alias("x2")).agg(F.avg("value").alias("value"))


def rasterise(polygons: DataFrame, pixel: float, last: bool) -> DataFrame:
    """(py, px, cell_idx): pixels whose centre lies in a ring; where rings overlap the one of the largest (last) or smallest cell_idx wins.

    Rings are collected once; a ring's pixels come from its own box, and each is tested in a projection.
    """
    ring = F.transform(F.sort_array(F.collect_list(F.struct("vertex_ord", "vertex_x", "vertex_y"))), lambda v: F.struct(v["vertex_x"].alias("x"), v["vertex_y"].alias("y")))
    r = polygons.groupBy("cell_idx").agg(ring.alias("ring"), *(f(c).alias(k) for k, f, c in (("x0", F.min, "vertex_x"), ("x1", F.max, "vertex_x"), ("y0", F.min, "vertex_y"), ("y1", F.max, "vertex_y"))))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / pixel), F.floor(F.col(b) / pixel))
    p = r.withColumn("py", F.explode(span("y0", "y1"))).withColumn("px", F.explode(span("x0", "x1")))
    p = p.where(in_ring((F.col("px") + 0.5) * pixel, (F.col("py") + 0.5) * pixel, F.col("ring")))
    return p.groupBy("py", "px").agg((F.max if last else F.min)("cell_idx").alias("cell_idx"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting against a ring, an array of (x, y) in order; the last corner is joined to the first."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, after, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) / (b["y"] - a["y"] + F.lit(1e-12)) * (y - a["y"]) + a["x"]))
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1


def erode(pixels: DataFrame) -> DataFrame:
    """Pixels of a label whose eight neighbours have it too."""
    return _around(pixels, [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j], 8)


def boundary(pixels: DataFrame) -> DataFrame:
    """Pixels of a label that erosion takes away."""
    own = pixels.where("label > 0").select("scene_id", "y", "x", "label")
    return own.join(erode(pixels).select("scene_id", "y", "x"), ["scene_id", "y", "x"], "left_anti")


def _around(pixels: DataFrame, steps: list[tuple[int, int]], least: int) -> DataFrame:
    own = pixels.where("label > 0").select("scene_id", "y", "x", "label")
    moved = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    votes = own.withColumn("s", moved).select("scene_id", (F.col("y") + F.col("s.i")).alias("y"), (F.col("x") + F.col("s.j")).alias("x"), "label").groupBy("scene_id", "y", "x", "label").agg(F.count(F.lit(1)).alias("n"))
    return own.join(votes.where(F.col("n") >= least), ["scene_id", "y", "x", "label"], "left_semi")


def dilate(pixels: DataFrame) -> DataFrame:
    """Labels grown by one pixel into the background, four-connected; the larger label wins a tie."""
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0)))))
    grown = pixels.where("label > 0").withColumn("s", steps).select("scene_id", (F.col("y") + F.col("s.i")).alias("y"), (F.col("x") + F.col("s.j")).alias("x"), F.col("label").alias("grown")).groupBy("scene_id", "y", "x").agg(F.max("grown").alias("grown"))
    return pixels.join(grown, ["scene_id", "y", "x"], "left").withColumn("label", F.when(F.col("label") > 0, F.col("label")).otherwise(F.coalesce("grown", F.lit(0)))).drop("grown")


def distance_to_background(pixels: DataFrame, most: int) -> DataFrame:
    """Squared distance of every labelled pixel to the nearest one of another label or none, ``most`` * ``most`` at most: first along rows, then over the rows around."""
    up, down = Window.partitionBy("scene_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("scene_id", "y").orderBy("x").rowsBetween(0, Window.unboundedFollowing)
    bare = F.when(F.col("label") == 0, F.col("x"))
    far = F.lit(most)
    row = pixels.select("scene_id", "y", "x", "label", F.least(F.col("x") - F.coalesce(F.max(bare).over(up), F.lit(-1000)), F.coalesce(F.min(bare).over(down), F.lit(1000)) - F.col("x"), far).alias("g"))
    near = row.withColumn("dy", F.explode(F.sequence(-far, far))).select("scene_id", (F.col("y") + F.col("dy")).alias("y"), "x", (F.col("g") * F.col("g") + F.col("dy") * F.col("dy")).alias("d2")).groupBy("scene_id", "y", "x").agg(F.min("d2").alias("d2"))
    return pixels.where("label > 0").join(near, ["scene_id", "y", "x"]).select("scene_id", "y", "x", F.least("d2", far * far).alias("d2"))


def principal_axis(vertices: DataFrame) -> DataFrame:
    """(cell_id, ax, ay): the unit eigenvector of a ring's larger variance, pointing to positive x (to positive y where it is upright)."""
    s = vertices.groupBy("cell_id").agg(F.var_pop("vertex_x").alias("a"), F.covar_pop("vertex_x", "vertex_y").alias("b"), F.var_pop("vertex_y").alias("c"))
    angle = 0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))
    return s.select("cell_id", F.cos(angle).alias("ax"), F.sin(angle).alias("ay"))
