"""Tiles, windows and polygons: grid arithmetic and equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.operators.raster import in_ring


def tile_members(points: DataFrame, x: str, y: str, step: float, size: float) -> DataFrame:
    """Every (point, tile) of overlapping square tiles of ``size`` laid every ``step``; owned: the tile whose core holds the point."""
    out = points
    for t, v in (("tx", x), ("ty", y)):
        high = F.floor(F.col(v) / step)
        out = out.withColumn(t, F.explode(F.sequence(F.floor((F.col(v) - size) / step) + 1, high)))
    owned = (F.col("tx") == F.floor(F.col(x) / step)) & (F.col("ty") == F.floor(F.col(y) / step))
    return out.withColumn("owned", owned)


def points_in_rings(points: DataFrame, vertices: DataFrame, key: str) -> DataFrame:
    """points with ``inside``: whether they lie in the ring of their key; a ring is collected once, a point tested in a projection."""
    ring = F.transform(F.sort_array(F.collect_list(F.struct("vertex_ord", "vertex_x", "vertex_y"))), lambda v: F.struct(v["vertex_x"].alias("x"), v["vertex_y"].alias("y")))
    rings = vertices.groupBy(key).agg(ring.alias("ring"))
    return points.join(rings, key).withColumn("inside", in_ring(F.col("x_location"), F.col("y_location"), F.col("ring"))).drop("ring")


def bin_density(points: DataFrame, key: str, x: str, y: str, size: float) -> DataFrame:
    """Points in the 3 x 3 bins around each point; bins are counted first, so that a dense bin is one row."""
    at = points.select(key, F.floor(F.col(x) / size).alias("gx"), F.floor(F.col(y) / size).alias("gy"))
    n = at.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n"))
    for g in ("gx", "gy"):
        n = n.withColumn(g, F.explode(F.array(F.col(g) - 1, F.col(g), F.col(g) + 1)))
    return at.join(n.groupBy("gx", "gy").agg(F.sum("n").alias("density")), ["gx", "gy"]).select(key, "density")


def windows(cells: DataFrame, size: float, least: int) -> DataFrame:
    """Half-stride square windows of at least ``least`` cells, with the share of their most common type."""
    m = tile_members(cells, "centroid_x", "centroid_y", size / 2, size)
    types = m.groupBy("tx", "ty", "cell_type").agg(F.count(F.lit(1)).alias("n"))
    typed = F.max(F.when(F.col("cell_type").isNotNull(), F.col("n")))
    return types.groupBy("tx", "ty").agg(F.sum("n").alias("n_cells"), (F.coalesce(typed, F.lit(0)) / F.sum("n")).alias("top_share")).where(F.col("n_cells") >= least)


def label_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each label of a, the label of b with the largest intersection over union (ties to the smaller), pixel by pixel."""
    p = a.where("label > 0").select("y", "x", F.col("label").alias("la")).join(b.where("label > 0").select("y", "x", F.col("label").alias("lb")), ["y", "x"])
    n = p.groupBy("la", "lb").agg(F.count(F.lit(1)).alias("both"))
    size = lambda d, k: d.where("label > 0").groupBy(F.col("label").alias(f"l{k}")).agg(F.count(F.lit(1)).alias(f"n{k}"))
    n = n.join(size(a, "a"), "la").join(size(b, "b"), "lb").withColumn("iou", F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
    return n.groupBy("la").agg(F.max_by(F.struct("lb", "iou"), F.struct("iou", -F.col("lb"))).alias("m")).select("la", "m.lb", "m.iou")
