"""Polygon and pixel geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def polygon_stats(vertices: DataFrame) -> DataFrame:
    """Shoelace area, vertex-mean centroid and axis lengths (2 * sqrt of the covariance eigenvalues) of rings of vertices."""
    ring = Window.partitionBy("cell_id").orderBy("vertex_ord")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    v = vertices.withColumn("nx", nxt("vertex_x")).withColumn("ny", nxt("vertex_y"))
    s = v.groupBy("cell_id").agg(
        (F.abs(F.sum(F.col("vertex_x") * F.col("ny") - F.col("nx") * F.col("vertex_y"))) / 2).alias("area"),
        F.avg("vertex_x").alias("cx"), F.avg("vertex_y").alias("cy"),
        F.var_pop("vertex_x").alias("vxx"), F.var_pop("vertex_y").alias("vyy"), F.covar_pop("vertex_x", "vertex_y").alias("vxy"),
    )
    half, root = (F.col("vxx") + F.col("vyy")) / 2, F.sqrt(F.pow((F.col("vxx") - F.col("vyy")) / 2, 2) + F.pow("vxy", 2))
    return s.select("cell_id", "area", "cx", "cy", (2 * F.sqrt(half + root)).alias("major"), (2 * F.sqrt(F.greatest(half - root, F.lit(1e-12)))).alias("minor"))


def label_centroids(pixels: DataFrame) -> DataFrame:
    """Area and mean position of each label of each scene; label 0 is background."""
    return pixels.where("label > 0").groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.sum("nucleus").alias("nucleus_area"))


def coarse_field(pixels: DataFrame, block: int) -> DataFrame:
    """Share of each label in blocks of block x block pixels."""
    at = lambda c: F.floor(F.col(c) / block).cast("int").alias(f"b{c}")
    return pixels.groupBy("scene_id", at("y"), at("x"), "label").agg((F.count(F.lit(1)) / (block * block)).alias("share"))
