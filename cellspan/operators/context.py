"""Planted gaps and faults of label images, and what lies around them; splits of crops by place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.operators import cells, ranks


def ablation_set(centroids: DataFrame, seeds: DataFrame, mode: str = "cluster", size: int = 4) -> DataFrame:
    """(scene_id, label) to take out of scenes of centroids (scene_id, label, cx, cy).

    single: the first ``size`` seeds (scene_id, label, ord) of each scene; cluster: the first seed and the size - 1 centroids nearest to it (ties to the
    smaller label); region: all whose centroid lies in the box of such a cluster.  A scene of fewer labels gives all of them.
    """
    if mode == "single":
        return ranks.first_of_group(seeds, "scene_id", ["ord", "label"], size).select("scene_id", "label")
    if mode not in ("cluster", "region"):
        raise ValueError(f"no such mode: {mode}")
    first = seeds.groupBy("scene_id").agg(F.min_by("label", F.struct("ord", "label")).alias("label"))
    at = first.join(centroids, ["scene_id", "label"]).select("scene_id", F.col("cx").alias("sx"), F.col("cy").alias("sy"))  # a row a scene
    near = centroids.join(at, "scene_id").withColumn("d2", F.round((F.col("cx") - F.col("sx")) ** 2 + (F.col("cy") - F.col("sy")) ** 2, 9))
    cluster = ranks.first_of_group(near, "scene_id", ["d2", "label"], size).select("scene_id", "label", "cx", "cy")
    if mode == "cluster":
        return cluster.select("scene_id", "label")
    return centroids.join(box(cluster), "scene_id").where("cx between x0 and x1 and cy between y0 and y1").select("scene_id", "label")


def box(points: DataFrame) -> DataFrame:
    """(scene_id, x0, x1, y0, y1) of points (scene_id, cx, cy)."""
    return points.groupBy("scene_id").agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))


def density_around(centroids: DataFrame, chosen: DataFrame, pixel: float, pad: float = 20.0) -> DataFrame:
    """(scene_id, n, density): centroids in the box of the chosen labels, widened by pad (in the unit of pixel), and how many that is for 100 squares of it.

    Scenes without a chosen label that is there have no row.
    """
    wide = box(centroids.join(chosen.select("scene_id", "label").distinct(), ["scene_id", "label"], "left_semi"))
    wide = wide.select("scene_id", *((F.col(c) + sign * pad / pixel).alias(c) for c, sign in (("x0", -1), ("x1", 1), ("y0", -1), ("y1", 1))))
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * pixel * pixel, F.lit(1e-6))
    inside = centroids.join(wide, "scene_id").where("cx between x0 and x1 and cy between y0 and y1")
    return inside.groupBy("scene_id", "x0", "x1", "y0", "y1").agg(F.count(F.lit(1)).alias("n")).select("scene_id", "n", (100.0 * F.col("n") / area).alias("density"))


def jitter_labels(pixels: DataFrame, edits: DataFrame, steps: int = 2) -> DataFrame:
    """pixels (scene_id, y, x, label) with the labels of edits (scene_id, label, grow) grown or shrunk by ``steps`` rounds of the four neighbours.

    That is the diamond of the radius ``steps`` around a pixel: a shrunk label keeps the pixels whose diamond it fills (beyond the image is nothing), a
    grown one takes background only; where two grow into one pixel the larger label has it.  Other columns stay.
    """
    marks = edits.groupBy("scene_id", "label").agg(F.max("grow").alias("grow"))  # an edit twice is one
    diamond = [(dy, dx) for dy in range(-steps, steps + 1) for dx in range(-steps, steps + 1) if abs(dy) + abs(dx) <= steps]
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in diamond))
    edited = pixels.where("label > 0").join(marks, ["scene_id", "label"]).select("scene_id", "y", "x", "label", "grow", F.explode(offsets).alias("o"))
    met = edited.groupBy("scene_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "label", "grow").agg(F.count(F.lit(1)).alias("k"))
    of = lambda cond: F.collect_set(F.when(cond, F.col("label")))  # noqa: E731  as many as labels within a diamond
    full = ~F.col("grow") & (F.col("k") == len(diamond))
    met = met.groupBy("scene_id", "y", "x").agg(F.max(F.when(F.col("grow"), F.col("label"))).alias("taken"), of(~F.col("grow")).alias("shrunk"), of(full).alias("kept"))
    label = F.col("label")
    new = F.when((label == 0) & F.col("taken").isNotNull(), F.col("taken")).when(F.array_contains("shrunk", label) & ~F.array_contains("kept", label), F.lit(0)).otherwise(label)
    return pixels.join(met, ["scene_id", "y", "x"], "left").withColumn("label", F.coalesce(new, label).cast(pixels.schema["label"].dataType)).drop("taken", "shrunk", "kept")


def spatial_split(crops: DataFrame, method: str = "x") -> DataFrame:
    """crops (crop_id, xmin, xmax, ymin, ymax) with ``split``: the greatest x (or y) of centres are test, those before them val, 15 % each and one at least.

    checkerboard: by the medians of both, or by x where that leaves test or val empty.  Fewer than three crops are all train.
    """
    if method not in ("x", "y", "checkerboard"):
        raise ValueError(f"no such method: {method}")
    if method == "checkerboard":
        board = cells.checkerboard(crops)
        there = board.agg(F.count_if(F.col("split") == "val").alias("val"), F.count_if(F.col("split") == "test").alias("test"), F.count(F.lit(1)).alias("n")).first()
        if there["n"] < 3 or (there["val"] and there["test"]):
            return board
    mid = {a: ((F.col(f"{a}min") + F.col(f"{a}max")) / 2) for a in "xy"}
    order = ("_y", "_x") if method == "y" else ("_x", "_y")
    rows = ranks.places(crops.withColumns({"_x": mid["x"], "_y": mid["y"], "_all": F.lit(0)}), "_all", [*order, "crop_id"])
    share = F.greatest(F.lit(1.0), F.rint(F.col("size") * 0.15))
    held, left = F.when(2 * share >= F.col("size"), F.lit(1.0)).otherwise(share), F.col("size") - 1 - F.col("place")
    split = F.when(F.col("size") < 3, "train").when(left < held, "test").when(left < 2 * held, "val").otherwise("train")
    return rows.withColumn("split", split).drop("place", "size", "_all", "_x", "_y")
