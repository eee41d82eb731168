"""Range, radius and nearest-neighbour joins by grid bins: equi-joins with a residual, no nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspan.operators import nearest


def in_box_closed(x: Column, y: Column, box: str = "") -> Column:
    return (x >= F.col(f"{box}xmin")) & (x <= F.col(f"{box}xmax")) & (y >= F.col(f"{box}ymin")) & (y <= F.col(f"{box}ymax"))


def cell_of(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def points_in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Every (point, box) with the point in the closed box: boxes are exploded to the bins that they cover, points lie in one bin."""
    cover = boxes.withColumn("gx", F.explode(F.sequence(cell_of(F.col("xmin"), size), cell_of(F.col("xmax"), size))))
    cover = cover.withColumn("gy", F.explode(F.sequence(cell_of(F.col("ymin"), size), cell_of(F.col("ymax"), size))))
    binned = points.withColumn("gx", cell_of(F.col(x), size)).withColumn("gy", cell_of(F.col(y), size))
    return binned.join(cover, ["gx", "gy"]).where(in_box_closed(F.col(x), F.col(y))).drop("gx", "gy")


def crop_counts(molecules: DataFrame, crops: DataFrame, min_qv: float = 20, size: float = 40.0, most: int = 200_000) -> DataFrame:
    """Total and assigned molecules per crop; a molecule counts for the first crop in order only; crops without any are zero.

    A point lies in one bin, so the bin's crops in order are one array: the first that holds the point is found in a
    projection, and what is shuffled are partial counts.  The bins are broadcast if they are at most ``most``.
    """
    cover = crops.withColumn("gx", F.explode(F.sequence(cell_of(F.col("xmin"), size), cell_of(F.col("xmax"), size))))
    cover = cover.withColumn("gy", F.explode(F.sequence(cell_of(F.col("ymin"), size), cell_of(F.col("ymax"), size))))
    bins = cover.groupBy("gx", "gy").agg(F.sort_array(F.collect_list(F.struct("crop_ord", "xmin", "xmax", "ymin", "ymax"))).alias("boxes"))
    bins = F.broadcast(bins) if cover.limit(most + 1).count() <= most else bins
    x, y = F.col("x_location"), F.col("y_location")
    good = molecules.where(F.col("qv") >= min_qv).select("x_location", "y_location", "cell_id").withColumn("gx", cell_of(x, size)).withColumn("gy", cell_of(y, size))
    hit = F.get(F.filter("boxes", lambda b: (x >= b["xmin"]) & (x <= b["xmax"]) & (y >= b["ymin"]) & (y <= b["ymax"])), F.lit(0))["crop_ord"]
    counts = good.join(bins, ["gx", "gy"]).select(hit.alias("crop_ord"), "cell_id").where("crop_ord is not null").groupBy("crop_ord").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("cell_id") != "UNASSIGNED").alias("assigned"))
    return crops.select("crop_ord", "crop_id").join(counts, "crop_ord", "left").select("crop_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("assigned", F.lit(0)).alias("assigned"))


def radius_join(left: DataFrame, right: DataFrame, radius: float, key: str = "cell_idx", x: str = "centroid_x", y: str = "centroid_y", most: int = 4096) -> DataFrame:
    """(src, dst, d2) of all pairs of unlike keys within radius; the left side is exploded to the 3 x 3 bins around it.

    A bin of more than ``most`` rows of the right side is dealt over parts, which every left row near it meets.  The right side is hashed: the
    left one, nine times as many rows, is not sorted, and neither is broadcast.
    """
    around = left.select(F.col(key).alias("src"), F.col(x).alias("sx"), F.col(y).alias("sy"))
    for a, v in (("gx", "sx"), ("gy", "sy")):
        bin_ = cell_of(F.col(v), radius)
        around = around.withColumn(a, F.explode(F.array(bin_ - 1, bin_, bin_ + 1)))
    other = right.select(F.col(key).alias("dst"), F.col(x).alias("dx"), F.col(y).alias("dy"))
    other = other.withColumn("gx", cell_of(F.col("dx"), radius)).withColumn("gy", cell_of(F.col("dy"), radius))
    parts = other.groupBy("gx", "gy").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    parts = parts.hint("shuffle_hash")
    around = around.join(parts, ["gx", "gy"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    other = other.join(parts, ["gx", "gy"]).withColumn("part", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int"))
    d2 = (F.col("sx") - F.col("dx")) * (F.col("sx") - F.col("dx")) + (F.col("sy") - F.col("dy")) * (F.col("sy") - F.col("dy"))
    return around.drop("parts").join(other.drop("parts").hint("shuffle_hash"), ["gx", "gy", "part"]).withColumn("d2", d2).where((F.col("src") != F.col("dst")) & (F.col("d2") <= radius * radius)).select("src", "dst", "d2")


def knn_join(left: DataFrame, right: DataFrame, k: int, radius: float) -> DataFrame:
    """(src, dst, d2, rank) of the k nearest within radius; ties go to the smaller id.  A dense bin does not make all its pairs."""
    return nearest.nearest(left, right, k, far=radius)
