"""Nearest neighbours without a greatest distance, whatever the density: bins of a size of each point's own.

A point's first search radius follows from how dense its surroundings are: the space is split into quarters for as long
as a square holds many points (a quadtree by counts).  Points of one radius meet the others in square bins of that
side; whoever finds k within the radius is done, the rest search at four times the radius.  A point that is open at radius
r has fewer than k others within r / 4, so few such points fit into a bin and the pairs grow with the rows, not with the
square of a dense bin.  Bins of more than a set number of rows are dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspan.operators.staging import cut

#: Candidates that one bin of a join task holds; bins of more are dealt out.
MOST = 2048
#: Levels of halving between the whole extent and the finest bins.
DEPTH = 40


def bins_at(df: DataFrame, level: Column, x: str, y: str, origin: tuple[float, float], extent: float) -> DataFrame:
    """df with the bin (gx, gy) of squares of the extent halved ``level`` times."""
    side = F.lit(extent) / F.pow(F.lit(2.0), level)
    return df.withColumns({"gx": F.floor((F.col(x) - origin[0]) / side), "gy": F.floor((F.col(y) - origin[1]) / side)})


def own_levels(left: DataFrame, right: DataFrame, within: list[str], k: int, origin: tuple[float, float], extent: float) -> DataFrame:
    """left with ``level``: the finest at which the square of a point still holds 2 k of right, 0 at least.

    Two levels at a time; a round counts only what is open.
    """
    few, done, open_, rest, level = 2 * k + 2, None, left.withColumn("level", F.lit(0)), right, 0  # more than a pile holds
    while True:
        level += 2
        squares = bins_at(rest, F.lit(level), "x", "y", origin, extent)
        full = squares.groupBy(*within, "gx", "gy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= few).drop("n")
        full = cut(full, "squares")
        if level >= DEPTH or full.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        here = bins_at(open_, F.lit(level), "x", "y", origin, extent).join(full.withColumn("deep", F.lit(True)), [*within, "gx", "gy"], "left")
        here = cut(here.drop("gx", "gy"), "levels")
        stays = here.where("deep is null").drop("deep")
        done = stays if done is None else done.unionByName(stays)
        open_ = here.where("deep").drop("deep").withColumn("level", F.lit(level))
        rest = cut(squares.join(full, [*within, "gx", "gy"], "left_semi").drop("gx", "gy"), "dense")


def meet(open_: DataFrame, right: DataFrame, within: list[str], levels: list[int], origin: tuple[float, float], extent: float, most: int) -> DataFrame:
    """(src, dst, d2) of every open point and its candidates in the 3 x 3 bins around it at its own level, within a bin's side.

    levels: those of the open points.  An open point lies in one bin; candidates are repeated in the bins around theirs, as there are often more of the former.

    Both sides of a bin with more than ``most`` candidates are dealt: candidates by their key, open points to each part.
    """
    key = [*within, "level", "gx", "gy"]

    def around(df: DataFrame) -> DataFrame:
        for g in ("gx", "gy"):
            df = df.withColumn(g, F.explode(F.array(F.col(g) - 1, F.col(g), F.col(g) + 1)))
        return df

    own = bins_at(open_, F.col("level"), "x", "y", origin, extent)
    wanted = around(own.select(*key).distinct()).distinct()
    binned = bins_at(right.withColumn("level", F.explode(F.array(*(F.lit(v) for v in levels)))), F.col("level"), "x", "y", origin, extent)
    binned = binned.join(wanted, key, "left_semi").select(*key, F.col("key").alias("dst"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    binned = around(cut(binned, "binned"))
    dense = cut(binned.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).where("parts > 1"), "dense")
    if not dense.isEmpty():
        parts = F.coalesce("parts", F.lit(1))
        binned = binned.join(dense, key, "left").withColumn("part", F.pmod(F.xxhash64("dst"), parts).cast("int")).drop("parts")
        own = own.join(dense, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        key = [*key, "part"]
    side = F.lit(extent) / F.pow(F.lit(2.0), F.col("level"))
    dx, dy = F.col("x") - F.col("dx"), F.col("y") - F.col("dy")
    pairs = own.join(binned, key).withColumn("d2", dx * dx + dy * dy)
    return pairs.where((F.col("src") != F.col("dst")) & (F.col("d2") <= side * side)).select("src", "dst", "d2")


def nearest(
    left: DataFrame, right: DataFrame, k: int, key: str = "cell_idx", x: str = "centroid_x", y: str = "centroid_y", within: list[str] | None = None,
    most: int = MOST, far: float | None = None,
) -> DataFrame:
    """(src, dst, d2, rank) of the k nearest of right for every row of left, fewer only where right has no more.

    Of other keys only, ties to the smaller key; ``within``: columns in which both sides agree, such as a crop; far: no
    neighbour beyond it.  Rows with a null key, place or ``within`` take no part.  Of right's rows at one place the k + 1
    smallest keys are enough, so piles of equal points cost nothing.
    """
    within = within or []
    spark = left.sparkSession
    slim = lambda d: d.select(*within, F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    pile = Window.partitionBy(*within, "x", "y").orderBy("key")
    right = cut(slim(right).withColumn("n", F.row_number().over(pile)).where(F.col("n") <= k + 1).drop("n"), "candidates")
    left = slim(left).withColumnRenamed("key", "src").distinct()
    schema = f"src {dict(left.dtypes)['src']}, dst {dict(right.dtypes)['key']}, d2 double, rank int"
    # The side of the bins of level 0: far, or half as much again as the extent of all points.
    extent, origin, out = far, (0.0, 0.0), None
    if far is None:
        box = right.select("x", "y").union(left.select("x", "y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
        if not box[4]:
            return spark.createDataFrame([], schema)
        extent, origin = 1.5 * max(box[1] - box[0], box[3] - box[2], 1e-9), (box[0], box[2])
    open_ = cut(own_levels(left, right, within, k, origin, extent), "open")
    order = Window.partitionBy("src").orderBy("d2", "dst")
    while levels := [r["level"] for r in open_.select("level").distinct().collect()]:  # DEPTH at most
        found = meet(open_, right, within, levels, origin, extent, most)
        found = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")
        if levels == [0]:
            out = found if out is None else out.unionByName(found)
            break
        full = found.where(F.col("rank") == k).select("src")
        over = open_.where(F.col("level") == 0).select("src").union(full).distinct()
        kept = found.join(over, "src", "left_semi")
        out = kept if out is None else out.unionByName(kept)
        open_ = cut(open_.join(over, "src", "left_anti").withColumn("level", F.greatest(F.col("level") - 2, F.lit(0))), "open")
    return out.select("src", "dst", "d2", "rank") if out is not None else spark.createDataFrame([], schema)
