"""Greedy choices in an order, run to the end in parallel: thinning by distance, matching of nearest pairs.

What comes first stays, what conflicts with an earlier one that stays goes.  A row without an open earlier rival stays at once.
A row with exactly one does the opposite of it, so chains of such rows are settled together by pointer jumping, in as many
steps as the logarithm of their length; the rest waits for the next round.  Rounds end when nothing is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspan.operators import spatial
from cellspan.operators.ranks import places
from cellspan.operators.staging import cut


def settled(open_: DataFrame) -> DataFrame:
    """(node, kept) of the rows (node, n, rival) that are decided: n open earlier rivals, rival: the only one where n is 1."""
    jump = cut(open_.select("node", (F.col("n") == 0).alias("free"), F.when(F.col("n") == 1, F.col("rival")).alias("up"), (F.col("n") != 1).alias("same")), "jumps")
    while True:
        above = jump.where("up is not null").select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("same").alias("again"))
        j = jump.join(above, "up", "left").select(
            "node", "free", F.coalesce("next", "up").alias("up"), F.when(F.col("next").isNull(), F.col("same")).otherwise(F.col("same") == F.col("again")).alias("same"),
            F.col("next").isNotNull().alias("moved"),
        )
        j = cut(j, "jumps")
        jump = j.drop("moved")
        if j.where("moved").isEmpty():
            break
    roots = jump.where("free").select(F.col("node").alias("up"))
    chained = jump.join(roots, "up", "left_semi").select("node", F.col("same").alias("kept"))
    return jump.where("free").select("node", F.lit(True).alias("kept")).unionByName(chained)


def suppress(
    points: DataFrame, distance: float, order: list[Column], key: str = "cell_idx", x: str = "centroid_x", y: str = "centroid_y", closed: bool = False
) -> DataFrame:
    """The points that stay when each, in order and then by key, drops the later ones nearer than distance (closed: or as near)."""
    # A point's place in the order is its number: what comes first is the smaller one, and strings do not travel with the pairs.
    by = [f"by{i}" for i in range(len(order))]
    keyed = points.select(F.col(key).alias("key"), F.col(x).alias("x"), F.col(y).alias("y"), *(c.alias(n) for c, n in zip(order, by, strict=True)), F.lit(0).alias("all"))
    ranked = cut(places(keyed, "all", [*by, "key"]).select(F.col("place").cast("long").alias("node"), "key", "x", "y"), "points")
    near = spatial.radius_join(ranked, ranked, distance, "node", "x", "y").where("dst < src")
    near = near if closed else near.where(F.col("d2") < distance * distance)
    rivals, open_, kept = cut(near.select("src", "dst"), "rivals"), ranked.select("node"), None
    while not open_.isEmpty():
        n = rivals.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("rival"))
        known = cut(settled(open_.join(n, "node", "left").na.fill(0, ["n"])), "settled")
        stay = known.where("kept").select("node")
        kept = stay if kept is None else kept.unionByName(stay)
        gone = known.where("not kept").select("node").unionByName(rivals.join(stay.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")))
        open_ = cut(open_.join(stay.unionByName(gone), "node", "left_anti"), "open")
        live = open_.select(F.col("node").alias("src"))
        rivals = cut(rivals.join(live, "src", "left_semi").join(live.withColumnRenamed("src", "dst"), "dst", "left_semi"), "rivals")
    if kept is None:
        return points.limit(0)
    return points.join(ranked.join(kept.hint("shuffle_hash"), "node").select(F.col("key").alias(key)), key, "left_semi")


def nearest_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, d) taken from the pairs by rising d (then a, b), each a and b once, until none is left; a repeated pair counts at its least d."""
    pairs = pairs.groupBy("a", "b").agg(F.round(F.min("d"), 9).alias("d"))
    left, out = cut(pairs.withColumn("node", F.monotonically_increasing_id()), "pairs"), None
    order = ["d", "a", "b"]
    while not left.isEmpty():
        of = {s: Window.partitionBy(s).orderBy(*order) for s in ("a", "b")}
        # Earlier pairs at either end; of exactly one, the one before.
        n = left.withColumns({f"n{s}": F.row_number().over(w) - 1 for s, w in of.items()} | {f"r{s}": F.lag("node").over(w) for s, w in of.items()})
        known = cut(settled(n.select("node", (F.col("na") + F.col("nb")).alias("n"), F.coalesce("ra", "rb").alias("rival"))), "settled")
        hit = cut(left.join(known.where("kept"), "node", "left_semi"), "matched")
        out = hit if out is None else out.unionByName(hit)
        left = cut(left.join(hit.select("a"), "a", "left_anti").join(hit.select("b"), "b", "left_anti").select(*left.columns), "pairs")
    return (out if out is not None else left).select("a", "b", "d")
