"""Ranks, picks and running sums within groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellspan.operators.staging import cut


def places(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with ``place`` (from 0) and ``size`` of each row in its group's order.

    Groups may be few and large: rows are dealt by ranges of (group, order), numbered within a range, and counted on from
    the ranges ahead, of which there are as many as shuffle partitions.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(parts, group, *order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = rows.groupBy(group, "range").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    ahead = F.coalesce(F.sum("n").over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(group, "range", ahead.alias("ahead"), F.sum("n").over(w).alias("size"))
    place = F.row_number().over(Window.partitionBy(group, "range").orderBy(*order)) - 1
    return rows.withColumn("place", place).join(F.broadcast(counts), [group, "range"]).withColumn("place", F.col("place") + F.col("ahead")).drop("range", "ahead")  # groups plus ranges rows


def running(by: DataFrame, order: str, sums: list[str], descending: bool = False, ranges: int = 0) -> DataFrame:
    """by with running sums over distinct values of order: sums within ranges of the order, plus those of the ranges ahead (few rows)."""
    n = ranges or int(by.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.desc(order) if descending else F.asc(order)
    edges = [r[0] for r in by.agg(F.explode(F.percentile_approx(order, [k / n for k in range(1, n)], 1000))).distinct().collect()] if n > 1 else []
    part = reduce(lambda c, e: c + (F.col(order) >= F.lit(e)).cast("int"), edges, F.lit(0))
    rows = by.withColumn("part", -part if descending else part)
    within = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = rows.groupBy("part").agg(*(F.sum(c).alias(c) for c in sums)).select("part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in sums))
    return rows.withColumns({c: F.sum(c).over(within) for c in sums}).join(F.broadcast(before), "part").withColumns({c: F.col(c) + F.col(f"{c}_before") for c in sums}).select(order, *sums)


def first_of_group(df: DataFrame, group: str, order: list[str], k: int, salts: int = 64) -> DataFrame:
    """The first k rows of each group in order: k of each of ``salts`` parts of a group first, so that no task sees a whole group."""
    part = F.pmod(F.xxhash64(*order), F.lit(salts))
    some = df.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))).where(F.col("place") <= k)
    return some.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= k).drop("part", "place")


def uniform_rank(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """Rank within the group scaled to [0, 1]; ties by key; 0 for a group of one."""
    return places(df, group, [value, key]).select(key, group, (F.col("place") / F.greatest(F.col("size") - 1, F.lit(1))).alias("rank"))


def top2_margin(counts: DataFrame, group: str, choice: str, n: str = "n") -> DataFrame:
    """The two largest choices of each group (ties to the smaller choice) and (n1 - n2) / (n1 + n2)."""
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col(n)).alias("m"), F.col(choice).alias("c")))), 1, 2)
    t = counts.groupBy(group).agg(top.alias("t")).select(group, F.get("t", F.lit(0)).alias("a"), F.get("t", F.lit(1)).alias("b"))
    n1, n2 = -F.col("a.m"), F.coalesce(-F.col("b.m"), F.lit(0))
    return t.select(group, F.col("a.c").alias("first"), F.col("b.c").alias("second"), ((n1 - n2) / (n1 + n2 + F.lit(1e-12))).alias("margin"))


def ordered_split(df: DataFrame, group: str, order: list[str], share: float = 0.15) -> DataFrame:
    """Of each group in order, the last share is test, the share before it val, one row at least; the rest train."""
    held, left = F.greatest(F.lit(1.0), F.rint(F.col("size") * share)), F.col("size") - 1 - F.col("place")
    return places(df, group, order).withColumn("split", F.when(left < held, "test").when(left < 2 * held, "val").otherwise("train")).drop("place", "size")


def spread_picks(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """k rows of each group, evenly spaced in order."""
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.rint(j * (F.col("size") - 1) / F.lit(max(k - 1, 1))))
    return places(df, group, order).where(F.array_contains(wanted, F.col("place").cast("double"))).drop("place", "size")


def cumulative_histogram(df: DataFrame, group: str, value: str, bins: int) -> DataFrame:
    """Count per bin of [0, 1] and the share of rows up to it."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    h = df.groupBy(group, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    return h.withColumn("cdf", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w))


def compact_labels(pixels: DataFrame) -> DataFrame:
    """Labels above 0 of each scene numbered from 1 without gaps."""
    labels = pixels.where("label > 0").select("scene_id", "label").distinct()
    return labels.withColumn("compact", F.dense_rank().over(Window.partitionBy("scene_id").orderBy("label")))


def local_maxima(pixels: DataFrame, reach: int) -> DataFrame:
    """Pixels that equal the maximum of the square around them; frames count positions, so images may have gaps."""
    row = Window.partitionBy("scene_id", "y").orderBy("x").rangeBetween(-reach, reach)
    column = Window.partitionBy("scene_id", "x").orderBy("y").rangeBetween(-reach, reach)
    return pixels.withColumn("m", F.max("value").over(row)).withColumn("m", F.max("m").over(column)).where("value = m").drop("m")


def best_f1(scored: DataFrame) -> DataFrame:
    """The score threshold of the best F1 for rows (score, truth); equal scores stand or fall together, ties to the higher.

    Scores are summed up first, then run up in ranges of scores.
    """
    by = scored.groupBy("score").agg(F.sum("truth").alias("tp"), F.count(F.lit(1)).alias("n"))
    run = running(by, "score", ["tp", "n"], descending=True)
    f1 = 2 * F.col("tp") / (F.col("n") + F.col("all"))
    run = run.crossJoin(F.broadcast(scored.agg(F.sum("truth").alias("all")))).select("score", f1.alias("f1"))  # one row
    best = F.max_by(F.struct("score", "f1"), F.struct("f1", "score")).alias("b")
    return run.agg(best).select(F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))
