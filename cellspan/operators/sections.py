"""Flat sections of ellipsoids: what a plane at a random place cuts out, and the ellipsoids whose sections have given quantiles."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.operators.fields import drawn
from cellspan.operators.staging import cut

PARTS = (0.1, 0.25, 0.5, 0.75, 0.9)
NAMES = [f"p{round(100 * q)}" for q in PARTS]


def planes(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(plane, z, n1, n2, n3, u): n draws that any ellipsoid can use: a normal deviate, a direction on the sphere, a place in (-1, 1) along it.

    Each number is a hash of the plane, the seed and its place, so the draws are the same for any partitions.
    """
    even = lambda k: F.greatest(drawn(F.col("id"), F.lit(seed), F.lit(k)), F.lit(1e-12))
    normal = lambda k: F.sqrt(-2 * F.ln(even(k))) * F.cos(2 * math.pi * even(k + 1))
    g = spark.range(n).select("id", normal(0).alias("z"), *(normal(2 * i).alias(f"g{i}") for i in (1, 2, 3)), (2 * even(8) - 1).alias("u"))
    length = F.greatest(F.sqrt(F.col("g1") ** 2 + F.col("g2") ** 2 + F.col("g3") ** 2), F.lit(1e-12))
    return g.select(F.col("id").alias("plane"), "z", *((F.col(f"g{i}") / length).alias(f"n{i}") for i in (1, 2, 3)), "u")


def section(axes: list[Column], normal: list[Column], u: Column) -> tuple[Column, Column]:
    """(area, ratio of the axes) of the ellipse in which a plane cuts an ellipsoid; u: the plane's place between the two that only touch it.

    The quadric restricted to the plane has trace tr(M) - n'Mn and determinant det(M) n'M^-1 n, with M = diag(1 / axes squared), so
    its eigenvalues need no basis of the plane.
    """
    a2 = [a * a for a in axes]
    reach = sum((n * n * a for n, a in zip(normal, a2, strict=True)), F.lit(0.0))  # n'M^-1 n
    volume = axes[0] * axes[1] * axes[2]
    half = sum(((1 - n * n) / a for n, a in zip(normal, a2, strict=True)), F.lit(0.0)) / 2
    root = F.sqrt(F.greatest(half * half - reach / (volume * volume), F.lit(0.0)))
    return math.pi * volume / F.sqrt(reach) * (1 - u * u), F.sqrt((half + root) / F.greatest(half - root, F.lit(1e-12)))


def section_quantiles(shapes: DataFrame, keys: list[str], draws: DataFrame) -> DataFrame:
    """keys, area and ratio (arrays for PARTS) of shapes (keys, log_radius_mean, log_radius_std, k1, k2, k3) over the draws of planes().

    A radius is exp(mean + std z); the axes are it times exp(k), the k taken about their mean.  Grazing cuts (1 - u squared at most 0.001) are left out.
    Every shape meets the same few draws, which are broadcast; a group has as many rows as draws.  Shapes are dealt out before they meet
    them, so that their groups need no shuffle of cuts.
    """
    parts = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own is not coalesced, as the few rows of shapes would be
    mean = (F.col("k1") + F.col("k2") + F.col("k3")) / 3
    axes = [F.exp(F.col("log_radius_mean") + F.col("log_radius_std") * F.col("z") + F.col(k) - mean) for k in ("k1", "k2", "k3")]
    area, ratio = section(axes, [F.col(n) for n in ("n1", "n2", "n3")], F.col("u"))
    cuts = shapes.repartition(parts, *keys).crossJoin(F.broadcast(draws.where(1 - F.col("u") ** 2 > 1e-3))).select(*keys, area.alias("area"), ratio.alias("ratio"))  # draws: a set number
    return cuts.groupBy(*keys).agg(*(F.percentile(c, list(PARTS)).alias(c) for c in ("area", "ratio")))


def fit_shapes(targets: DataFrame, n: int = 4000, seed: int = 0, rounds: int = 8, ratio_weight: float = 0.6) -> DataFrame:
    """cell_type, log_radius_mean, log_radius_std, k1, k2, k3, loss, area, ratio: for each row of targets (cell_type, area and ratio: arrays for PARTS) the ellipsoid whose sections come nearest.

    loss: mean squared difference of the logarithms of the area's quantiles, plus ratio_weight times that of the ratio's.  All types are
    searched at once: each round tries the 27 neighbours of the best so far in spread and two shape numbers, then halves the steps
    of types that found none better.  A size only shifts the area's logarithms, so the best size is their mean difference, not searched.
    Types with a null or an array of another length are left out.  The spread is held to 0.05 at least.
    """
    logs = lambda c: F.transform(c, lambda v: F.ln(v + 1e-3))
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v) / len(PARTS)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / len(PARTS)
    whole = targets.where((F.size("area") == len(PARTS)) & (F.size("ratio") == len(PARTS)) & ~F.exists("area", lambda v: v.isNull()) & ~F.exists("ratio", lambda v: v.isNull()))
    wanted = whole.select("cell_type", logs("area").alias("want_area"), logs("ratio").alias("want_ratio"), F.ln(F.greatest(F.get("ratio", F.lit(2)), F.lit(1.0))).alias("long"))
    draws = cut(planes(targets.sparkSession, n, seed), "planes")
    wanted = cut(wanted, "targets")  # read by every trial of the first round
    best = wanted.select("*", F.lit(0.3).alias("spread"), (F.col("long") / 2).alias("k1"), F.lit(0.0).alias("k2"), F.lit(0.2).alias("step"))
    moves = targets.sparkSession.createDataFrame([tuple(map(float, m)) for m in itertools.product((-1, 0, 1), repeat=3)], "m0 double, m1 double, m2 double")
    for _ in range(rounds):
        tried = best.crossJoin(F.broadcast(moves)).select(  # 27 rows
            "cell_type", "want_area", "want_ratio", "long", "step", (F.abs("m0") + F.abs("m1") + F.abs("m2") == 0).alias("still"),
            F.greatest(F.col("spread") + F.col("m0") * F.col("step"), F.lit(0.05)).alias("spread"), (F.col("k1") + F.col("m1") * F.col("step")).alias("k1"), (F.col("k2") + F.col("m2") * F.col("step")).alias("k2"),
        )
        tried = tried.withColumn("trial", F.struct("spread", "k1", "k2", "still"))
        shapes = tried.select("cell_type", "trial", F.lit(0.0).alias("log_radius_mean"), F.col("spread").alias("log_radius_std"), "k1", "k2", (-F.col("k1") - F.col("k2")).alias("k3"))
        q = section_quantiles(shapes, ["cell_type", "trial"], draws)
        seen = tried.join(q, ["cell_type", "trial"]).withColumn("size", (mean("want_area") - mean(F.transform("area", F.ln))) / 2)
        seen = seen.withColumn("area", F.transform("area", lambda v: v * F.exp(2 * F.col("size"))))
        loss = square(F.col("want_area"), logs("area")) + ratio_weight * square(F.col("want_ratio"), logs("ratio"))
        rank = F.struct(F.round(loss, 12).alias("loss"), (~F.col("still")).alias("moved"), "spread", "k1", "k2")
        found = seen.groupBy("cell_type").agg(F.min_by(F.struct("want_area", "want_ratio", "long", "spread", "k1", "k2", "step", "still", "size", "area", "ratio", loss.alias("loss")), rank).alias("b")).select("cell_type", "b.*")
        best = cut(found.withColumn("step", F.when(F.col("still"), F.col("step") / 2).otherwise(F.col("step"))), "shapes")
    return best.select("cell_type", F.col("size").alias("log_radius_mean"), F.col("spread").alias("log_radius_std"), "k1", "k2", (-F.col("k1") - F.col("k2")).alias("k3"), "loss", "area", "ratio")
