"""Admixture rules, type resolution and calibration statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspan.operators.quantiles import quantile_table


def consensus(methods: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rules (keys, strength) of several methods: which found each, how many, the tier and the geometric mean of strengths."""
    rows = reduce(DataFrame.unionByName, (d.select(*keys, "strength", F.lit(m).alias("method")) for m, d in methods.items()))
    flags = [F.bool_or(F.col("method") == m).alias(f"by_{m}") for m in methods]
    score = F.exp(F.avg(F.when(F.col("strength") > 0, F.ln("strength")))).alias("score")
    c = rows.groupBy(*keys).agg(*flags, F.count_distinct("method").alias("n_methods"), score)
    tier = F.when(F.col("n_methods") == len(methods), "high").when(F.col("n_methods") > 1, "medium").otherwise("low")
    return c.withColumn("tier", tier)


def welch(df: DataFrame, group: str, value: str, flag: str) -> DataFrame:
    """Welch's t and degrees of freedom of value between flagged and other rows of each group; both need two rows."""
    on, off = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    a = df.groupBy(group).agg(*(f(c).alias(f"{k}{s}") for s, c in (("1", on), ("0", off)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    q1, q0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    a = a.where("n1 > 1 and n0 > 1 and v1 + v0 > 0")
    df_ = (q1 + q0) * (q1 + q0) / (q1 * q1 / (F.col("n1") - 1) + q0 * q0 / (F.col("n0") - 1))
    return a.select(group, F.col("n1").alias("n_with"), F.col("n0").alias("n_without"), ((F.col("m1") - F.col("m0")) / F.sqrt(q1 + q0)).alias("t"), df_.alias("df"))


def cascade(sources: dict[str, Column]) -> tuple[Column, Column]:
    """(type, source) of the first source in order that names a type; 'unknown' in any case is none."""
    real = {k: F.when(~F.lower(F.trim(c)).isin("", "unknown"), c) for k, c in sources.items()}
    return F.coalesce(*real.values()), F.coalesce(*(F.when(c.isNotNull(), F.lit(k)) for k, c in real.items()), F.lit("unresolved"))


def shrunk_rates(molecules: DataFrame, weight: float, least: int) -> DataFrame:
    """Nuclear share of each (gene, type), shrunk to the gene's by ``weight``; pairs of at least ``least`` molecules."""
    n = molecules.groupBy("feature_name", "cell_type").agg(F.count(F.lit(1)).alias("n"), F.sum("overlaps_nucleus").alias("k"))
    g = n.groupBy("feature_name").agg((F.sum("k") / F.sum("n")).alias("gene_rate"))
    rate = (F.col("k") + weight * F.col("gene_rate")) / (F.col("n") + weight)
    return n.where((F.col("n") >= least) & F.col("cell_type").isNotNull()).join(g, "feature_name").select("feature_name", "cell_type", "n", rate.alias("rate"))


def mean_distance(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Euclidean distance of each group's mean vector from the mean of all; the mean of all comes from the groups' sums."""
    e = vectors.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = e.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("mean"))
    d = F.col("s") / F.col("n") - F.col("mean")
    return e.join(whole, "i").groupBy(group).agg(F.sqrt(F.sum(d * d)).alias("distance"))


def quantile_distance(df: DataFrame, group: str, value: str, points: int) -> DataFrame:
    """Mean distance of each group's quantile function from that of all rows, on an even grid."""
    grid = [i / (points - 1) for i in range(points)]
    own = quantile_table(df, [group], {"v": F.col(value)}, grid).select(group, "q", "value")
    whole = quantile_table(df, [], {"v": F.col(value)}, grid).select("q", F.col("value").alias("all"))  # points rows
    return own.join(F.broadcast(whole), "q").groupBy(group).agg((F.sum(F.abs(F.col("value") - F.col("all"))) / points).alias("distance"))
