"""Per-group statistics of molecules and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellspan.operators.quantiles import wide_quantiles


def noise_fraction(molecules: DataFrame) -> DataFrame:
    """Share of unassigned molecules, 0 for none."""
    return molecules.agg(F.coalesce(F.count_if(F.col("cell_id") == "UNASSIGNED") / F.count(F.lit(1)), F.lit(0.0)).alias("noise_fraction"))


def count_prior(molecules: DataFrame, cells: DataFrame) -> DataFrame:
    """Per type: cells, mean of positive molecule counts, population deviation of ln(1 + count)."""
    n = molecules.where("cell_id <> 'UNASSIGNED'").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    c = cells.where("cell_type is not null").join(n, "cell_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return c.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_cells"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("mean_count"), F.stddev_pop(F.log1p("n")).alias("sigma"))


def factor_gene_rates(molecules: DataFrame) -> DataFrame:
    """Share of each gene among a factor's molecules."""
    n = molecules.groupBy("factor", "feature_name").agg(F.count(F.lit(1)).alias("n"))
    return n.select("factor", "feature_name", (F.col("n") / F.sum("n").over(Window.partitionBy("factor"))).alias("rate"))


def nuclear_fraction(molecules: DataFrame, least: int = 10) -> DataFrame:
    """Mean nucleus overlap per gene; 0.5 below ``least`` molecules."""
    g = molecules.groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"), F.avg("overlaps_nucleus").alias("f"))
    return g.select("feature_name", F.when(F.col("n") >= least, F.col("f")).otherwise(0.5).alias("nuclear_fraction"))


def type_quantiles(cells: DataFrame, value: str = "nucleus_area") -> DataFrame:
    """n and p10, p50, p90 per type, linear interpolation."""
    typed = cells.where("cell_type is not null")
    wide = wide_quantiles(typed, ["cell_type"], {"v": F.col(value)}, {"10": 0.1, "50": 0.5, "90": 0.9})
    n = typed.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))
    return n.join(wide, "cell_type", "left").select("cell_type", "n", *(F.col(f"v_{p}").alias(f"p{p}") for p in (10, 50, 90)))


def factor_fractions(molecules: DataFrame, factors: list[int]) -> DataFrame:
    """Row-normalised molecule counts per cell, a column for each factor."""
    p = molecules.where("cell_id <> 'UNASSIGNED'").groupBy("cell_id").pivot("factor", factors).count().na.fill(0)
    total = sum((F.col(str(f)) for f in factors[1:]), F.col(str(factors[0])))
    return p.select("cell_id", *((F.col(str(f)) / F.greatest(total, F.lit(1))).alias(f"factor_{f}") for f in factors))


def neighbor_matrix(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Row-normalised counts of neighbouring type pairs over edges (src, dst)."""
    t = cells.where("cell_type is not null").select("cell_idx", "cell_type")
    e = edges.join(t.withColumnsRenamed({"cell_idx": "src", "cell_type": "type_a"}), "src").join(t.withColumnsRenamed({"cell_idx": "dst", "cell_type": "type_b"}), "dst")
    n = e.groupBy("type_a", "type_b").agg(F.count(F.lit(1)).alias("n"))
    return n.select("type_a", "type_b", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("type_a"))).alias("share"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old whose key new lacks."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
