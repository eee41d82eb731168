"""Rules of admixture from neighbours: a factor that a type has more of beside the type that it belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.functions import columns


def native_types(fractions: DataFrame) -> DataFrame:
    """(factor, source): the type with the largest mean share of each factor, of equal ones the first; fractions: cell_id, cell_type, factor, share (0s may lack)."""
    cells = fractions.select("cell_id", "cell_type").distinct().groupBy("cell_type").agg(F.count(F.lit(1)).alias("cells"))
    sums = fractions.groupBy("factor", "cell_type").agg(F.sum("share").alias("share")).join(cells, "cell_type")
    return sums.groupBy("factor").agg(F.min_by("cell_type", F.struct(F.round(-F.col("share") / F.col("cells"), 9), "cell_type")).alias("source"))


def cooccurrence(fractions: DataFrame, edges: DataFrame, types: DataFrame, native: DataFrame) -> DataFrame:
    """factor, source, target, n_with, n_without, mean_with, mean_without, delta, t, df: shares of target cells with and without a neighbour of the source type.

    fractions (cell_id, factor, share): what has no row is 0.  edges (src, dst) between cells; types (cell_id, cell_type), null types take no
    part; native (factor, source): a row for each factor, few.  t and df (Welch) are null where a side has fewer than two cells or nothing varies.
    """
    typed = types.where("cell_type is not null")
    beside = edges.join(typed.select(F.col("cell_id").alias("dst"), F.col("cell_type").alias("source")), "dst").select(F.col("src").alias("cell_id"), "source").distinct().withColumn("near", F.lit(True))
    grid = typed.crossJoin(F.broadcast(native)).where("cell_type <> source")  # factors rows
    rows = grid.join(beside, ["cell_id", "source"], "left").join(fractions.select("cell_id", "factor", "share"), ["cell_id", "factor"], "left")
    near, share = F.coalesce("near", F.lit(False)), F.coalesce("share", F.lit(0.0))
    side = lambda f, c, k: f(F.when(c, share)).alias(k)
    s = rows.groupBy("factor", "source", F.col("cell_type").alias("target")).agg(
        side(F.count, near, "n_with"), side(F.count, ~near, "n_without"), side(F.avg, near, "mean_with"), side(F.avg, ~near, "mean_without"),
        side(F.var_samp, near, "v1"), side(F.var_samp, ~near, "v0"),
    )
    q1, q0 = F.col("v1") / F.col("n_with"), F.col("v0") / F.col("n_without")
    moves = (F.col("n_with") > 1) & (F.col("n_without") > 1) & (q1 + q0 > 0)
    delta = F.col("mean_with") - F.col("mean_without")
    # try_divide: a side whose shares are all equal adds nothing.
    df = (q1 + q0) * (q1 + q0) / (q1 * q1 / (F.col("n_with") - 1) + q0 * q0 / (F.col("n_without") - 1))
    s = s.withColumns({"delta": delta, "t": F.when(moves, delta / F.sqrt(q1 + q0)), "df": F.when(moves, df)})
    return s.drop("v1", "v0")


def neighbor_rules(strata: DataFrame, least: int = 30, level: float = 0.01, effect: float = 0.005) -> DataFrame:
    """cooccurrence() with p (two-sided) and is_rule: ``least`` cells on both sides, t above 0, an effect, p under the level."""
    p = F.when(F.col("t").isNotNull(), F.least(2 * columns.student_tail(F.abs("t"), F.col("df")), F.lit(1.0)))
    enough = (F.col("n_with") >= least) & (F.col("n_without") >= least)
    ok = enough & (F.col("t") > 0) & (F.col("delta") >= effect) & (F.col("p") < level)
    return strata.withColumn("p", p).withColumn("is_rule", F.coalesce(ok, F.lit(False)))
