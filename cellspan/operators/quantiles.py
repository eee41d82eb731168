"""Exact quantiles of groups that grow with the data, without sorting or buffering a group.

A mergeable sketch of fixed size brackets every wanted rank; a second pass counts what lies below a bracket and gathers, as
values with their counts, the few that lie inside; running counts there, cut into ranges of value, find the value of the
rank.  All groups, columns and quantiles go through the same passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sketch's rank error is one part in ACCURACY; brackets are two of them wide on both sides.
ACCURACY = 2000
#: Ranges of value in which a bracket's running counts are taken.
RANGES = 64


def quantile_table(df: DataFrame, groups: list[str], values: dict[str, Column], qs: list[float]) -> DataFrame:
    """(groups, name, q, n, value): of every column of values, in each group, the q-quantile of its n rows, linear between ranks.

    Nulls of a column don't count; NaN is the greatest value; null group keys are a group; a group without a value of a
    column has no row for it.
    """
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in values.items())))
    rows = df.select(*groups, named.alias("x")).select(*groups, "x.name", "x.v").where("v is not null")
    keys = [*groups, "name"]
    wide = 2 / ACCURACY
    low = [max(q - wide, 0.0) for q in qs]
    high = [min(q + wide, 1.0) for q in qs]
    s = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"),
        F.percentile_approx("v", low, ACCURACY).alias("low"), F.percentile_approx("v", high, ACCURACY).alias("high"),
    )
    # A bracket of few rows is the whole group; at the ends it reaches the least and the greatest value.
    def bracket(i: int, q: float) -> Column:
        whole = F.col("n") <= ACCURACY
        a = F.when(whole | F.lit(q <= wide), F.col("least")).otherwise(F.col("low")[i])
        b = F.when(whole | F.lit(q >= 1 - wide), F.col("most")).otherwise(F.col("high")[i])
        return F.struct(F.lit(q).alias("q"), a.alias("low"), b.alias("high"), ((F.col("n") - 1) * F.lit(q)).alias("at"))

    brackets = s.select(*(F.col(k).alias(f"_{k}") for k in keys), "n", F.array(*(bracket(i, q) for i, q in enumerate(qs))).alias("brackets"))
    same = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = c if same is None else same & c
    joined = rows.join(brackets, same).select(*keys, "n", "v", "brackets")
    v = F.col("v")
    # One row for each bracket that the value is in, or that lies above it: the value itself, or null for "below".
    seen = F.filter(F.col("brackets"), lambda b: v <= b["high"])
    seen = F.transform(seen, lambda b: F.struct(b["q"].alias("q"), b["at"].alias("at"), b["low"].alias("low"), b["high"].alias("high"), F.when(v >= b["low"], v).alias("inside")))
    counts = joined.select(*keys, "n", F.explode(seen).alias("b")).groupBy(*keys, "n", "b").agg(F.count(F.lit(1)).alias("c")).select(*keys, "n", "b.*", "c")
    span = F.col("high") - F.col("low")
    part = F.when(F.col("inside").isNull(), -1).otherwise(F.when(span > 0, F.least(F.floor((F.col("inside") - F.col("low")) / span * RANGES), F.lit(RANGES))).otherwise(0))
    counts = counts.withColumn("part", F.coalesce(part.cast("int"), F.lit(RANGES)))
    by = [*keys, "n", "q", "at"]
    sums = counts.groupBy(*by, "part").agg(F.sum("c").alias("c"))
    ahead = F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("ahead", ahead).where(_holds(F.col("ahead"), F.col("c"))).drop("c")  # RANGES + 2 rows a bracket at most
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in [*keys, "q", "part"]), "ahead")
    same = None
    for k in [*keys, "q", "part"]:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = c if same is None else same & c
    inside = counts.where("part >= 0").join(sums, same)
    upto = F.coalesce(F.sum("c").over(Window.partitionBy(*by, "part").orderBy("inside").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("begin", F.col("ahead") + upto).where(_holds(F.col("begin"), F.col("c")))
    # The values of the ranks floor(at) and floor(at) + 1.
    first, share = F.floor("at"), F.col("at") - F.floor("at")
    has = lambda r: (F.col("begin") <= r) & (r < F.col("begin") + F.col("c"))
    out = inside.groupBy(*by).agg(F.max(F.when(has(first), F.col("inside"))).alias("a"), F.max(F.when(has(first + 1), F.col("inside"))).alias("b"))
    return out.select(*groups, "name", "q", "n", F.when((share == 0) | F.col("b").isNull(), F.col("a")).otherwise(F.col("a") + share * (F.col("b") - F.col("a"))).alias("value"))


def _holds(begin: Column, count: Column) -> Column:
    """True where the ranks [begin, begin + count) hold floor(at) or the next."""
    return (begin <= F.floor("at") + 1) & (F.floor("at") < begin + count)


def wide_quantiles(df: DataFrame, groups: list[str], values: dict[str, Column], qs: dict[str, float]) -> DataFrame:
    """One row a group with a column {value}_{name of the quantile} for each, and {value}_n, the number of its rows."""
    t = quantile_table(df, groups, values, sorted(set(qs.values())))
    pick = lambda n, q: F.max(F.when((F.col("name") == n) & (F.col("q") == q), F.col("value")))
    out = [pick(n, q).alias(f"{n}_{label}") for n in values for label, q in qs.items()]
    return t.groupBy(*groups).agg(*out, *(F.max(F.when(F.col("name") == n, F.col("n"))).alias(f"{n}_n") for n in values))
