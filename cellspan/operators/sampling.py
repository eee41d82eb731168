"""Draws of states and templates for cells, by counted random numbers: the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspan.operators.fields import drawn
from cellspan.operators.ranks import places


def _number(key: str, seed: int, stream: int) -> Column:
    return drawn(F.col(key), F.lit(seed).cast("long"), F.lit(stream).cast("long"))


def sample_states(cells: DataFrame, distributions: DataFrame, seed: int, default: str = "full") -> DataFrame:
    """cells (key, cell_type) with ``state``, drawn by the type's row weights in distributions (cell_type, ord, state, p).

    Weights need not add up to 1; negative and null ones count as 0; a type without a weight above 0, or a null type, has the default.
    """
    d = distributions.withColumn("p", F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(0.0)))
    w = Window.partitionBy("cell_type").orderBy("ord")  # a row for each state
    upto = d.select("cell_type", "ord", "state", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("p").over(Window.partitionBy("cell_type")).alias("whole"))
    table = upto.where("whole > 0").groupBy("cell_type").agg(F.sort_array(F.collect_list(F.struct("ord", (F.col("upto") / F.col("whole")).alias("upto"), "state"))).alias("table"))
    u = _number("key", seed, 1)
    hit = F.filter("table", lambda s: s["upto"] > F.col("u"))
    state = F.coalesce(F.get(hit, F.lit(0))["state"], F.element_at("table", -1)["state"], F.lit(default))
    return cells.withColumn("u", u).join(table, "cell_type", "left").withColumn("state", state).drop("table", "u")


def sample_templates(cells: DataFrame, bank: DataFrame, seed: int) -> DataFrame:
    """cells (key, cell_type, zone) with ``template``: one of the bank (template, cell_type, zone) of the same type and zone, else of the type, else any.

    Each of a pool is as likely as any other.  Pools are numbered once, whatever their size; a cell finds its number by a join.
    """
    pools = bank.select("template", "cell_type", "zone", F.lit(0).alias("all"))
    out = cells.withColumn("u", _number("key", seed, 2))
    found = []
    for name, keys in (("zoned", ["cell_type", "zone"]), ("typed", ["cell_type"]), ("any", ["all"])):
        group = F.concat_ws("\x1f", *(F.col(k).cast("string") for k in keys))
        usable = pools.dropna(subset=[k for k in keys if k != "all"]).withColumn("pool", group)
        numbered = places(usable.select("pool", "template"), "pool", ["template"])
        sizes = numbered.where("place = 0").select("pool", F.col("size").alias("n"))
        whole = F.lit(True)
        for k in keys:
            whole = whole & (F.col(k).isNotNull() if k != "all" else F.lit(True))
        mine = F.when(whole, F.concat_ws("\x1f", *(F.col(k).cast("string") if k != "all" else F.lit("0") for k in keys)))
        out = out.withColumn("pool", mine).join(sizes, "pool", "left").withColumn("place", F.least(F.floor(F.col("u") * F.col("n")), F.col("n") - 1))
        out = out.join(numbered.select("pool", "place", F.col("template").alias(name)), ["pool", "place"], "left").drop("pool", "place", "n")
        found.append(name)
    return out.withColumn("template", F.coalesce(*found)).drop("u", *found)


def split_manifest(crops: DataFrame) -> DataFrame:
    """(split, n, crops) of crops (crop_id, split): how many and which, in order; train, val and test are there also when they are empty."""
    three = crops.sparkSession.createDataFrame([("train",), ("val",), ("test",)], "split string")
    n = crops.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("crop_id")).alias("crops"))
    none = F.array().cast("array<string>")
    return three.join(n, "split", "full").select("split", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("crops", none).alias("crops"))
