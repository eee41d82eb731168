"""Readers and writers of the small files beside a bundle: regions, factor shares of a run, priors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = ("xmin", "ymin", "xmax", "ymax")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(name, xmin, ymin, xmax, ymax) of a regions file, in its order (ord).

    JSON: a list of objects, or one object with such a list as ``regions``; each has a name and four edges, or ``bounds`` with the four.
    CSV: a header with name and the edges.  A region without a name is called by its place, from region1 on.
    """
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("text"))
    one = "struct<name:string,bounds:array<double>,xmin:double,ymin:double,xmax:double,ymax:double>"
    kind = F.substring("text", 1, 1)
    listed = F.when(kind == "[", F.from_json("text", f"array<{one}>")).when(kind == "{", F.from_json("text", f"struct<regions:array<{one}>>")["regions"])
    lines = F.filter(F.split("text", r"\r?\n"), lambda r: F.trim(r) != "")
    header = F.transform(F.split(lines[0], ","), lambda c: F.trim(c))
    cell = lambda r, name: F.nullif(F.trim(F.get(F.split(r, ","), (F.array_position(header, name) - 1).cast("int"))), F.lit(""))
    rows = F.transform(F.slice(lines, 2, F.size(lines)), lambda r: F.struct(
        cell(r, "name").alias("name"), F.lit(None).cast("array<double>").alias("bounds"), *(cell(r, e).cast("double").alias(e) for e in EDGES),
    ))
    found = whole.select(F.posexplode(F.coalesce(listed, rows)).alias("ord", "r"))
    edge = lambda i, e: F.coalesce(F.get("r.bounds", F.lit(i)), F.col(f"r.{e}")).alias(e)
    return found.select("ord", F.coalesce("r.name", F.concat(F.lit("region"), F.col("ord") + 1)).alias("name"), *(edge(i, e) for i, e in enumerate(EDGES)))


def factor_fractions(cells: DataFrame, factors: list[int], annotation: DataFrame | None = None) -> DataFrame:
    """The shares of the given factors (from 1) of a run's cells: cell_id, what there is of transcript_count, dominant_factor and dominant_fraction,
    factor_k_fraction; with annotation (cell_id, cell_type), the type of each, null where it has none."""
    named = [c for c in ("transcript_count", "dominant_factor", "dominant_fraction") if c in cells.columns]
    out = cells.select("cell_id", *named, *(f"factor_{k}_fraction" for k in factors))
    return out.join(annotation.groupBy("cell_id").agg(F.min("cell_type").alias("cell_type")), "cell_id", "left") if annotation is not None else out


def priors_json(tables: dict[str, tuple[DataFrame, list[str], str]]) -> DataFrame:
    """One row, ``json``: nested maps of several tables; each is (table, key columns from the outside in, value column).

    The tables are priors: rows for types, factors and genes, not for cells.
    """
    parts: list[DataFrame] = []
    for name, (df, keys, value) in tables.items():
        nested = df.select(*(F.col(k).cast("string").alias(k) for k in keys), F.to_json(F.struct(F.col(value).alias("v"))).alias("j"))
        nested = nested.withColumn("j", F.expr("substring(j, 6, length(j) - 6)"))  # the value as it stands in JSON
        for depth in range(len(keys) - 1, -1, -1):
            pair: Column = F.concat(F.expr(f"substring(to_json(array({keys[depth]})), 2, length(to_json(array({keys[depth]}))) - 2)"), F.lit(":"), F.col("j"))
            nested = nested.groupBy(*keys[:depth]).agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(pair)), ","), F.lit("}")).alias("j"))
        parts.append(nested.select(F.lit(name).alias("name"), "j"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('"'), F.col("name"), F.lit('":'), F.col("j")))), ","), F.lit("}")).alias("json"))


def read_prior(text: DataFrame, name: str, keys: list[str], value: str, kind: str = "double") -> DataFrame:
    """A table of priors_json() again: the key columns, as strings, and the value."""
    of = kind
    for _ in keys:
        of = f"map<string,{of}>"
    rows = text.select(F.from_json("json", f"struct<`{name}`:{of}>")[name].alias("_"))
    for k in keys:
        rows = rows.select(*(c for c in rows.columns if c != "_"), F.explode("_").alias(k, "_"))
    return rows.withColumnRenamed("_", value)
