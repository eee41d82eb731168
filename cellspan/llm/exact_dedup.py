"""Exact deduplication with a heavy-hitter split.

A Misra-Gries frequent-items sketch (``approx_top_k_*``, the weighted variant of Apache DataSketches) finds
candidate digests in one pass of partial aggregation.  Their exact counts and first rows, at most ``TOP`` of
them, are then verified and broadcast: rows of frequent texts are settled on the map side.  All other digests
take an ordinary shuffle: they are summed up on the map side first, and narrow rows are joined with the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import filter_by_keys, free_names, quoted, stage

#: Candidates asked of the sketch, and counters that it keeps: a digest with more than 3.5 / TRACKED of all rows is found.
TOP, TRACKED, BRANCHES = 256, 1024, 64

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null as empty; every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def frequent(rows: DataFrame, key: str) -> list[int]:
    """Candidate heavy hitters among long keys: sketches by task, merged in two levels."""
    parts = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(BRANCHES)).alias("branch")).agg(
        F.expr(f"approx_top_k_accumulate({key}, {TRACKED})").alias("sketch")
    )
    # Grouped by a constant: a partition without sketches then adds none, which the merge can't take.
    found = parts.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))
    top = found.select(F.expr(f"approx_top_k_estimate(sketch, {TOP})").alias("top")).first()
    return [x["item"] for x in top["top"]] if top else []


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones; texts of any length are read whole.  Of repeated rows (equal text and id) exactly one
    is kept.  A null id comes after all others and stays only if its whole group has none.  Extra columns are ignored;
    an empty table gives an empty result.
    """
    rows = stage(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
        .select("*", F.monotonically_increasing_id().alias("rid"), F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long").alias("key")),
        "exact-rows",
    )
    total = rows.count()
    candidates = frequent(rows, "key") if total else []
    first = F.min_by(F.struct("doc_id", "rid"), F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))
    verified = (
        rows.where(F.col("key").isin(candidates))
        .groupBy("key", "text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
        .where(F.col("group_size") > max(8, total // (2 * TRACKED)))
        .select("key", "text_sha256", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"))
    )
    verified = stage(verified, "exact-heavy")  # fewer than 2 * TRACKED rows, as each holds more than that share
    heavy = rows.join(F.broadcast(verified), ["key", "text_sha256"])
    light = rows.join(F.broadcast(verified), ["key", "text_sha256"], "left_anti")
    groups = light.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
    rest = light.join(groups, "text_sha256").select("*", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"))
    out = ["doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256"]
    return heavy.select(*out).unionByName(rest.select(*out))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups() does not keep, with all their columns, whatever their names.

    Where ids name one row each, the ids of what goes are enough.  Else rows are told apart by id and text, null ids
    among them, and of repeated rows any one stays.
    """
    groups = stage(exact_groups(docs, id_col, text_col), "exact-groups")
    dropped = groups.where(~F.col("kept")).select(F.col("doc_id").alias(id_col))
    kept = groups.where("kept").select(F.col("doc_id").alias(id_col))
    clash = dropped.join(kept, id_col, "left_semi")
    if clash.isEmpty() and dropped.where(F.col(id_col).isNull()).isEmpty():
        return filter_by_keys(docs, dropped, id_col, "left_anti")
    own_id, own_sha, n = free_names(docs, "kept_id", "kept_sha", "n")
    pairs = groups.where("kept").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha)).distinct()
    sha = F.sha2(normalised(docs[text_col]), 256)
    found = docs.join(pairs, docs[id_col].eqNullSafe(pairs[own_id]) & (sha == pairs[own_sha]))
    first = Window.partitionBy(own_id, own_sha).orderBy(own_id)
    return found.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).select(*map(quoted, docs.columns))
