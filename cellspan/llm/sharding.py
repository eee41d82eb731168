"""Minimax contiguous sharding of documents, law ``bytes``.

Equal texts form atomic groups.  Groups are hashed into at most ``ATOMS`` atoms, so what the driver searches is
bounded whatever the corpus; an atom never splits a group.  Atoms are ordered by falling size.  The smallest
capacity for which a greedy left-to-right filling needs no more than ``n_shards`` shards is found by binary
search, and the order is cut into contiguous runs under that capacity.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stage

#: Atoms at most.  24 shards over 2**14 atoms differ by some 0.1 % of their size where no single text outweighs a shard.
ATOMS = 1 << 14


def reach(prefix: list[int], start: int, capacity: int) -> int:
    """The furthest end such that sizes[start:end] fit into capacity."""
    return bisect_right(prefix, prefix[start] + capacity) - 1


def shards_needed(prefix: list[int], capacity: int, most: int) -> int:
    """Shards that greedy filling takes; most + 1 if more than most."""
    at, used, n = 0, 0, len(prefix) - 1
    while at < n:
        used += 1
        end = reach(prefix, at, capacity)
        if end == at or used > most:
            return most + 1
        at = end
    return used


def smallest_capacity(sizes: list[int], n_shards: int) -> int:
    """Binary search of the smallest capacity that n_shards contiguous shards can keep to."""
    if not sizes:
        return 0
    prefix = [0, *accumulate(sizes)]
    low, high = max(max(sizes), -(-prefix[-1] // n_shards)), prefix[-1]
    while low < high:
        mid = (low + high) // 2
        if shards_needed(prefix, mid, n_shards) <= n_shards:
            high = mid
        else:
            low = mid + 1
    return low


def cut_points(sizes: list[int], n_shards: int) -> list[int]:
    """Ends of the shards but the last: under the smallest capacity, each cut is as near an equal share of what is left as it can be."""
    prefix, n = [0, *accumulate(sizes)], len(sizes)
    capacity = smallest_capacity(sizes, n_shards)
    need = [0] * (n + 1)  # shards that the atoms from here on take at least
    for p in range(n - 1, -1, -1):
        need[p] = 1 + need[reach(prefix, p, capacity)]
    cuts, at = [], 0
    for left in range(n_shards - 1, 0, -1):
        furthest = reach(prefix, at, capacity) if at < n else n
        target = prefix[at] + (prefix[n] - prefix[at]) / (left + 1)
        end = min(max(bisect_right(prefix, target) - 1, at), furthest)
        while end < furthest and (need[end] > left or target - prefix[end] > prefix[end + 1] - target):
            end += 1
        cuts.append(end)
        at = end
    return cuts


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot, grown_shard.

    Texts of any length count whole.  A null text counts as empty (size 8) and shares the group of empty texts; a null id is kept and takes the last
    slots of its atom; repeated rows are rows of their own and share a shard; extra columns are ignored; an empty
    table gives an empty result.  ``grown_shard`` is null, as it belongs to another law.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(ATOMS)).cast("int").alias("atom"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "sharding-rows",
    )
    atoms = stage(slim.groupBy("atom").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "sharding-atoms")
    sizes = sorted(((r["bytes"], r["atom"], r["n"]) for r in atoms.collect()), key=lambda x: (-x[0], x[1]))  # ATOMS rows at most
    cuts = cut_points([x[0] for x in sizes], n_shards)

    # Ranks within an atom that holds many rows are taken in several units of about `unit` rows.
    unit = max(64, sum(x[2] for x in sizes) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    place = Window.orderBy(F.desc("bytes"), "atom")  # over ATOMS rows at most
    atoms = atoms.select(
        "atom", F.ceil(F.col("n") / unit).cast("int").alias("salts"), (F.row_number().over(place) - 1).alias("pos")
    ).withColumn("shard", sum((F.when(F.col("pos") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int"))
    rows = slim.join(F.broadcast(atoms), "atom").withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int"))
    ahead = Window.partitionBy("shard").orderBy("pos", "salt").rowsBetween(Window.unboundedPreceding, -1)
    units = (
        rows.groupBy("atom", "salt", "shard", "pos").count()
        .select("atom", "salt", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    )
    units = stage(units, "sharding-units")  # ATOMS and some 4 a shuffle partition at most
    within = Window.partitionBy("atom", "salt").orderBy(F.asc_nulls_last("doc_id"), "rid")
    return (
        rows.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(units), ["atom", "salt"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
