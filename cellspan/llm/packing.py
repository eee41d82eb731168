"""Best-fit packing of documents into sequences by minimum bin slack.

What has to be packed is the histogram of piece lengths, at most ``max_len`` numbers whatever the corpus.  Bin
by bin, the largest length left is taken and a bitset subset-sum dynamic program over the lengths left finds the
fullest combination with it; the combination is removed as often as the counts allow.  Pieces then find their
place by their rank among those of equal length, in a broadcast table whose size follows from max_len alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stage
from .tokenizers import encode

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def fullest(counts: list[int], most: int, room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination of lengths up to most, within counts, whose sum comes nearest to room from below."""
    reached, mask, goal, steps = 1, (1 << (room + 1)) - 1, 1 << room, []
    for length in range(min(most, room), 0, -1):
        left, k = min(counts[length], room // length), 1
        while left:  # binary splitting of the count
            k = min(k, left)
            steps.append((length, k, reached))
            reached |= (reached << (length * k)) & mask
            if reached & goal:
                left = 0
                break
            left -= k
            k *= 2
        if reached & goal:
            break
    at, found = reached.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + k
            at -= length * k
    return list(found.items())


def minimum_bin_slack(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, pieces of it)]): how often to use each combination; the lengths of each by falling size."""
    counts = [0] * (size + 1)
    for length, n in histogram.items():
        counts[length] = n
    plan, top = [], size
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return plan
        counts[top] -= 1
        rest = dict(fullest(counts, top, size - top))
        counts[top] += 1
        rest[top] = rest.get(top, 0) + 1
        times = min(counts[length] // k for length, k in rest.items())
        for length, k in rest.items():
            counts[length] -= k * times
        plan.append((times, sorted(rest.items(), reverse=True)))


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): ranks of a length in [first, end) take this offset in consecutive sequences."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, combination in plan:
        offset = 0
        for length, k in combination:
            for _ in range(k):
                at = used.get(length, 0)
                out.append((length, at, at + times, sequence, offset))
                used[length] = at + times
                offset += length
        sequence += times
    return out


def pieces(docs: DataFrame, max_len: int, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of every document: ids by the tokenizer, then end_id; only documents over max_len are cut, the first piece takes the remainder."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows, seen = [], {}
            for doc_id, text in zip(p["doc_id"], p["text"], strict=True):
                own = seen.get(text)
                if own is None:
                    ids = np.array([*encode(tokenizer, text), end_id], dtype="<u4")
                    first = len(ids) % max_len or max_len
                    edges = [0, *range(first, len(ids) + 1, max_len)]
                    own = seen[text] = [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
                rows += [(doc_id, *x) for x in own]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(cut, PIECES)


def pack_documents(
    docs: DataFrame, max_len: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and is the single end id; repeated rows and null ids are documents of their own;
    extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = stage(pieces(docs, max_len, tokenizer, end_id, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "packing-pieces")
    histogram = rows.groupBy("length").count()
    counts = {r["length"]: r["count"] for r in histogram.collect()}  # max_len rows at most
    table = spark.createDataFrame(places(minimum_bin_slack(counts, max_len)), "length bigint, first bigint, end bigint, sequence bigint, offset bigint")

    # Lengths of many pieces (full ones, those of copied documents) are ranked in units of about `unit` rows.
    unit = max(64, sum(counts.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = histogram.select("length", F.ceil(F.col("count") / unit).cast("int").alias("salts"))
    rows = rows.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int"))
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    units = rows.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    units = stage(units, "packing-units")  # max_len and some 4 a shuffle partition at most
    within = Window.partitionBy("length", "salt").orderBy("rid")
    ranked = rows.withColumn("n", F.row_number().over(within) - 1).join(F.broadcast(units), ["length", "salt"]).withColumn("rank", F.col("ahead") + F.col("n"))
    table = table.withColumnRenamed("length", "of")
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
