"""Exact top-k inner products with norm-sorted candidates.

Candidates lie in ranges of falling length.  Vectors are rotated by the singular vectors of the whole table, so
that the first coordinates carry most of an inner product.  The longest vectors give every query a first
threshold; from it follows the last range that can hold one of its k best (Cauchy-Schwarz), and queries that reach
alike far are put into blocks.  A block meets each range that it reaches in a group of its own, of bounded size on
both sides.  There, a query drops candidates block by block: by length, then by partial sums over more and more
leading coordinates plus the product of the residual lengths; the rest get exact integer scores.  Bounds are
widened by SLACK against rounding, so pruning never loses a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import bound_batches, checked_broadcast, stage

#: Candidates that are bounded at a time, rows of greatest length that give the first thresholds, rows of a block of queries at most.
BLOCK, SEED, QUERIES = 1024, 1024, 4096
#: Rows of a range of candidates: at least and at most; between, some two ranges for each shuffle partition.
LEAST, MOST = 4096, 65536
SLACK = 1e-6
#: Components beyond WIDE go by Python's integers; those of HUGE and more count as not finite.
WIDE, HUGE = float(1 << 24), 1e100
LOW, HIGH = -(1 << 63) + 1, (1 << 63) - 1


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, held to the range of a long; whole numbers as doubles."""
    out = np.empty(len(q), np.int64)
    wide = (np.abs(q).max(axis=1) > WIDE) | (np.abs(x).max(axis=1) > WIDE) if len(q) else np.zeros(0, bool)
    narrow = np.flatnonzero(~wide)
    for a in range(0, len(narrow), 100_000):
        i = narrow[a : a + 100_000]
        out[i] = np.einsum("ij,ij->i", q[i].astype(np.int64), x[i].astype(np.int64))
    for i in np.flatnonzero(wide):
        out[i] = min(max(sum(int(a) * int(b) for a, b in zip(q[i], x[i], strict=True)), LOW), HIGH)
    return out


def best_rows(
    q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, rotation: np.ndarray, floor: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query numbers, vec ids, scores) that can be among the k best of each query; x comes in falling length, floor: scores below it don't count."""
    head, more = max(1, q.shape[1] // 4), max(1, q.shape[1] // 2)
    qr, xr = q @ rotation, x @ rotation
    q_len, x_len = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    q_tail, x_tail = (np.linalg.norm(v[:, head:], axis=1) for v in (qr, xr))
    q_rest, x_rest = (np.linalg.norm(v[:, more:], axis=1) for v in (qr, xr))
    whole = q_len.max(initial=0) * x_len.max(initial=0) < 1 << 53  # then sums of whole numbers are exact in doubles
    floor = floor.astype(float).copy()
    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    for at in range(0, len(x), BLOCK):
        s = slice(at, at + BLOCK)
        alive = np.flatnonzero(q_len * x_len[at] * (1 + SLACK) + SLACK >= floor)
        if not len(alive):
            break  # lengths only fall
        open_ = q_ids[alive, None] != x_ids[None, s]
        bound = qr[alive, :head] @ xr[s, :head].T + np.outer(q_tail[alive], x_tail[s]) + SLACK * (1 + np.outer(q_len[alive], x_len[s]))
        open_ &= bound >= floor[alive, None]
        left = np.count_nonzero(open_)
        if not left:
            continue
        if whole and left * 50 > open_.size:  # many are left: all scores in one product, and the k-th of the block as a threshold
            scores = np.where(open_, q[alive] @ x[s].T, -np.inf)
            low = floor[alive]
            if scores.shape[1] > k:
                low = np.maximum(low, np.partition(scores, -k, axis=1)[:, -k])
            i, j = np.nonzero(open_ & (scores >= low[:, None]))
            score = scores[i, j].astype(np.int64)
            i, j = alive[i], j + at
        else:  # few are left: they see more coordinates, then the rest
            i, j = np.nonzero(open_)
            i, j = alive[i], j + at
            near = np.zeros(len(i), bool)
            for a in range(0, len(i), 100_000):
                m, n = i[a : a + 100_000], j[a : a + 100_000]
                part = np.einsum("ij,ij->i", qr[m, :more], xr[n, :more]) + q_rest[m] * x_rest[n] + SLACK * (1 + q_len[m] * x_len[n])
                near[a : a + 100_000] = part >= floor[m]
            i, j = i[near], j[near]
            score = np.concatenate([np.empty(0, np.int64), *(products(q[i[a : a + 100_000]], x[j[a : a + 100_000]]) for a in range(0, len(i), 100_000))])
        ok = score >= floor[i]
        i, ids, score = (np.concatenate(c) for c in zip(held, (i[ok], x_ids[j[ok]], score[ok]), strict=True))
        order = np.lexsort((ids, -score, i))
        i, ids, score = i[order], ids[order], score[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        held = (i[nth < k], ids[nth < k], score[nth < k])
        kth = nth == k - 1
        floor[i[kth]] = np.maximum(floor[i[kth]], score[kth])
    return held


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, staged, with ``at``: the number of the row in the order of partitions and of rows within them."""
    rows = stage(df.withColumn("at", F.monotonically_increasing_id()), name)  # the partition above, the place in it in the lower 33 bits
    part = F.shiftright("at", 33)
    sizes = sorted((r["part"], r["count"]) for r in rows.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before = rows.sparkSession.createDataFrame([(p, sum(n for _, n in sizes[:k])) for k, (p, _) in enumerate(sizes)], "part bigint, before bigint")
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("part", part).join(F.broadcast(before), "part").withColumn("at", F.col("before") + place).drop("part", "before")


def top_k(rows: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by ``every``.

    Components count as floor(scale * x).  Rows with a null id, a null or empty vector, or null or non-finite
    components (HUGE and more after scaling among them) take no part; vectors of unlike length are compared over the
    coordinates they share (the shorter one counts as filled with zeros).  Scores are exact; beyond a long they count
    as its end.  Ties go to the smaller id.  Rows of one id are candidates each, but never for a query of that id; of
    several rows of a query id every distinct vector is answered on its own, equal ones once.  Extra columns are
    ignored; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    x = F.col("x")
    whole = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).where("vec_id is not null and size(x) > 0")
    scaled = lambda v: F.when(F.abs(v * scale) < float(1 << 52), F.floor(v * scale).cast("double")).when(F.abs(v * scale) < HUGE, v * scale)
    whole = whole.select("vec_id", F.transform(x, scaled).alias("x"))
    whole = whole.where(~F.exists(x, lambda v: v.isNull()))
    whole = whole.withColumn("norm", F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = numbered(whole.repartitionByRange(tasks, F.desc("norm"), F.col("vec_id")).sortWithinPartitions(F.desc("norm"), "vec_id"), "topk-rows")
    totals = whole.agg(F.max(F.size("x")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    dim, out = totals["dim"], "query_id bigint, rank int, vec_id bigint, score bigint"
    if not dim:
        return spark.createDataFrame([], out)
    length = min(MOST, max(LEAST, totals["n"] // (2 * tasks)))

    def filled(p: pd.DataFrame) -> np.ndarray:
        if all(len(v) == dim for v in p["x"]):
            return np.stack(p["x"].to_list()).astype(float)
        full = np.zeros((len(p), dim))
        for i, v in enumerate(p["x"]):
            full[i, : len(v)] = v
        return full

    def gram(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for p in parts:
            if len(p):
                m = filled(p)
                m /= np.maximum(np.linalg.norm(m, axis=1), 1)[:, None]  # directions: long vectors shall not decide alone
                total += m.T @ m
        yield pd.DataFrame({"i": np.repeat(np.arange(dim), dim), "j": np.tile(np.arange(dim), dim), "v": total.ravel()})

    sums = whole.select("x").mapInPandas(gram, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # dim x dim
    m = np.zeros((dim, dim))
    m[sums["i"], sums["j"]] = sums["v"]
    rotation = np.linalg.svd(m)[0]

    seeds = whole.orderBy(F.desc("norm"), "vec_id").limit(SEED).toPandas()  # SEED rows
    sx, s_ids = filled(seeds), seeds["vec_id"].to_numpy()

    def thresholds(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                q, floor = filled(p), np.full(len(p), -np.inf)
                i, _, score = best_rows(q, p["vec_id"].to_numpy(), sx, s_ids, rotation, floor, k)
                kth = np.arange(len(i)) - np.searchsorted(i, i) == k - 1
                floor[i[kth]] = score[kth]
                lengths = np.linalg.norm(q, axis=1)
                p["floor"] = floor
                # Candidates shorter than this are out; widened against rounding.
                p["reach"] = np.where(floor > 0, (floor - SLACK) / np.maximum(lengths, 1e-9) * (1 - 2 * SLACK), 0.0)
                yield p

    asked = whole.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "x"]).select("vec_id", "x")
    asked = stage(asked.mapInPandas(thresholds, "vec_id bigint, x array<double>, floor double, reach double"), "topk-asked")
    blocks = -(-asked.count() // QUERIES)
    if not blocks:
        return spark.createDataFrame([], out)
    asked = numbered(asked.repartitionByRange(blocks, "reach", "vec_id"), "topk-queries").withColumnRenamed("at", "q")
    asked = asked.withColumn("block", F.floor(F.col("q") / QUERIES))
    whole = whole.withColumn("range", F.floor(F.col("at") / length))

    # (block, range) pairs that can hold a result: two bounded lists, n / QUERIES / every and n / length rows.
    reach = asked.groupBy("block").agg(F.min("reach").alias("reach"))
    longest = whole.groupBy("range").agg(F.sqrt(F.max("norm")).alias("longest"))
    met = stage(longest.join(F.broadcast(reach), F.col("longest") * (1 + SLACK) + SLACK >= F.col("reach")).select("block", "range"), "topk-met")
    met = checked_broadcast(met)

    def search(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(xs):
            return pd.DataFrame({"q": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        xs, q_ids = xs.sort_values("at"), qs["vec_id"].to_numpy()
        i, ids, score = best_rows(filled(qs), q_ids, filled(xs), xs["vec_id"].to_numpy(), rotation, qs["floor"].to_numpy(), k)
        return pd.DataFrame({"q": qs["q"].to_numpy()[i], "query_id": q_ids[i], "vec_id": ids, "score": score})

    left = asked.join(met, "block").groupBy("block", "range")
    right = whole.join(met, "range").select("block", "range", "at", "vec_id", "x").groupBy("block", "range")
    found = left.cogroup(right).applyInPandas(search, "q bigint, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
