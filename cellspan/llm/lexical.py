"""Ranked lexical search with block-max pruning.

The forward index has a row for each block of documents that lie together in the input: their ids, sizes and
the counts of the terms that the queries ask for.  A block's greatest contribution of each term bounds what any of its
documents can score for a query.  Every task sorts its blocks by this bound, query by query, and scores them until the
bound drops below the k-th best score.  A first round, in which each task scores the best block of every query only,
gives all tasks a common threshold to begin with.  Queries go in blocks of bounded size, each in a pass of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import bound_batches, stage

#: A term is a run of characters outside these: ASCII letters and digits and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM)
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Documents and postings of an index block, postings that a task holds at a time, terms and queries of a pass.
DOCS, POSTINGS, HELD, TERMS, QUERIES = 128, 1 << 20, 1 << 22, 1 << 16, 4096
INDEX = "ids array<bigint>, known array<boolean>, sizes array<bigint>, ends array<int>, terms array<int>, counts array<int>, docs bigint, total bigint"


def terms(text: str | None) -> list[str]:
    """The terms of a text in order; A-Z only are lower-cased."""
    return _TERM.findall(text.translate(_LOWER)) if text else []


def forward_index(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:  # noqa: ANN001
    """Blocks of documents; vocabulary: a broadcast of the numbers of the terms that are kept.

    Documents without any kept term count for the statistics only.
    """

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = vocabulary.value.get
        cols = [c.split()[0] for c in INDEX.split(", ")]
        ids, known, sizes, ends, tids, tfs, n_docs, total = [], [], [], [], [], [], 0, 0
        for p in parts:
            rows = []
            for doc_id, text in zip(p["doc_id"], p["text"], strict=True):
                words = terms(text)
                n_docs, total = n_docs + bool(words), total + len(words)
                own = [(t, n) for w, n in Counter(words).items() if (t := number(w)) is not None]
                if own:
                    own.sort()
                    tids += [t for t, _ in own]
                    tfs += [n for _, n in own]
                    known.append(not pd.isna(doc_id))
                    ids.append(doc_id if known[-1] else 0)
                    sizes.append(len(words))
                    ends.append(len(tids))
                if len(ids) >= DOCS or len(tids) >= POSTINGS:
                    rows.append((ids, known, sizes, ends, tids, tfs, n_docs, total))
                    ids, known, sizes, ends, tids, tfs, n_docs, total = [], [], [], [], [], [], 0, 0
            if rows:
                yield pd.DataFrame(rows, columns=cols)
        if n_docs:
            yield pd.DataFrame([(ids, known, sizes, ends, tids, tfs, n_docs, total)], columns=cols)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(build, INDEX)


class Block:
    """One index block with the contribution of every posting, less the term's weight."""

    def __init__(self, row, docs: int, total: int) -> None:  # noqa: ANN001
        self.ids, self.known = np.asarray(row.ids, np.int64), np.asarray(row.known, bool)
        self.terms = np.asarray(row.terms, np.int64)
        ends = np.asarray(row.ends, np.int64)
        self.begins = np.concatenate([[0], ends[:-1]])
        m = 10 + (90 * np.asarray(row.sizes, np.int64) * docs) // total
        tf = np.asarray(row.counts, np.int64)
        self.value = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, ends - self.begins))

    def maxima(self, n_terms: int) -> np.ndarray:
        top = np.zeros(n_terms, np.int64)
        np.maximum.at(top, self.terms, self.value)
        return top

    def scores(self, weight: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weight[self.terms] * self.value, self.begins)


def best(score: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best in order: score falling, then id, ids that are null last."""
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return near[best(score[near], ids[near], known[near], k)] if len(near) < len(score) else np.lexsort((ids, ~known, -score))[:k]
    return np.lexsort((ids, ~known, -score))[:k]


def search(index: DataFrame, sent, docs: int, total: int, k: int, floors: dict[int, int], first: bool) -> DataFrame:  # noqa: ANN001
    """(q, score, doc_id) that can be among the k best of each query; sent: a broadcast of (weights, terms of each query).

    floors: scores that k documents reach.  first: the block of the greatest bound only, for every query.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, asked = sent.value
        n_terms = len(weights)
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        held = {}

        def see(blocks: list[Block]) -> None:
            tops = np.stack([b.maxima(n_terms) for b in blocks])
            own = np.zeros(n_terms, np.int64)
            for q, ts in asked:
                bound = tops[:, ts] @ weights[ts]
                own[ts] = weights[ts]
                mine, floor = held.get(q, none), max(floors.get(q, 1), 1)
                if len(mine[0]) >= k:
                    floor = max(floor, mine[0][-1])
                for b in np.argsort(-bound, kind="stable")[: 1 if first else None]:
                    if bound[b] < floor:
                        break  # bounds only fall
                    score = blocks[b].scores(own)
                    ok = score >= floor
                    if not ok.any():
                        continue
                    s, i, n = (np.concatenate(c) for c in zip(mine, (score[ok], blocks[b].ids[ok], blocks[b].known[ok]), strict=True))
                    order = best(s, i, n, k)
                    mine = s[order], i[order], n[order]
                    if len(order) >= k:
                        floor = max(floor, mine[0][-1])
                held[q] = mine
                own[ts] = 0

        blocks, size = [], 0
        for p in parts:
            for row in p.itertuples(index=False):
                if len(row.ids):
                    blocks.append(Block(row, docs, total))
                    size += len(blocks[-1].terms) + n_terms
                if size >= HELD:
                    see(blocks)
                    blocks, size = [], 0
        if blocks:
            see(blocks)
        found = [(q, s, i if n else None) for q, m in held.items() for s, i, n in zip(*(c.tolist() for c in m), strict=True)]
        yield pd.DataFrame(found, columns=["q", "score", "doc_id"]).astype({"q": "int32", "score": "int64", "doc_id": "Int64"})

    return index.mapInPandas(run, "q int, score bigint, doc_id bigint")


def query_blocks(spark: SparkSession, items: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The distinct queries (item_id, text, q) with terms, in blocks of at most QUERIES rows and, but for single longer ones, TERMS terms."""
    n_terms = F.size(F.array_distinct(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({TERM})"), 1)))
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct().withColumn("n", n_terms).where("n > 0")
    rows = stage(rows.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "item_id", "text").sortWithinPartitions("item_id", "text").withColumn("part", F.spark_partition_id()), "lexical-queries")
    # Blocks are cut within partitions, so that no task sees all queries.
    w = Window.partitionBy("part").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.greatest(F.floor((F.sum("n").over(w) - F.col("n")) / TERMS), F.floor((F.row_number().over(w) - 1) / QUERIES))
    rows = rows.withColumn("cut", cut).withColumn("cost", F.struct("part", "cut"))
    sizes = sorted((tuple(r["cost"]), r["n"], r["rows"]) for r in rows.groupBy("cost").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect())
    groups: list[list] = []
    for cost, n, count in sizes:  # neighbouring cuts that fit together share a pass
        if groups and groups[-1][1] + n <= TERMS and groups[-1][2] + count <= QUERIES:
            groups[-1] = [[*groups[-1][0], cost], groups[-1][1] + n, groups[-1][2] + count]
        else:
            groups.append([[cost], n, count])
    at = lambda cost: F.struct(F.lit(cost[0]).alias("part"), F.lit(cost[1]).cast("long").alias("cut"))
    return [rows.where(F.col("cost").between(at(g[0][0]), at(g[0][-1]))).select("item_id", "text") for g in groups]


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for each item; ties go to the smaller doc_id.

    Whole texts of all rows count, very long ones too.  A null or empty text has no terms.  Repeated rows are documents of
    their own; those with a null id come last among equal scores.  Every distinct (item, text) is answered on its own,
    repeated ones once; items without terms, or without a document of a score above 0, have no rows.  Extra columns are
    ignored; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    out = []
    for block in query_blocks(spark, items, item_col, item_text):
        rows = block.collect()  # at most QUERIES rows
        asked_terms = [sorted(set(terms(r["text"]))) for r in rows]
        names = sorted(set().union(*asked_terms))
        number = {t: i for i, t in enumerate(names)}
        vocabulary = spark.sparkContext.broadcast(number)
        index = stage(forward_index(docs, vocabulary, id_col, text_col), "lexical-index")
        sums = index.agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
        n, total = sums["docs"], sums["total"]
        if not n:
            continue
        df = np.zeros(len(names), np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the pass
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        asked = [(q, np.array([number[t] for t in ts], np.int64)) for q, ts in enumerate(asked_terms)]
        sent = spark.sparkContext.broadcast((weights, asked))
        top = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        first = search(index, sent, n, total, k, {}, True).withColumn("rank", F.row_number().over(top)).where(F.col("rank") == k)
        floors = {r["q"]: r["score"] for r in first.collect()}  # a row for each query of the pass
        found = search(index, sent, n, total, k, floors, False).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        keys = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], f"q int, item_id {items.schema[item_col].dataType.simpleString()}")
        out.append(found.join(F.broadcast(keys), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {items.schema[item_col].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, out)
