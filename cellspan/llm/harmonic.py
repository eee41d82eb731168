"""Harmonic packing: pieces of 1/1, 1/2, 1/4 ... of a sequence, as many in a sequence as fill it exactly.

A document is cut into pieces whose lengths divide the capacity: whole sequences first, then falling powers of two, so
that a class of length c has exactly capacity / c pieces in a sequence and no token of padding.  Every task fills the
sequences of its own documents, class by class, without a shuffle.  What a task has left at its end is less than one
sequence of each class; these rests alone are laid on one line by falling length, from counts by task and class.  As
every length divides the longer ones, no piece crosses the end of a sequence there; the last one, which may not be
full, is cut where its length has a binary digit, so that what is over also stands at powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import bound_batches, stage
from .tokenizers import encode

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, worker bigint, sequence bigint, place bigint"
#: Sequences that one task may fill: their numbers are task * this + a count.
EACH = 1 << 32


def lengths(n: int, size: int) -> list[int]:
    """Piece lengths of n tokens: whole sequences, then the powers of two of the rest, longest first."""
    rest = n % size
    return [size] * (n // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Filler:
    """The open sequence of each class; a class is closed when it has its fixed count of pieces."""

    def __init__(self, size: int, worker: int) -> None:
        self.size, self.worker, self.done, self.open = size, worker, 0, {}

    def put(self, piece: tuple) -> list[tuple]:
        """Rows of the sequence that the piece fills, if it does."""
        own = self.open.setdefault(piece[2], [])
        own.append(piece)
        if len(own) * piece[2] < self.size:
            return []
        number, self.open[piece[2]] = self.worker * EACH + self.done, []
        self.done += 1
        return [(*p, self.worker, number, k * p[2]) for k, p in enumerate(own)]

    def rest(self) -> list[tuple]:
        """What is open: without a sequence, with its number in the class."""
        return [(*p, self.worker, None, k) for own in self.open.values() for k, p in enumerate(own)]


def pieces(docs: DataFrame, size: int, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of every document, those of full sequences with their place, the others with a null sequence."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filler = Filler(size, TaskContext.get().partitionId())
        frame = lambda rows: pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64", "sequence": "Int64"})
        for p in parts:
            rows, seen = [], {}
            for doc_id, text in zip(p["doc_id"], p["text"], strict=True):
                own = seen.get(text)
                if own is None:
                    ids = np.array([*encode(tokenizer, text), end_id], dtype="<u4")
                    edges = np.cumsum([0, *lengths(len(ids), size)]).tolist()
                    own = seen[text] = [(a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids)) for a, b in zip(edges, edges[1:], strict=False)]
                for x in own:
                    rows += filler.put((doc_id, *x))
            yield frame(rows)
        yield frame(filler.rest())

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(cut, PIECES)


def pack_harmonic(
    docs: DataFrame, max_len: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    max_len is a power of two.  All sequences hold max_len tokens but for some that hold a smaller power of two: at most one
    for each binary digit of max_len in the whole result, so nothing needs padding.  A null or empty text is its end id alone;
    long texts are cut, none is shortened; repeated rows, equal texts and null ids are documents of their own; extra
    columns are ignored; an empty table gives an empty result.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len has to be a power of two")
    rows = stage(pieces(docs, max_len, tokenizer, end_id, id_col, text_col), "harmonic-pieces")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = rows.where("sequence is not null").select(*out, F.col("sequence").alias("sequence_id"), F.col("place").alias("offset"))

    # The rests: at most max_len / length - 1 pieces of each class from each task.
    rest = rows.where("sequence is null")
    counts = stage(rest.groupBy("length", "worker").agg(F.count(F.lit(1)).alias("n")), "harmonic-rests")  # a row for each task and class
    w = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("length", "worker", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("ahead"))
    tokens = {r["length"]: r["n"] * r["length"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each class
    total, at, begins = sum(tokens.values()), 0, []
    for length in sorted(tokens, reverse=True):
        begins.append((length, at))
        at += tokens[length]
    begins = docs.sparkSession.createDataFrame(begins, "length bigint, begin bigint")
    rest = rest.join(ahead, ["length", "worker"]).join(F.broadcast(begins), "length")
    rest = rest.withColumn("at", F.col("begin") + (F.col("ahead") + F.col("place")) * F.col("length"))
    # The last sequence ends where the line does: it goes as one sequence for each binary digit of its length.
    last, cuts, edge = total - total % max_len, [], total - total % max_len
    for length in lengths(total % max_len, max_len):
        cuts.append((edge, edge + length))
        edge += length
    begin = F.when(F.col("at") < last, F.col("at") - F.col("at") % max_len)
    for a, b in cuts:
        begin = begin.when(F.col("at").between(a, b - 1), F.lit(a))
    rest = rest.withColumn("begin", begin).select(*out, (-1 - F.col("begin")).alias("sequence_id"), (F.col("at") - F.col("begin")).alias("offset"))
    return full.unionByName(rest)
