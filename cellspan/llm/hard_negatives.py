"""Hard negatives by a kNN join over Voronoi cells.

Rows get one more component, so that all have the same length and the largest inner product is the least distance;
anchors get 0 there.  Pivots from a bounded sample cut the space into Voronoi cells.  Anchors of neighbouring cells form groups of
bounded size; what a group knows is, for each of its cells, how far its anchors lie from the pivot and between which
distances a row can still serve one of them.  A row is copied to the groups that it might serve by these bounds, and there,
in parts of bounded size, an exact join follows.  It is done twice: for the positives, then, with their scores as
limits, for the negatives.  Bounds are widened against rounding, so that none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import bound_batches, checked_broadcast, stage
from .topk import HIGH, HUGE, LOW, numbered

#: Pivots, rows of the sample that gives pivots and first limits, bytes of either side of a local join.
PIVOTS, SAMPLE, SIDE = 64, 2048, 16 << 20
#: Rows of a part of the candidates at least.
LEAST = 2048
ANCHOR = "q bigint, anchor_id bigint, label bigint, x array<double>"


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all of b (whole numbers as doubles), held to the range of a long."""
    if np.linalg.norm(a, axis=1).max(initial=0) * np.linalg.norm(b, axis=1).max(initial=0) < 1 << 53:
        return np.rint(a @ b.T).astype(np.int64)
    whole = lambda m: [[int(v) for v in row] for row in m.tolist()]
    return np.array([[min(max(sum(map(int.__mul__, r, s)), LOW), HIGH) for s in whole(b)] for r in whole(a)], np.int64).reshape(len(a), len(b))


def first_of(ok: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k where ok: score falling, then id."""
    at = np.flatnonzero(ok)
    if len(at) > 4 * k:
        at = at[score[at] >= np.partition(score[at], -k)[-k]]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * positive <= 100 * s <= high * positive."""
    return -((-low * int(positive)) // 100), (high * int(positive)) // 100


def vectors(rows: DataFrame, scale: int, shift_every: int, classes: int, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """vec_id, label, x, norm (square of the length) of the rows that take part."""
    v = F.col("x")
    slim = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    slim = slim.where("vec_id is not null and label is not null and size(x) > 0")
    scaled = lambda c: F.when(F.abs(c * scale) < float(1 << 52), F.floor(c * scale).cast("double")).when(F.abs(c * scale) < HUGE, c * scale)
    slim = slim.select("vec_id", F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label")).alias("label"), F.transform(v, scaled).alias("x"))
    return slim.where(~F.exists(v, lambda c: c.isNull())).withColumn("norm", F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c))


class Space:
    """The augmented space: pivots, and distances to them."""

    def __init__(self, pivots: np.ndarray, most: float) -> None:
        self.pivots, self.most, self.dim = pivots, most, pivots.shape[1] - 1

    def filled(self, column: pd.Series) -> np.ndarray:
        if all(len(v) == self.dim for v in column):
            return np.stack(column.to_list()).astype(float)
        full = np.zeros((len(column), self.dim))
        for i, v in enumerate(column):
            full[i, : len(v)] = v
        return full

    def augmented(self, x: np.ndarray, anchor: bool) -> np.ndarray:
        more = np.zeros(len(x)) if anchor else np.sqrt(np.maximum(self.most - np.einsum("ij,ij->i", x, x), 0))
        return np.column_stack([x, more])

    def distances(self, x: np.ndarray, anchor: bool) -> np.ndarray:
        """To every pivot; rounding is taken care of by slack()."""
        a, p = self.augmented(x, anchor), self.pivots
        square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", p, p)[None] - 2 * (a @ p.T)
        return np.sqrt(np.maximum(square, 0))

    def slack(self) -> float:
        """More than what rounding can change in a distance."""
        return 1 + 1e-6 * np.sqrt(self.most)

    def reach(self, length2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance from an anchor of this squared length at which a row has the score."""
        return np.sqrt(np.maximum(length2 + self.most - 2 * score.astype(float), 0))


def dealt(anchors: DataFrame, candidates: DataFrame, space: Space, local: Callable, schema: str, tasks: int, copied: list | None = None) -> DataFrame:
    """The rows that local(anchors, candidates) gives for every group of anchors and part of the candidates that can serve it.

    anchors: q, anchor_id, label, x, cell, from_pivot, near, far (the distances between which a row can serve it), and more.
    candidates: vec_id, label, x, at.  copied: a list that takes the table of copies, to see how many there are.
    """
    spark, row_bytes = anchors.sparkSession, 8 * (space.dim + 1)
    n = anchors.count()
    most = max(1, SIDE // row_bytes)
    anchors = anchors.repartitionByRange(max(1, min(tasks, n // LEAST + 1)), "open", "cell", "q").sortWithinPartitions("open", "cell", "q")
    groups = stage(numbered(anchors, "negatives-groups").withColumn("group", F.floor(F.col("at") / min(most, LEAST * 4))).drop("at"), "negatives-anchors")
    bounds = groups.groupBy("group", "cell").agg(F.max("from_pivot").alias("radius"), F.min("near").alias("near"), F.max("far").alias("far"))
    bounds = bounds.collect()  # a row for each group, and one more for each cell at most
    by_group: dict[int, list] = {}
    for r in bounds:
        by_group.setdefault(r["group"], []).append((r["cell"], r["radius"], r["near"], r["far"]))
    sent = spark.sparkContext.broadcast((space, by_group))

    def served(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
        """Each group with the rows that can serve it."""
        space, by_group = sent.value
        for p in parts:
            if not len(p):
                continue
            d = space.distances(space.filled(p["x"]), False)
            for group, cells in by_group.items():
                serves = np.zeros(len(p), bool)
                for cell, radius, near, far in cells:
                    serves |= (d[:, cell] - radius <= far + 2 * space.slack()) & (d[:, cell] + radius >= near - 2 * space.slack())
                if serves.any():
                    yield group, p[serves]

    def meetings(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, p in served(parts):
            yield pd.DataFrame({"group": group, "part": p["part"].unique()})

    def copies_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, p in served(parts):
            yield p.assign(group=group)

    size = min(most, max(LEAST, candidates.count() // (2 * tasks)))
    candidates = candidates.select("vec_id", "label", "x", F.floor(F.col("at") / size).alias("part"))
    met = checked_broadcast(stage(candidates.mapInPandas(meetings, "group bigint, part bigint").distinct(), "negatives-met"))
    left = groups.join(met, "group").groupBy("group", "part")
    copies = candidates.mapInPandas(copies_of, "vec_id bigint, label bigint, x array<double>, part bigint, group bigint")
    if copied is not None:
        copied.append(copies)

    def join(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        space = sent.value[0]
        names = [c.split()[0] for c in schema.split(", ")]
        found = []
        if len(a) and len(b):
            x = space.filled(b["x"])
            ids, labels = b["vec_id"].to_numpy(), b["label"].to_numpy()
            for at in range(0, len(a), 256):
                some = a.iloc[at : at + 256]
                s = scores(space.filled(some["x"]), x)
                for row, score in zip(some.itertuples(index=False), s, strict=True):
                    found += local(row, score, ids, labels)
        return pd.DataFrame(found, columns=names).astype({c: "int64" for c in names})

    return left.cogroup(copies.groupBy("group", "part")).applyInPandas(join, schema)


def mine(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, shift_every: int = 7, classes: int = 10,
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; labels of rows whose id is divisible by shift_every are first moved on by
    one, modulo classes.  A positive is one of the first rows of the anchor's label, a negative one of the first rows of another
    label whose score is low to high hundredths of the positive's; first: score falling, then id.  Components count as
    floor(scale * x).  Rows with a null id or label, a null or empty vector, or null or non-finite components (HUGE and more
    after scaling among them) take no part; vectors of unlike length count as filled with zeros.  Scores beyond a long count
    as its end.  Rows of one id are candidates each, but never for an anchor of that id; of several anchor rows of an id every
    distinct (label, vector) is answered on its own, equal ones once.  An anchor without a positive, or a pair without a
    negative in its window, has no rows.  Extra columns are ignored; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = numbered(vectors(rows, scale, shift_every, classes, id_col, label_col, vec_col), "negatives-rows")
    seen = whole.agg(F.max(F.size("x")).alias("dim"), F.max("norm").alias("most")).first()
    if not seen["dim"]:
        return spark.createDataFrame([], out)
    sample = whole.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(SAMPLE).toPandas()  # SAMPLE rows
    space = Space(np.zeros((1, seen["dim"] + 1)), seen["most"])
    sx, s_ids, s_labels = space.filled(sample["x"]), sample["vec_id"].to_numpy(), sample["label"].to_numpy()
    space.pivots = np.unique(space.augmented(sx[:PIVOTS], False), axis=0)
    sent = spark.sparkContext.broadcast((space, sx, s_ids, s_labels))

    def positive(row, score, ids, labels) -> list[tuple]:  # noqa: ANN001
        own = first_of((labels == row.label) & (ids != row.anchor_id), score, ids, positives)
        return [(row.q, *p) for p in zip(ids[own].tolist(), score[own].tolist(), strict=True)]

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The anchors' cells, and how far a row can be that is among the positives: as far as the last of those in the sample."""
        space, sx, s_ids, s_labels = sent.value
        for p in parts:
            if not len(p):
                continue
            x = space.filled(p["x"])
            d = space.distances(x, True)
            p["cell"] = d.argmin(axis=1)
            p["from_pivot"] = d.min(axis=1)
            known = [positive(r, s, s_ids, s_labels) for r, s in zip(p.itertuples(index=False), scores(x, sx), strict=True)]
            full = np.array([len(f) == positives for f in known])
            last = np.array([f[-1][2] if len(f) == positives else LOW for f in known])
            p["near"], p["far"] = 0.0, np.where(full & (last > LOW), space.reach(np.einsum("ij,ij->i", x, x), last), np.inf)
            p["open"] = ~full
            yield p

    more = ", cell int, from_pivot double, near double, far double, open boolean"
    asked = whole.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "x").dropDuplicates()
    asked = stage(asked.withColumn("q", F.monotonically_increasing_id()).select("q", "anchor_id", "label", "x").mapInPandas(placed, ANCHOR + more), "negatives-asked")
    candidates = whole.select("vec_id", "label", "x", "at")
    found = dealt(asked, candidates, space, positive, "q bigint, positive_id bigint, positive_score bigint", tasks)
    order = Window.partitionBy("q").orderBy(F.desc("positive_score"), "positive_id")
    own = stage(found.withColumn("p", F.row_number().over(order)).where(F.col("p") <= positives), "negatives-positives")

    # An anchor's rows of other labels are needed from the lowest window's floor, or what the sample has already, to the highest window's end.
    known = own.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("p", "positive_id", "positive_score"))).alias("own"))
    known = known.select("q", F.col("own.positive_id").alias("ps"), F.col("own.positive_score").alias("scores"))

    def negative(row, score, ids, labels) -> list[tuple]:  # noqa: ANN001
        other, got = labels != row.label, []
        for k, s in enumerate(row.scores):
            a, b = window_of(s, low, high)
            if a <= b:
                at = first_of(other & (score >= a) & (score <= b), score, ids, negatives)
                got += [(row.q, k, i, v) for i, v in zip(ids[at].tolist(), score[at].tolist(), strict=True)]
        return got

    def limited(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, sx, s_ids, s_labels = sent.value
        for p in parts:
            if not len(p):
                continue
            x = space.filled(p["x"])
            ends = []
            for row, score in zip(p.itertuples(index=False), scores(x, sx), strict=True):
                windows, floors = [window_of(s, low, high) for s in row.scores], []
                for k, (a, _) in enumerate(windows):
                    got = [v for _, of, _, v in negative(row, score, s_ids, s_labels) if of == k]
                    floors.append(got[-1] if len(got) == negatives else a)
                windows = [(f, b) for f, (_, b) in zip(floors, windows, strict=True) if f <= b]
                ends.append((min((a for a, _ in windows), default=HIGH), max((b for _, b in windows), default=LOW)))
            square, ends = np.einsum("ij,ij->i", x, x), np.array(ends)
            p["near"], p["far"] = space.reach(square, ends[:, 1]), space.reach(square, ends[:, 0])
            yield p[ends[:, 0] <= ends[:, 1]]

    asked = asked.drop("near", "far", "open").join(known, "q").withColumns({"near": F.lit(0.0), "far": F.lit(0.0), "open": F.lit(False)})
    asked = stage(asked.mapInPandas(limited, asked.schema), "negatives-limited")
    found = dealt(asked, candidates, space, negative, "q bigint, k bigint, negative_id bigint, negative_score bigint", tasks)
    order = Window.partitionBy("q", "k").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    pairs = own.join(asked.select("q", "anchor_id"), "q").withColumn("k", F.col("p") - 1)
    return found.join(pairs, ["q", "k"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
