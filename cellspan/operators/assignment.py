"""Optimal one-to-one matching of sparse pairs: as many pairs as possible, and of these the least sum of costs.

Pairs fall into connected components, which do not touch each other.  Components of bounded size are solved exactly by
shortest augmenting paths, many to a task; a larger one goes through an auction with prices, in rounds over tables.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellspan.operators.models import components
from cellspan.operators.staging import cut

#: Pairs of a component that one task solves exactly.
MOST = 4000


def best_matching(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The matching of most pairs and, of these, the least cost; (a, b, cost) of one component, costs not below 0."""
    out_of, cost = defaultdict(list), {}
    for a, b, c in sorted(pairs):
        if (a, b) not in cost:  # the cheapest of repeated pairs comes first
            out_of[a].append(b)
            cost[a, b] = c
    height, wife, husband = defaultdict(float), {}, {}
    while True:
        # Distances from all free a's at once; heights keep all lengths at or above 0.
        far = {("a", a): 0.0 for a in out_of if a not in wife}
        heap, came = [(0.0, *n) for n in far], {}
        heapq.heapify(heap)
        while heap:
            d, side, v = heapq.heappop(heap)
            if d > far[side, v]:
                continue
            if side == "b":
                steps = [("a", husband[v], -cost[husband[v], v])] if v in husband else []
            else:
                steps = [("b", b, cost[v, b]) for b in out_of[v] if wife.get(v) != b]
            for to, w, c in steps:
                e = d + max(c + height[side, v] - height[to, w], 0.0)
                if e < far.get((to, w), float("inf")) - 1e-12:
                    far[to, w] = e
                    came[to, w] = v
                    heapq.heappush(heap, (e, to, w))
        for n, d in far.items():
            height[n] += d
        ends = [(height["b", b], b) for side, b in far if side == "b" and b not in husband]
        if not ends:
            return sorted((a, b, cost[a, b]) for a, b in wife.items())
        b = min(ends)[1]
        while True:
            a = came["b", b]
            before = wife.get(a)
            wife[a], husband[b] = b, a
            if before is None:
                break
            b = before


def auction(pairs: DataFrame, alone: float, step: float) -> DataFrame:
    """(a, b, cost) of the matching that makes costs plus alone for every a and b without a partner least, to within step for each of them.

    Every a and b has a dummy of its own to go to, so that prices of all objects start alike; bidders without an object bid at once, the
    highest bid takes it, until all have one.
    """
    # Bidders: a as 2a, the dummy of b as 2b + 1; objects: b as 2b + 1, the dummy of a as 2a.
    edges = [
        pairs.select((2 * F.col("a")).alias("p"), (2 * F.col("b") + 1).alias("o"), (-F.col("cost")).alias("v")),
        pairs.select((2 * F.col("b") + 1).alias("p"), (2 * F.col("a")).alias("o"), F.lit(0.0).alias("v")),
        *(pairs.select(n.alias("p"), n.alias("o"), F.lit(-alone).alias("v")).distinct() for n in (2 * F.col("a"), 2 * F.col("b") + 1)),
    ]
    e = cut(edges[0].unionByName(edges[1]).unionByName(edges[2]).unionByName(edges[3]), "offers")
    held = cut(e.select("o", F.lit(0.0).alias("price"), F.lit(None).cast("long").alias("p")).distinct(), "prices")
    best = Window.partitionBy("p").orderBy(F.desc("net"), "o")
    while True:
        open_ = e.join(held.where("p is not null").select("p"), "p", "left_anti")
        n = open_.join(held.select("o", "price"), "o").withColumn("net", F.col("v") - F.col("price")).withColumn("r", F.row_number().over(best)).where("r <= 2")
        top = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
        bids = n.groupBy("p").agg(top("o", 1).alias("o"), (top("price", 1) + top("net", 1) - F.coalesce(top("net", 2), top("net", 1)) + step).alias("bid"))
        won = cut(bids.groupBy("o").agg(F.max("bid").alias("bid"), F.max_by("p", F.struct("bid", -F.col("p"))).alias("winner")), "bids")
        if won.isEmpty():
            break
        held = cut(held.join(won, "o", "left").select("o", F.coalesce("bid", "price").alias("price"), F.coalesce("winner", "p").alias("p")), "prices")
    ours = held.where("o % 2 <> 0 and p % 2 = 0").select(F.expr("p div 2").alias("a"), F.expr("(o - 1) div 2").alias("b"))
    return ours.join(pairs, ["a", "b"]).select("a", "b", "cost")


def match(pairs: DataFrame, most: int = MOST, alone: float | None = None, step: float | None = None) -> DataFrame:
    """(a, b, cost): the matching of most pairs and least cost of pairs (a, b, cost); a and b are whole numbers, costs not below 0.

    Components of more than ``most`` pairs go through the auction: what it makes least is the cost plus ``alone`` (default: the largest cost)
    for every one left over, to within ``step`` (default: a hundredth of that) for each.  Rows with a null take no part.
    """
    pairs = cut(pairs.dropna().groupBy("a", "b").agg(F.min(F.col("cost").cast("double")).alias("cost")), "candidates")
    if pairs.isEmpty():
        return pairs
    named = components(pairs.select((2 * F.col("a")).alias("a"), (2 * F.col("b") + 1).alias("b")))
    pairs = pairs.join(named, 2 * F.col("a") == F.col("node")).select("a", "b", "cost", "component")
    sizes = pairs.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    pairs = cut(pairs.join(sizes, "component"), "components")
    lone = pairs.where("n = 1").select("a", "b", "cost")

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by component; the last one of a batch may go on in the next."""
        held, now = [], None
        for p in parts:
            rows = []
            for c, a, b, cost in zip(*(p[n].tolist() for n in ("component", "a", "b", "cost")), strict=True):
                if c != now:
                    rows += best_matching(held)
                    held, now = [], c
                held.append((a, b, cost))
            yield pd.DataFrame(rows, columns=["a", "b", "cost"])
        yield pd.DataFrame(best_matching(held), columns=["a", "b", "cost"])

    schema = "a bigint, b bigint, cost double"
    some = pairs.where((F.col("n") > 1) & (F.col("n") <= most)).repartition("component").sortWithinPartitions("component")
    out = lone.unionByName(some.select("component", F.col("a").cast("long"), F.col("b").cast("long"), "cost").mapInPandas(solve, schema))
    large = pairs.where(F.col("n") > most)
    if not large.isEmpty():
        alone = alone if alone is not None else large.agg(F.max("cost")).first()[0]
        out = out.unionByName(auction(large.select("a", "b", "cost"), alone, step if step is not None else alone / 100))
    return out
