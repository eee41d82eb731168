"""Random fields over a graph of neighbours: types by Gibbs sampling, tilts by sweeps over their axes.

Random numbers are counted, not drawn in turn: each depends on the node, the sweep and the seed alone, so that a result is the same
however rows lie in partitions and however often a task runs.  Sums run in a fixed order for the same reason.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspan.operators.ranks import places
from cellspan.operators.staging import cut

#: Types of a field at most; their matrix is part of the plan.
MOST_TYPES = 128


def drawn(*key: Column) -> Column:
    """A number in [0, 1) from the 53 upper bits of the key's hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / float(1 << 53)


def pick(weights: Column, u: Column, total: Column) -> Column:
    """The first place (from 0) of an array at which the running sum exceeds u times the total of all."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("hit"))

    def step(a: Column, w: Column) -> Column:
        upto = a["sum"] + w
        return F.struct(upto.alias("sum"), (a["i"] + 1).alias("i"), F.when((a["hit"] < 0) & (upto > u * total), a["i"]).otherwise(a["hit"]).alias("hit"))

    return F.aggregate(weights, start, step, lambda a: F.when(a["hit"] < 0, a["i"] - 1).otherwise(a["hit"]))


def drawn_place(df: DataFrame, scores: Column, u: Column, name: str) -> DataFrame:
    """df with ``name``: a place (from 0) in the scores, drawn with weights exp(score).  Each step is a column of its own, so that none is taken twice."""
    df = df.withColumn("_s", scores).withColumn("_m", F.array_max("_s")).withColumn("_w", F.transform("_s", lambda s: F.exp(s - F.col("_m"))))
    df = df.withColumn("_t", F.aggregate("_w", F.lit(0.0), lambda a, w: a + w))
    return df.withColumn(name, pick(F.col("_w"), u, F.col("_t"))).drop("_s", "_m", "_w", "_t")


def colours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, colour) such that no edge (src, dst) joins two of one colour: in rounds, each node that comes before all its uncoloured neighbours
    in a hashed order takes the smallest colour that none of the coloured ones has.  Rounds are as many as the logarithm of the nodes."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    first = lambda n: F.struct(F.xxhash64(n), F.col(n))
    both = cut(both.withColumn("before", first("dst") < first("src")), "colour-edges")
    open_, done = cut(nodes.select("node").distinct(), "colour-open"), None
    while not open_.isEmpty():
        waits = both.where("before").join(open_.withColumnRenamed("node", "dst").hint("shuffle_hash"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        now = open_.join(waits.hint("shuffle_hash"), "node", "left_anti")
        if done is None:
            new = now.withColumn("colour", F.lit(0))
        else:
            near = both.join(done.select(F.col("node").alias("dst"), "colour").hint("shuffle_hash"), "dst").groupBy(F.col("src").alias("node")).agg(F.collect_set("colour").alias("used"))
            used = F.coalesce("used", F.array().cast("array<int>"))
            new = now.join(near.hint("shuffle_hash"), "node", "left").select("node", F.array_min(F.array_except(F.sequence(F.lit(0), F.size(used)), used)).alias("colour"))
        new = cut(new, "coloured")
        done = new if done is None else cut(done.unionByName(new), "coloured")
        open_ = cut(open_.join(new.select("node").hint("shuffle_hash"), "node", "left_anti"), "colour-open")
    return done if done is not None else nodes.select("node", F.lit(0).alias("colour")).limit(0)


def gibbs_types(
    nodes: DataFrame, edges: DataFrame, prior: dict[str, float], conditional: dict[tuple[str, str], float], sweeps: int = 5, seed: int = 11, weight: float = 1.0,
    rebalance: bool = True,
) -> DataFrame:
    """(node, type) sampled from prior(t) ** weight times, over a node's neighbours (edges src, dst), conditional(t, their type).

    It starts from draws by the prior.  In a sweep the colours of the graph go one after the other: nodes of one colour don't see each other, so they
    are drawn at once.  What a table lacks is 1e-6.  rebalance: afterwards rebalanced() to the prior.
    """
    names = sorted(prior)
    if len(names) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} types")
    whole = sum(prior.values())
    share = [prior[t] / whole for t in names]
    node = F.col("node")
    at = lambda sweep: drawn(node, F.lit(seed).cast("long"), F.lit(sweep).cast("long"))
    start = pick(F.array(*map(F.lit, share)), at(0), F.lit(sum(share)))
    if not names:
        return nodes.select("node", F.lit(None).cast("string").alias("type"))
    coloured = colours(edges, nodes)
    kinds = sorted(r[0] for r in coloured.select("colour").distinct().collect())  # degrees plus one at most
    edges = cut(edges.select("src", "dst").join(coloured.select(F.col("node").alias("src"), "colour").hint("shuffle_hash"), "src"), "gibbs-edges")
    now = cut(coloured.withColumn("t", start), "types")
    logs = [math.log(max(s, 1e-6)) for s in share]
    cond = [[math.log(max(conditional.get((a, b), 0.0), 1e-6)) for b in names] for a in names]
    for sweep in range(1, sweeps + 1):
        for colour in kinds:
            # Hashed, not broadcast: what each sweep and colour sends to the driver would add up.
            near = edges.where(F.col("colour") == colour).join(now.select(F.col("node").alias("dst"), "t").hint("shuffle_hash"), "dst").groupBy(F.col("src").alias("node"))
            counts = near.agg(*(F.count_if(F.col("t") == i).alias(f"n{i}") for i in range(len(names))))

            def score(a: int) -> Column:
                s = F.lit(weight * logs[a])
                for i, c in enumerate(cond[a]):
                    s = s + F.coalesce(f"n{i}", F.lit(0)) * F.lit(c)
                return s

            own = now.where(F.col("colour") == colour).drop("t").join(counts.hint("shuffle_hash"), "node", "left")
            own = drawn_place(own, F.array(*(score(a) for a in range(len(names)))), at(sweep), "t").select("node", "colour", "t")
            now = cut(own.unionByName(now.where(F.col("colour") != colour)), "types")
    named = now.select("node", F.element_at(F.array(*map(F.lit, names)), F.col("t") + 1).alias("type"))
    return rebalanced(named, dict(zip(names, share, strict=True)), seed) if rebalance else named


def rebalanced(types: DataFrame, share: dict[str, float], seed: int) -> DataFrame:
    """types (node, type) with the surplus of a type, drawn at random, given to those that are short, in proportion to what they lack."""
    counts = {r["type"]: r["n"] for r in types.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}  # types rows
    n = sum(counts.values())
    gap = {t: counts.get(t, 0) - share[t] * n for t in sorted(share)}
    short = [(t, -g) for t, g in gap.items() if g < 0]
    surplus = {t: round(g) for t, g in gap.items() if g > 0 and round(g) > 0}
    if not short or not surplus:
        return types
    rows = places(types.withColumn("u", drawn(F.col("node"), F.lit(seed).cast("long"), F.lit(-1).cast("long"))), "type", ["u", "node"])
    take = F.coalesce(*(F.when(F.col("type") == t, F.lit(k)) for t, k in surplus.items()), F.lit(0))
    to = F.element_at(F.array(*(F.lit(t) for t, _ in short)), pick(F.array(*(F.lit(g) for _, g in short)), drawn(F.col("node"), F.lit(seed).cast("long"), F.lit(-2).cast("long")), F.lit(sum(g for _, g in short))) + 1)
    return rows.select("node", F.when(F.col("place") < take, to).otherwise(F.col("type")).alias("type"))


def sample_tilts(
    edges: DataFrame, start: DataFrame, kappa: float = 2.0, anchor_weight: float = 1.0, sweeps: int = 30, seed: int = 0, angles: int = 36
) -> DataFrame:
    """(node, angle) after sweeps in which every node draws one of evenly spaced angles of [0, pi), likelier where it lies along its neighbours' axes and its own.

    start (node, angle, ratio): the angle is also the node's anchor, which counts anchor_weight * (ratio - 1), 0 at least; the energy of an axis is
    -|cos| of the angle between, kappa for each neighbour.  All nodes move at once, by the angles of the sweep before.
    """
    grid = [math.pi * i / angles for i in range(angles)]
    now = start.select("node", "angle", F.col("angle").alias("anchor"), F.greatest(F.lit(0.0), F.col("ratio") - 1).alias("pull"))
    candidates = F.array(*map(F.lit, grid))
    for sweep in range(1, sweeps + 1):
        e = edges.join(now.select(F.col("node").alias("dst"), F.col("angle").alias("near")), "dst").groupBy(F.col("src").alias("node"))
        e = e.agg(F.sort_array(F.collect_list(F.struct("dst", "near"))).alias("near"))
        j = now.join(e, "node", "left")
        near = F.coalesce(F.col("near.near"), F.array().cast("array<double>"))
        fit = lambda c: F.aggregate(near, F.abs(F.cos(c - F.col("anchor"))) * F.col("pull") * anchor_weight, lambda s, v: s + kappa * F.abs(F.cos(c - v)))  # noqa: B023, E731
        j = drawn_place(j, F.transform(candidates, fit), drawn(F.col("node"), F.lit(seed).cast("long"), F.lit(sweep).cast("long")), "at")
        j = j.withColumn("angle", F.element_at(candidates, F.col("at") + 1)).select("node", "angle", "anchor", "pull")
        now = cut(j, "tilts")
    return now.select("node", "angle")
