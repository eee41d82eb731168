"""Loops and draws: mixtures, reassignment, clusters, proposals, samples.  A loop keeps a few numbers on the driver, or cuts its lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspan.operators import spatial, suppression
from cellspan.operators.staging import cut


def mixture(values: DataFrame, value: str, rounds: int = 10) -> list[tuple[float, float, float]]:
    """(share, centre, scale) of three Gaussians fitted by expectation-maximisation, in order of centres; one aggregate a round."""
    # Shares, centres and scales to begin with; least count of a part, least variance.
    parts = [(0.5, 0.4, 0.4), (0.3, 1.5, 1.0), (0.2, 4.0, 2.5)]
    for _ in range(rounds):
        r, x = responsibilities(F.col(value), parts), F.col(value)
        s = values.agg(*(F.sum(r[k] * x**p).alias(f"s{k}{p}") for k in range(3) for p in range(3))).first()
        n = [max(s[f"s{k}0"] or 0.0, 1.0) for k in range(3)]
        means = [(s[f"s{k}1"] or 0.0) / n[k] for k in range(3)]
        scales = [max(((s[f"s{k}2"] or 0.0) - 2 * m * (s[f"s{k}1"] or 0.0) + m * m * (s[f"s{k}0"] or 0.0)) / n[k], 1e-6) ** 0.5 for k, m in enumerate(means)]
        parts = sorted(((n[k] / sum(n), means[k], scales[k]) for k in range(3)), key=lambda p: p[1])
    return parts


def responsibilities(x: Column, parts: list[tuple[float, float, float]]) -> list[Column]:
    """P(part | x), by log-densities less their greatest."""
    logs = [F.lit(-0.5) * ((x - m) / s) ** 2 - F.ln(F.lit(s)) + F.ln(F.lit(max(w, 1e-12))) for w, m, s in parts]
    top = F.greatest(*logs)
    e = [F.exp(v - top) for v in logs]
    return [v / (e[0] + e[1] + e[2]) for v in e]


def compartment_posterior(molecules: DataFrame, parts: list[tuple[float, float, float]], concentration: float = 50.0, least: int = 20) -> DataFrame:
    """Shares of the nucleus and the three parts for each (feature_name, cell_type) of at least ``least`` molecules, shrunk to those of all."""
    inside = F.col("overlaps_nucleus") == 1
    soft = [F.when(inside, 1.0).otherwise(0.0), *(F.when(inside, 0.0).otherwise(r) for r in responsibilities(F.col("nucleus_distance"), parts))]
    overall = molecules.agg(F.avg(F.col("overlaps_nucleus").cast("double")).alias("nuclear"))
    sums = molecules.groupBy("feature_name", "cell_type").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{k}") for k, c in enumerate(soft))).where(F.col("n") >= least)
    base = [F.col("nuclear"), *((1 - F.col("nuclear")) * w for w, _, _ in parts)]
    return sums.crossJoin(F.broadcast(overall)).select("feature_name", "cell_type", "n", *(((concentration * base[k] + F.col(f"s{k}")) / (concentration + F.col("n"))).alias(f"p{k}") for k in range(4)))  # one row


def reassign(molecules: DataFrame, candidates: DataFrame, bonus: float, rounds: int = 4) -> DataFrame:
    """(mol, cell) after hard reassignment: of its candidates (mol, cell, own), a molecule takes that with the largest share of its factor.

    Own cells have their share times bonus; ties go to the smaller cell.  Shares are taken anew after each round.
    """
    now = molecules.select("mol", "factor", "cell")
    for k in range(rounds):
        n = now.groupBy("cell", "factor").agg(F.count(F.lit(1)).alias("n"))
        share = n.select("cell", "factor", (F.col("n") / F.sum("n").over(Window.partitionBy("cell"))).alias("h"))
        c = candidates.join(now.select("mol", "factor"), "mol").join(share, ["cell", "factor"], "left")
        score = F.coalesce("h", F.lit(1e-6)) * F.when(F.col("own"), bonus).otherwise(1.0)
        best = c.groupBy("mol", "factor").agg(F.max_by("cell", F.struct(F.round(score, 12), -F.col("cell"))).alias("cell"))
        now = best if k == rounds - 1 else cut(best, "reassigned")
    return now


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): the smallest reachable number; labels jump to the label of their label."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        new = cut(new.join(up, "low", "left").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") != F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


def dbscan(points: DataFrame, eps: float, least: int, key: str, x: str, y: str) -> DataFrame:
    """(key, cluster): points with at least ``least`` neighbours (themselves among them) are cores; clusters are the cores' components.

    Border points join the smallest cluster that reaches them; a cluster is named by its smallest core.
    """
    edges = cut(spatial.radius_join(points, points, eps, key, x, y).select("src", "dst"), "near")
    cores = cut(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= least).select("src"), "cores")
    inner = edges.join(cores, "src", "left_semi").join(cores.select(F.col("src").alias("dst")), "dst", "left_semi")
    named = components(inner.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    core = cores.join(named, cores["src"] == named["node"], "left").select("src", F.coalesce("component", "src").alias("cluster"))
    border = edges.join(cores, "src", "left_anti").join(core.select(F.col("src").alias("dst"), "cluster"), "dst").groupBy("src").agg(F.min("cluster").alias("cluster"))
    return core.unionByName(border).withColumnRenamed("src", key)


def propose(points: DataFrame, clusters: DataFrame, least: int) -> DataFrame:
    """(cluster, n, cx, cy, radius, factor) of clusters of at least ``least`` points: centre, spread, modal factor (ties to the smaller)."""
    p = points.join(clusters, "mol")
    f = p.groupBy("cluster", "factor").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("factor", F.struct("n", -F.col("factor"))).alias("factor"))
    c = p.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("radius")).where(F.col("n") >= least)
    return c.join(f, "cluster")


def uniform(key: Column, stream: int) -> Column:
    """A number in [0, 1) that depends on the key and the stream alone."""
    return F.pmod(key * 7919 + stream * 104729, F.lit(10007)) / 10007


def relax_types(edges: DataFrame, start: DataFrame, affinity: DataFrame, weight: float, rounds: int) -> DataFrame:
    """(node, type) after rounds in which every node takes the type with the largest sum of ln affinity to its neighbours' types.

    A parallel form of Gibbs sweeps at temperature 0: its own type counts weight; ties go to the first type.  affinity
    (type_a, type_b, p) has a row for each pair of types.
    """
    a = F.broadcast(affinity.select(F.col("type_a").alias("new"), F.col("type_b").alias("near"), F.ln(F.greatest("p", F.lit(1e-6))).alias("l")))  # types squared rows
    now = start
    for k in range(rounds):
        e = edges.join(now.select(F.col("node").alias("dst"), F.col("type").alias("near")), "dst").join(a, "near").groupBy(F.col("src").alias("node"), "new").agg(F.sum("l").alias("l"))
        s = e.join(now, "node").withColumn("l", F.round(F.col("l") + F.when(F.col("new") == F.col("type"), weight).otherwise(0.0), 9))
        best = s.groupBy("node").agg(F.min_by("new", F.struct(-F.col("l"), "new")).alias("type"))
        kept = now.join(best.select("node"), "node", "left_anti").unionByName(best)
        now = kept if k == rounds - 1 else cut(kept, "types")
    return now


def smooth_angles(edges: DataFrame, start: DataFrame, kappa: float, angles: int = 36, rounds: int = 3) -> DataFrame:
    """(node, angle) after rounds in which all nodes take, of evenly spaced angles, that which agrees best with their neighbours' axes and their own anchor."""
    step = 3.141592653589793 / angles
    now = start.select("node", "angle", F.col("angle").alias("anchor"))
    for k in range(rounds):
        e = edges.join(now.select(F.col("node").alias("dst"), F.col("angle").alias("near")), "dst").groupBy(F.col("src").alias("node")).agg(F.collect_list("near").alias("near"))
        j = now.join(e, "node", "left").withColumn("near", F.coalesce("near", F.array().cast("array<double>")))
        score = lambda i: F.round(F.aggregate("near", F.abs(F.cos(i * step - F.col("anchor"))), lambda s, v: s + kappa * F.abs(F.cos(i * step - v))), 9)
        best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(angles - 1)), lambda i: F.struct(score(i).alias("s"), (-i).alias("i"))))
        done = j.select("node", (-best["i"] * step).alias("angle"), "anchor")
        now = done if k == rounds - 1 else cut(done, "angles")
    return now.select("node", "angle")


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """(a, b, d) by rising d (ties to smaller ids), each a and b once, until none is left."""
    return suppression.nearest_pairs(pairs)


def thin(points: DataFrame, distance: float, key: str, x: str, y: str) -> DataFrame:
    """Points of the greedy order by key, none within distance of an earlier kept one."""
    return suppression.suppress(points, distance, [], key, x, y, closed=True)


def nearest_vectors(queries: DataFrame, bank: DataFrame, k: int, side: int = 8192) -> DataFrame:
    """(q, b, cos, rank): the k of bank (b, v) with the largest cosine for each query (q, v), other ids only, ties to the smaller.

    Both sides are dealt into blocks of some ``side`` rows; every block of queries meets every block of the bank in a task of its own, which
    hands on k rows a query.  Neither side passes the driver.
    """
    import numpy as np
    import pandas as pd

    queries, bank = (cut(d, "vectors") for d in (queries.select("q", F.col("v").cast("array<double>").alias("v")), bank.select("b", F.col("v").cast("array<double>").alias("v"))))
    blocks = [max(1, -(-d.count() // side)) for d in (queries, bank)]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("i", F.pmod(F.xxhash64("q"), F.lit(blocks[0])).cast("int")).withColumn("j", every(blocks[1]))
    right = bank.withColumn("j", F.pmod(F.xxhash64("b"), F.lit(blocks[1])).cast("int")).withColumn("i", every(blocks[0]))
    unit = lambda p: (m := np.stack(p["v"].to_list()).astype(float)) / np.maximum(np.linalg.norm(m, axis=1), 1e-12)[:, None]

    def search(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": [], "b": [], "cos": []}).astype({"q": "int64", "b": "int64", "cos": "float64"})]
        if len(qs) and len(bs):
            bs = bs.sort_values("b")
            ids, m, x = bs["b"].to_numpy(), unit(bs), unit(qs)
            for at in range(0, len(qs), 256):
                own = qs["q"].to_numpy()[at : at + 256]
                s = x[at : at + 256] @ m.T
                s[(own[:, None] == ids[None]) | np.isnan(s)] = -3
                # Rounding moves a cosine by 5e-10 at most: what is 1e-9 below the k-th is out, and the few others are sorted.
                least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -2.0)
                row, col = np.nonzero(s >= np.maximum(least - 2e-9, -2)[:, None])
                c = np.round(s[row, col], 9)
                order = np.lexsort((col, -c, row))
                first = np.searchsorted(row, np.arange(len(s)))
                order = order[np.arange(len(order)) - first[row] < k]
                out.append(pd.DataFrame({"q": own[row[order]], "b": ids[col[order]], "cos": c[order]}))
        return pd.concat(out)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(search, "q bigint, b bigint, cos double")
    best = Window.partitionBy("q").orderBy(F.desc("cos"), "b")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
