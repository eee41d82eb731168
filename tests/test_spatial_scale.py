"""Nearest neighbours and quantiles on skewed data against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspan.operators import nearest, quantiles


def brute_nearest(left, right, k, far=None):
    """left, right: (crop, key, x, y)."""
    out = {}
    for crop, key, x, y in left:
        own = sorted(((px - x) ** 2 + (py - y) ** 2, p) for c, p, px, py in right if c == crop and p != key)
        own = [o for o in own if far is None or o[0] <= far * far]
        out.update({(key, r): p for r, (_, p) in enumerate(own[:k], 1)})
    return out


def found(df):
    return {(r.src, r["rank"]): r.dst for r in df.collect()}


@pytest.mark.parametrize("k", [1, 5])
def test_nearest_of_skewed_points(spark, k):
    """A dense clump, a pile of equal points, a line, lone points far off, two crops."""
    rng = random.Random(k)
    points = [(0, 100.0 + rng.gauss(0, 0.5), 100.0 + rng.gauss(0, 0.5)) for _ in range(400)] + [(0, 7.0, 7.0)] * 40
    points += [(0, float(i), 0.0) for i in range(60)] + [(0, rng.uniform(0, 2e3), rng.uniform(0, 2e3)) for _ in range(40)] + [(0, -5e3, 5.0)]
    points += [(1, rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(30)] + [(2, 1.0, 1.0), (3, 1.0, 2.0), (3, 1.0, 2.0)]
    rows = [(c, i, x, y) for i, (c, x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "crop int, cell_idx bigint, centroid_x double, centroid_y double")
    odd = spark.createDataFrame([(None, 9001, 1.0, 1.0), (0, None, 1.0, 1.0), (0, 9002, None, 1.0)], df.schema)
    assert found(nearest.nearest(df.unionByName(odd), df.unionByName(odd), k, within=["crop"], most=50)) == brute_nearest(rows, rows, k)
    some = [r for r in rows if r[1] % 3 == 0]
    near = nearest.nearest(df, df.where("cell_idx % 3 = 0"), k, within=["crop"], far=30.0)
    assert found(near) == brute_nearest(rows, some, k, 30.0)
    assert nearest.nearest(df.limit(0), df, k).count() == 0 and nearest.nearest(df, df.limit(0), k).count() == 0


def test_no_task_holds_a_dense_bin(spark):
    """9000 points in one small square: the pairs of the first round stay in proportion to the points."""
    rng = random.Random(3)
    rows = [(i, rng.random() * 0.01, rng.random() * 0.01) for i in range(4500)] + [(9000 + i, rng.random() * 1e5, rng.random() * 1e5) for i in range(50)]
    df = spark.createDataFrame(rows, "key bigint, x double, y double")
    extent = 1.5e5
    open_ = nearest.own_levels(df.withColumnRenamed("key", "src"), df, [], 4, (0.0, 0.0), extent)
    assert open_.count() == len(rows)
    levels = [r.level for r in open_.select("level").distinct().collect()]
    assert nearest.meet(open_, df, [], levels, (0.0, 0.0), extent, 64).count() < 200 * len(rows)


QS = [0.0, 0.01, 0.1, 0.37, 0.5, 0.9, 0.998, 1.0]


@pytest.mark.parametrize("accuracy", [2000, 50])
def test_quantiles(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(accuracy)
    groups = {
        "normal": rng.normal(size=5000), "skewed": np.exp(rng.normal(0, 20, 4000)), "few": np.round(rng.normal(size=3000)), "same": np.full(1000, 3.5),
        "one": np.array([2.0]), "two": np.array([1.0, 4.0]), "mostly": np.concatenate([np.zeros(3000), rng.random(100)]), None: rng.random(700),
    }
    rows = [(g, float(v), float(-v) if i % 3 else None) for g, own in groups.items() for i, v in enumerate(own)] + [("empty", None, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(7)
    got = {(r.g, r["name"], r.q): (r.n, r.value) for r in quantiles.quantile_table(df, ["g"], {"a": F.col("a"), "b": F.col("b")}, QS).collect()}
    want = {}
    for g, own in groups.items():
        other = -own[np.arange(len(own)) % 3 > 0]
        for name, v in (("a", own), ("b", other)):
            if len(v):
                want.update({(g, name, q): (len(v), float(np.quantile(v, q))) for q in QS})
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-9, abs=1e-12) for k in want)
    wide = {r.g: r for r in quantiles.wide_quantiles(df, ["g"], {"a": F.col("a")}, {"p50": 0.5}).collect()}
    assert wide["two"].a_p50 == 2.5 and wide["two"].a_n == 2 and "empty" not in wide
    assert quantiles.quantile_table(df.limit(0), ["g"], {"a": F.col("a")}, [0.5]).count() == 0
    whole = quantiles.quantile_table(df, [], {"a": F.col("a")}, [0.25]).first()
    assert whole.value == pytest.approx(float(np.quantile(np.concatenate(list(groups.values())), 0.25)))
