"""Queries that go over the molecules once, and joins that do not multiply equal rows."""

import math
from collections import Counter

import pytest

from cellspan.operators import cells, spatial
from cellspan.plans import analysis, catalog, rules, tables
from cellspan.sources.views import view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("module", "query"), [(analysis, "f1_calibration"), (tables, "compartment_lookup")])
def test_molecules_once(spark, monkeypatch, module, query):
    """The plan that is returned holds no scan of lineitem: what it reads was staged by one pass over the molecules."""
    seen = []
    monkeypatch.setattr(module, "view", lambda s, d, name: seen.append(name) or view(s, d, name))
    out = catalog.queries()[query](spark, SF)
    assert seen.count("v_molecules") == 1
    assert "lineitem" not in out._jdf.queryExecution().executedPlan().toString() and not out.isEmpty()


def nodes(plan):
    """The nodes of a plan that has run."""
    yield plan
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def test_equal_regions_meet_once(spark):
    crops = spark.createDataFrame([(f"c{i}", i - 1.0, i + 1.0, -1.0, 1.0, "train") for i in range(200)], "crop_id string, xmin double, xmax double, ymin double, ymax double, split string")
    boxes = [(20.0, 29.0, -4.0, 4.0, "val"), (25.0, 34.0, -4.0, 4.0, "test")]
    regions = spark.createDataFrame(boxes * 300, "xmin double, xmax double, ymin double, ymax double, region_split string")
    for most in (10, 10_000):
        out = cells.override_splits(crops, regions, most=most)
        got = {r.crop_id: r.split for r in out.collect()}
        assert got == {f"c{i}": "test" if 25 <= i <= 34 else "val" if 20 <= i < 25 else "train" for i in range(200)}
        joins = [n for n in nodes(out._jdf.queryExecution().executedPlan()) if "Join" in n.nodeName()]
        assert joins and max(n.metrics().apply("numOutputRows").value() for n in joins) <= 200


@pytest.mark.parametrize("what", ["molecules", "radius"])
def test_large_sides_are_not_sorted(spark, what):
    """Molecules meet their orders, and points the bins around them, by hashing the smaller side: no sort, no broadcast of a table."""
    points = spark.range(100).selectExpr("id AS cell_idx", "id * 1D AS centroid_x", "0D AS centroid_y")
    df = view(spark, SF, "v_molecules") if what == "molecules" else spatial.radius_join(points, points, 2.0)
    names = {n.nodeName() for n in nodes(df._jdf.queryExecution().executedPlan())}
    assert "ShuffledHashJoin" in names and not names & {"Sort", "SortMergeJoin", "BroadcastHashJoin"}


def test_cells_of_tiles_are_not_repeated(spark, monkeypatch):
    """Far more cells than tiles, piles, cells on the edges of tiles and nowhere: only the tiles are repeated over their squares."""
    boxes = [("a", -13.7, 66.3, 9.999999999999998, 84.0), ("b", 0.0, 80.0, -10.0, 70.0), ("c", 0.0, 80.0, -10.0, 70.0), ("d", 5.0, 9.0, 5.0, 9.0)]
    odd = [(x, y) for x in (-13.7, 6.3, 20.0, 66.3, 80.0, None, math.nan, 1e9) for y in (9.999999999999998, 29.999999999999996, 30.0, -10.0, 70.0)]
    many = spark.range(6000).selectExpr("(id * 37 % 1009) / 8D - 20 AS centroid_x", "(id * 53 % 997) / 8D - 20 AS centroid_y")
    points = many.unionAll(spark.createDataFrame(odd * 9, many.schema))
    crops = spark.createDataFrame(boxes, "crop_id string, xmin double, xmax double, ymin double, ymax double")
    tiles = {
        (crop, ty * nx + tx): (xmin + tx * 20, ymin + ty * 20)
        for crop, xmin, xmax, ymin, ymax in boxes for nx, ny in [[max(1, math.ceil((b - a - 20) / 20) + 1) for a, b in ((xmin, xmax), (ymin, ymax))]] for tx in range(nx) for ty in range(ny)
    }
    at = [(r.centroid_x, r.centroid_y) for r in points.collect() if r.centroid_x is not None]
    want = Counter(t for t, (u, v) in tiles.items() for x, y in at if u <= x < u + 20 and v <= y < v + 20)
    for rows in (points, many):  # of the first, Spark does not know the size; the second it takes for small
        monkeypatch.setattr(rules, "view", lambda s, d, name, rows=rows: {"v_cells": rows, "v_crops": crops}[name])
        out = rules.ALL["tile_grid_function"][0](spark, "")
        got = {(r.crop_id, r.tile_idx): r.n for r in out.collect()}
        assert got == dict(want) if rows is points else 0 < sum(got.values()) < sum(want.values())
        ran = list(nodes(out._jdf.queryExecution().executedPlan()))
        made = {k: [n.metrics().apply("numOutputRows").value() for n in ran if n.nodeName() == k] for k in ("Generate", "BroadcastExchange")}
        assert made["Generate"] and max(made["Generate"]) <= len(tiles) * 16 and max(made["BroadcastExchange"], default=0) <= len(tiles)
