"""Queries on cells of large numbers: the tables of sf0.001 with keys far apart."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cellspan.operators import nearest
from cellspan.plans import loops
from cellspan.sources.views import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def far_apart(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("far")
    for table in ("customer", "orders", "lineitem", "part"):
        rows = spark.read.parquet(f"{SF}/{table}.parquet")
        for key in ("c_custkey", "o_custkey"):
            if key in rows.columns:
                rows = rows.withColumn(key, F.col(key) + F.col(key) % 7 * 1_000_000)
        rows.write.parquet(str(Path(folder) / f"{table}.parquet"))
    return str(folder)


def test_ghosts_in_the_order_of_their_hash(spark, far_apart):
    """The cell's number breaks ties of the hash only, however large it is."""
    number = {r.cell_id: r.cell_idx for r in view(spark, far_apart, "v_cells").select("cell_id", "cell_idx").collect()}
    n = Counter(number[r.cell_id] for r in view(spark, far_apart, "v_molecules").where("cell_id <> 'UNASSIGNED'").select("cell_id").collect())
    want, upto = {}, 0
    for cell in sorted(n, key=lambda c: ((c * 7919 + 5 * 104729) % 10007, c)):
        upto += n[cell]
        if upto <= sum(n.values()) * 0.6:
            want[cell] = n[cell]
    assert {r.cell_idx: r.n for r in loops.ALL["drop_ghosts_to_target"][0](spark, far_apart).collect()} == want and want


def test_neighbours_in_crops_without_all_pairs(spark, monkeypatch):
    """A crop of 400 cells at one place: no cell meets more than the first few of them."""
    met, meet = [], nearest.meet
    monkeypatch.setattr(nearest, "meet", lambda *a: met.append(p := meet(*a).cache()) or p)
    rows = [(i, 5.0, 5.0) for i in range(400)] + [(400 + i, 50.0 + i, 50.0) for i in range(20)]
    cells = spark.createDataFrame(rows, "cell_idx long, centroid_x double, centroid_y double")
    monkeypatch.setattr(loops, "view", lambda *a: cells)
    got = {(r.src, r["rank"]): r.dst for r in loops._in_crop(spark, "").collect()}
    want = {}
    for i, x, y in rows:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in rows if j != i and (x - u) ** 2 + (y - v) ** 2 <= 1600)
        want |= {(i, k): j for k, (_, j) in enumerate(near[:8], 1)}
    assert got == want and 0 < sum(p.count() for p in met) <= 420 * 20
