"""Moves of molecules, planted gaps and faults, and splits against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cellspan.operators import context, reassignment
from cellspan.plans import catalog


def test_moves_equal_rounds_taken_one_by_one(spark):
    rng = random.Random(5)
    cells = [(i, rng.uniform(0, 40), rng.uniform(0, 40)) for i in range(60)]
    mols = [(i, rng.randrange(60), rng.randrange(1, 4)) for i in range(300)]
    mols = [(i, c, f, cells[c][1] + rng.gauss(0, 4), cells[c][2] + rng.gauss(0, 4)) for i, c, f in mols]
    share = {(c, f): rng.choice([0.0, 0.1, 0.3, 0.6]) for c in range(60) for f in (1, 2)}
    m = spark.createDataFrame(mols, "mol long, cell long, factor int, x double, y double")
    near = reassignment.candidates(m, spark.createDataFrame(cells, "cell long, x double, y double"), 8.0, 4)
    want = {}
    for i, c, _, x, y in mols:
        d = sorted(((cx - x) ** 2 + (cy - y) ** 2, k) for k, cx, cy in cells if k != c)
        want[i] = {c} | {k for q, k in d[:3] if q <= 64}
    got = {}
    for r in near.collect():
        assert r["cell"] not in got.setdefault(r["mol"], set())
        got[r["mol"]].add(r["cell"])
    assert got == want and any(len(v) == 4 for v in want.values())
    moves = reassignment.reassigned(m, near, spark.createDataFrame([(c, f, v) for (c, f), v in share.items() if v], "cell long, factor int, share double"))
    now, logs, moved = {i: c for i, c, *_ in mols}, [], []
    for _ in range(3):
        log, n = 0.0, 0
        for i, c, f, *_ in mols:
            w = {k: share.get((k, f), 0.0) * (2 if k == now[i] else 1) for k in want[i]}
            log += math.log(max(sum(w.values()), 1e-30))
            best = min(w, key=lambda k: (-round(w[k], 12), k != now[i], k))  # noqa: B023
            n, now[i] = n + (best != now[i]), best
        logs.append(log)
        moved.append(n)
    assert {r["mol"]: r["cell"] for r in moves.collect()} == now and moved[0] > 0
    h = reassignment.history(moves, 3).orderBy("round").collect()
    assert [r["n_moved"] for r in h] == moved and [r["log_lik"] for r in h] == pytest.approx(logs)

    types = {k: rng.choice(["a", "b", "c", None]) for k in range(60)}
    rules = reassignment.rules(moves, spark.createDataFrame(list(types.items()), "cell long, cell_type string"), 5, 0.02).collect()
    expected = {}
    for f in (1, 2, 3):
        for t in "abc":
            ms = [(i, c) for i, c, g, *_ in mols if g == f and types[c] == t]
            to = [types[now[i]] for i, c in ms if now[i] != c and types[now[i]]]
            top = min(set(to), key=lambda s: (-to.count(s), s)) if to else None  # noqa: B023
            if len(ms) >= 5 and top and top != t and to.count(top) / len(ms) >= 0.02:
                expected[f, top, t] = (len(ms), to.count(top))
    assert {(r["factor"], r["source"], r["target"]): (r["n_in_target"], r["n_moved"]) for r in rules} == expected and expected
    assert all(0 < r["p"] <= 1 for r in rules)


@pytest.mark.parametrize("full", [0, 60, 10**9])
def test_moves_by_squares_equal_moves_by_candidates(spark, full):
    """A clump, cells without molecules, molecules far from their cell or without a place, negative places, ties: whichever squares are crowded."""
    rng = random.Random(7)
    cells = [(i, round(rng.uniform(-40, 60), 1), round(rng.uniform(-40, 60), 1)) for i in range(90)] + [(100 + i, 5.0 + i % 6, 5.0 + i // 6) for i in range(30)]
    at = {k: (x, y) for k, x, y in cells}
    mols = [(i, rng.randrange(1, 5) if i % 40 else None, c, at[c][0] + rng.choice([-8.0, -3.5, 0.0, 2.0, 8.0]), at[c][1] + rng.choice([-4.0, 0.0, 0.0, 6.0])) for i in range(600) for c in [rng.choice(list(at)[10:])]]
    mols += [(1000, 1, 100, 900.0, 900.0), (1001, 2, 101, None, None), (1002, 2, 50, at[3][0], at[3][1]), (1003, 1, 5000, 6.0, 6.0), (None, 1, 102, 6.0, 6.0)]
    m = spark.createDataFrame(mols, "mol long, factor int, cell long, x double, y double")
    c = spark.createDataFrame(cells, "cell long, x double, y double")
    n = m.groupBy("cell", "factor").agg(F.count(F.lit(1)).alias("n"))
    fractions = n.join(m.groupBy("cell").agg(F.count(F.lit(1)).alias("all")), "cell").select("cell", "factor", (F.col("n") / F.col("all")).alias("share"))
    want = {r["mol"]: r for r in reassignment.reassigned(m, reassignment.candidates(m, c), fractions).collect()}
    got = reassignment.moves(m, c, full=full).collect()
    assert len(got) == len(want) == 604 and sum(r["was"] != r["cell"] for r in got) > 50
    for r in got:
        w = want[r["mol"]]
        assert (r["factor"], r["was"], r["cell"]) == (w["factor"], w["was"], w["cell"])
        assert (r["first"], r["later"]) == (pytest.approx(w["first"]), pytest.approx(w["later"]))


@pytest.mark.parametrize("few", [0, 10])
def test_molecules_of_one_number_are_one(spark, monkeypatch, few):
    monkeypatch.setattr(reassignment, "FEW", few)
    rows = [(1, 3, 7, 1.0, 9.0), (1, 2, 8, 2.0, 1.0), (2, 1, 7, 5.0, 5.0), (None, 4, 7, 0.0, 2.0), (None, 4, 6, 1.0, 1.0), (3, 5, 9, None, 4.0), (3, 5, 9, 3.0, None)]
    m = spark.createDataFrame(rows, "mol long, factor int, cell long, x double, y double")
    want = {(1, 2, 7, 1.0, 1.0), (2, 1, 7, 5.0, 5.0), (None, 4, 6, 0.0, 1.0), (3, 5, 9, 3.0, 4.0)}
    got = reassignment.once(m).select(*m.columns).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert reassignment.once(m.where("mol = 2")).count() == 1


@pytest.mark.parametrize("name", ["em_history", "em_rules"])
def test_moves_shuffle_a_molecule_few_times(spark, name):
    store = spark.sparkContext._jsc.sc().statusStore()
    new = spark.sparkContext._gateway.new_array

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, new(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_returnflag <> 'N'").count()
    before = written()
    catalog.queries()[name](spark, sf).collect()
    assert written() - before < 8 * n  # the joins of the view, their number, their square, and tables of cells


def test_gaps_and_density(spark):
    rng = random.Random(2)
    pts = [(s, k, rng.uniform(0, 100), rng.uniform(0, 100)) for s in (0, 1) for k in range(1, 30 if s else 4)]
    c = spark.createDataFrame(pts, "scene_id int, label int, cx double, cy double")
    seeds = spark.createDataFrame([(s, k, k * 7 % 13) for s, k, *_ in pts], "scene_id int, label int, ord int")
    for mode in ("single", "cluster", "region"):
        got = {(r["scene_id"], r["label"]) for r in context.ablation_set(c, seeds, mode, 5).collect()}
        for s in (0, 1):
            own = {k: (x, y) for t, k, x, y in pts if t == s}
            order = sorted(own, key=lambda k: (k * 7 % 13, k))
            at = own[order[0]]
            chosen = order[:5] if mode == "single" else sorted(own, key=lambda k: (math.dist(own[k], at), k))[:5]  # noqa: B023
            if mode == "region":
                xs, ys = zip(*(own[k] for k in chosen), strict=True)
                chosen = [k for k, (x, y) in own.items() if min(xs) <= x <= max(xs) and min(ys) <= y <= max(ys)]
            assert {k for t, k in got if t == s} == set(chosen)
    with pytest.raises(ValueError, match="no such mode"):
        context.ablation_set(c, seeds, "other")
    r = context.density_around(c, spark.createDataFrame([(1, 3), (1, 9), (1, 999)], "scene_id int, label int"), 0.5, 4.0).collect()
    own = {k: (x, y) for t, k, x, y in pts if t == 1}
    x0, x1 = (f(own[3][0], own[9][0]) + e for f, e in ((min, -8), (max, 8)))
    y0, y1 = (f(own[3][1], own[9][1]) + e for f, e in ((min, -8), (max, 8)))
    n = sum(x0 <= x <= x1 and y0 <= y <= y1 for x, y in own.values())
    assert len(r) == 1 and r[0]["n"] == n and r[0]["density"] == pytest.approx(100 * n / ((x1 - x0) * (y1 - y0) * 0.25))


def test_labels_grow_and_shrink_by_rounds(spark):
    rng = random.Random(8)
    image = {(y, x): rng.choice([0, 0, 1, 2, 3]) if (y // 6 + x // 6) % 2 else (y // 6 * 2 + x // 6) % 4 for y in range(20) for x in range(20)}
    grow = {1: True, 2: False, 3: True}
    around = lambda p: [(p[0] + a, p[1] + b) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]
    want = dict(image)
    for label in sorted(grow):
        mask = {p for p, v in image.items() if v == label}
        new = set(mask)
        for _ in range(2):
            new = {q for p in new for q in around(p)} if grow[label] else {p for p in new if all(q in new for q in around(p))}
        if grow[label]:
            want |= {p: label for p in new if image.get(p) == 0}
        else:
            want |= dict.fromkeys(mask - new, 0)
    df = spark.createDataFrame([(0, y, x, v, f"n{y}") for (y, x), v in image.items()], "scene_id int, y int, x int, label int, note string")
    edits = spark.createDataFrame([(0, k, g) for k, g in grow.items()] * 2 + [(0, 77, True)], "scene_id int, label int, grow boolean")
    out = context.jitter_labels(df, edits)
    assert out.schema["label"].dataType == df.schema["label"].dataType
    assert {(r["y"], r["x"]): (r["label"], r["note"]) for r in out.collect()} == {p: (v, f"n{p[0]}") for p, v in want.items()}


@pytest.mark.parametrize("n", [2, 3, 7, 40])
def test_splits_by_place(spark, n):
    rng = random.Random(n)
    crops = [(f"c{i}", float(x := rng.randrange(5)), float(x + 2), float(y := rng.randrange(5)), float(y + 2)) for i in range(n)]
    df = spark.createDataFrame(crops, "crop_id string, xmin double, xmax double, ymin double, ymax double")
    for method in ("x", "y"):
        order = sorted(crops, key=lambda c: ((c[1], c[3]) if method == "x" else (c[3], c[1]), c[0]))  # noqa: B023
        held = max(1, round(0.15 * n))
        held = 1 if 2 * held >= n else held
        want = {c[0]: "train" if n < 3 or i < n - 2 * held else "val" if i < n - held else "test" for i, c in enumerate(order)}
        assert {r["crop_id"]: r["split"] for r in context.spatial_split(df, method).collect()} == want
    row = spark.createDataFrame([(f"c{i}", float(i), i + 1.0, 0.0, 1.0) for i in range(n)], df.schema)
    board = {r["crop_id"]: r["split"] for r in context.spatial_split(row, "checkerboard").collect()}
    assert set(board.values()) == ({"train"} if n < 3 else {"test", "val"} if n > 3 else set(board.values()))
