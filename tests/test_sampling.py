"""Draws of states and templates, splits and spectra against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from cellspan.operators import images, sampling, spectra


def test_states(spark):
    cells = spark.createDataFrame([(i, ["duct", "islet", "none", None][i % 4]) for i in range(8000)], "key bigint, cell_type string")
    d = spark.createDataFrame([("duct", 0, "full", 2.0), ("duct", 1, "sliver", 1.0), ("duct", 2, "poor", None), ("islet", 1, "poor", 5.0), ("none", 0, "sliver", 0.0)], "cell_type string, ord int, state string, p double")
    got = {r.key: r.state for r in sampling.sample_states(cells, d, 3).collect()}
    n = Counter(((["duct", "islet", "none", None][k % 4]), s) for k, s in got.items())
    assert len(got) == 8000 and set(n) == {("duct", "full"), ("duct", "sliver"), ("islet", "poor"), ("none", "full"), (None, "full")}
    assert abs(n["duct", "sliver"] / 2000 - 1 / 3) < 0.04
    assert got == {r.key: r.state for r in sampling.sample_states(cells.repartition(7), d, 3).collect()}
    assert got != {r.key: r.state for r in sampling.sample_states(cells, d, 4).collect()}


def test_templates(spark):
    bank = [(f"t{i}", ["duct", "islet"][i % 2], i % 3) for i in range(30)] + [("lone", "acinar", None)]
    cells = [(i, ["duct", "acinar", "new", None][i % 4], i % 5 if i % 7 else None) for i in range(900)]
    df = spark.createDataFrame(cells, "key bigint, cell_type string, zone int")
    b = spark.createDataFrame(bank, "template string, cell_type string, zone int")
    got = {r.key: r.template for r in sampling.sample_templates(df, b, 5).collect()}
    assert len(got) == 900
    for key, kind, zone in cells:
        pool = [t for t, c, z in bank if c == kind and z == zone and zone is not None] or [t for t, c, _ in bank if c == kind and kind] or [t for t, _, _ in bank]
        assert got[key] in pool
    any_ = Counter(got[k] for k, c, _ in cells if c == "new")
    assert len(any_) > 25
    assert got == {r.key: r.template for r in sampling.sample_templates(df.repartition(5), b.repartition(3), 5).collect()}


def test_split_manifest(spark):
    crops = spark.createDataFrame([("b", "train"), ("a", "train"), ("c", "test")], "crop_id string, split string")
    assert {r.split: (r.n, r.crops) for r in sampling.split_manifest(crops).collect()} == {"train": (2, ["a", "b"]), "val": (0, []), "test": (1, ["c"])}


@pytest.mark.parametrize(("radial", "orient"), [(6, 1), (4, 8)])
def test_spectra(spark, radial, orient):
    rng, side = random.Random(1), 16
    image = {(y, x): rng.random() + math.sin(x) for y in range(20) for x in range(40) if rng.random() < 0.8}
    df = spark.createDataFrame([(0, y, x, v) for (y, x), v in image.items()], "scene_id int, y int, x int, value double").repartition(3)
    got = {(r.py, r.px, r.bin): r.power for r in spectra.log_power(df, side, radial, orient).collect()}
    want = {}
    for py, px in {(y // side, x // side) for y, x in image}:
        patch = [[image.get((py * side + y, px * side + x), 0.0) for x in range(side)] for y in range(side)]
        total, count = Counter(), Counter()
        freq = [k if k < side / 2 else k - side for k in range(side)]
        wave = np.exp(-2j * np.pi * np.outer(np.arange(side), np.arange(side)) / side)
        f = wave @ np.array(patch) @ wave / side
        most = max(math.hypot(freq[v], u) / side for v in range(side) for u in range(side // 2 + 1))
        for v in range(side):
            for u in range(side // 2 + 1):
                ring = min(int(math.hypot(freq[v], u) / side / (most + 1e-9) * radial), radial - 1)
                sector = min(int((math.atan2(freq[v], u) % math.pi) / math.pi * orient), orient - 1)
                total[ring * orient + sector] += abs(f[v, u]) ** 2
                count[ring * orient + sector] += 1
        want.update({(py, px, b): math.log(total[b] / max(count[b], 1) + 1e-8) for b in range(radial * orient)})
    assert got == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_anisotropy(spark):
    """Stripes along the axes stand out against stripes along the diagonal."""
    rows = [(s, y, x, math.sin(2 * math.pi * 8 * (x if s == 0 else x + y) / 32)) for s in (0, 1) for y in range(32) for x in range(32)]
    polar = spectra.log_power(spark.createDataFrame(rows, "scene_id int, y int, x int, value double"), 32, 8, 8)
    got = {r.scene_id: r.anisotropy for r in spectra.anisotropy(polar, 8, 8).collect()}
    assert got[0] > 0 > got[1]


def test_spectra_of_many_squares(spark):
    """Patches of several squares, at negative places too, are those of one transform each; pixels travel as arrays, many to a row."""
    rng, side = np.random.default_rng(3), 32
    image = np.where(rng.random((320, 288)) < 0.7, rng.random((320, 288)), 0.0)
    image[32:64, :32] = 0  # a patch without a pixel
    y, x = np.nonzero(image)
    df = spark.createDataFrame(pd.DataFrame({"scene_id": 2, "y": y - 32, "x": x - 64, "value": image[y, x]})).coalesce(1)
    got = {(r.py, r.px, r.bin): r.power for r in spectra.log_power(df, side, 4, 2).collect()}
    bins, want = spectra.frequency_bins(side, 4, 2), {}
    for py in range(10):
        for px in range(9):
            patch = image[py * side :, px * side :][:side, :side]
            if patch.any():
                power = np.abs(np.fft.rfft2(patch, norm="ortho")) ** 2
                want.update({(py - 1, px - 2, b): math.log(power[bins == b].mean() + 1e-8 if (bins == b).any() else 1e-8) for b in range(8)})
    assert got == pytest.approx(want, rel=1e-9) and (0, -2, 0) not in got
    rows = images.blocks(df, "value", 0, 256)
    assert rows.count() * 100 < len(y) and rows.agg({"at": "count"}).first()[0] == rows.count()
    assert sum(len(r.at) for r in rows.collect()) == len(y)
