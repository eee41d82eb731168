"""Sections of ellipsoids against numpy, which cuts them with a basis of the plane; fits against ellipsoids that are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspan.operators import sections


def _cuts(axes, normals, u):
    """Areas and ratios: eigenvalues of the quadric on two vectors that span the plane."""
    area, ratio = [], []
    for a, n, at in zip(axes, normals, u, strict=True):
        basis = np.linalg.svd(n[None])[2][1:]
        low, high = np.linalg.eigvalsh(basis @ np.diag(1 / a**2) @ basis.T)
        rel = 1 - at * at
        area.append(np.pi * rel / np.sqrt(low * high))
        ratio.append(np.sqrt(high / low))
    return np.array(area), np.array(ratio)


def test_sections_equal_those_by_a_basis(spark):
    rng = np.random.default_rng(4)
    axes, normals, u = np.exp(rng.normal(1, 0.5, (60, 3))), rng.normal(size=(60, 3)), rng.uniform(-1, 1, 60)
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    df = spark.createDataFrame([(i, *map(float, (*a, *n, x))) for i, (a, n, x) in enumerate(zip(axes, normals, u, strict=True))], ["i", "a1", "a2", "a3", "n1", "n2", "n3", "u"])
    area, ratio = sections.section([F.col(f"a{k}") for k in (1, 2, 3)], [F.col(f"n{k}") for k in (1, 2, 3)], F.col("u"))
    got = df.select("i", area.alias("area"), ratio.alias("ratio")).orderBy("i").collect()
    want = _cuts(axes, normals, u)
    assert [r["area"] for r in got] == pytest.approx(want[0]) and [r["ratio"] for r in got] == pytest.approx(want[1])


def test_draws_are_even_and_do_not_hang_on_partitions(spark):
    rows = sections.planes(spark, 4000, 3)
    assert sorted(rows.collect()) == sorted(sections.planes(spark, 4000, 3).repartition(7).collect())
    p = rows.toPandas()
    assert abs(p["z"].mean()) < 0.05 and abs(p["z"].std() - 1) < 0.05 and abs(p["u"].mean()) < 0.05
    assert np.allclose((p[["n1", "n2", "n3"]] ** 2).mean(), 1 / 3, atol=0.02) and np.allclose((p[["n1", "n2", "n3"]] ** 2).sum(axis=1), 1)


def test_fit_finds_the_quantiles_of_known_ellipsoids(spark):
    rng, rows = np.random.default_rng(9), []
    known = {"round": (1.2, 0.15, 0.0, 0.0), "long": (1.6, 0.3, 0.5, -0.2)}
    for name, (mean, spread, k1, k2) in known.items():
        normals = rng.normal(size=(6000, 3))
        normals /= np.linalg.norm(normals, axis=1)[:, None]
        axes = np.exp(mean + spread * rng.normal(size=(6000, 1)) + np.array([k1, k2, -k1 - k2]))
        area, ratio = _cuts(axes, normals, rng.uniform(-0.999, 0.999, 6000))
        rows.append((name, *([float(v) for v in np.quantile(x, sections.PARTS)] for x in (area, ratio))))
    schema = "cell_type string, area array<double>, ratio array<double>"
    bad = [("short", [1.0], [1.0]), ("null", None, None), ("hole", [1.0, None, 1.0, 1.0, 1.0], [1.0] * 5)]
    got = {r["cell_type"]: r for r in sections.fit_shapes(spark.createDataFrame(rows + bad, schema), n=3000, rounds=7).collect()}
    assert set(got) == set(known)
    for name, area, ratio in rows:
        assert got[name]["loss"] < 3e-3 and got[name]["area"] == pytest.approx(area, rel=0.12) and got[name]["ratio"] == pytest.approx(ratio, rel=0.08)
        assert got[name]["log_radius_mean"] == pytest.approx(known[name][0], abs=0.08)
    spread = lambda r: max(r["k1"], r["k2"], r["k3"]) - min(r["k1"], r["k2"], r["k3"])
    assert spread(got["round"]) < 0.25 < spread(got["long"]) and sections.fit_shapes(spark.createDataFrame([], schema), n=50, rounds=1).count() == 0
