"""Bundles with a third dimension, written and read again."""

import json

import pytest

from cellspan.sources import bundle, bundle25


def _parts(spark, type_b="islet"):
    mols = spark.createDataFrame([(40, 1.0, 2.0, 3.0, "b", "G1", 7), (10, 4.0, 5.0, 6.0, "a", None, 2), (30, 0.5, 0.5, 9.0, "h", "G2", 1)], "mol long, x_true double, y_true double, z_true double, true_cell_id string, gene string, factor_label int")
    cells = spark.createDataFrame([("a", 1.0, 1.0, "duct", False, 8.0), ("b", 5.0, 5.0, type_b, False, 9.0), ("h", 2.0, 2.0, None, True, 3.0)], "cell_id string, centroid_x double, centroid_y double, cell_type string, is_unobserved boolean, z_center_um double")
    square = lambda i, c, s: [(i, c, k, s * x, s * y) for k, (x, y) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]
    schema = "cell_idx long, cell_id string, vertex_ord int, vertex_x double, vertex_y double"
    rings = spark.createDataFrame(square(5, "b", 2.0) + square(3, "a", 3.0) + square(9, "h", 1.0), schema)
    nuclei = spark.createDataFrame(square(5, "b", 1.0) + square(3, "a", 0.5)[:2], schema)
    return mols, cells, rings, nuclei


def test_bundle_is_written_and_read(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    rows = bundle25.write(folder, *_parts(spark), [0.0, 2.5, 5.0], 0.25, {"seed": 3})
    assert rows == {"transcripts": 3, "cells": 2, "cell_boundaries": 8, "nucleus_boundaries": 4, "ground_truth/cells_3d": 3, "ground_truth/molecule_provenance": 3, "ground_truth/cells_synth": 2}
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    t = {r["transcript_id"]: r for r in read("transcripts").collect()}
    assert {k: (r["cell_id"], r["feature_name"], r["qv"], r["z_location"], r["overlaps_nucleus"]) for k, r in t.items()} == {
        "synth_000000000": ("a", "synth", 40.0, 6.0, True), "synth_000000001": ("h", "G2", 40.0, 9.0, True), "synth_000000002": ("b", "G1", 40.0, 3.0, True)}
    assert {(r["cell_id"], r["transcript_counts"], r["total_counts"], r["cell_area"], r["nucleus_area"]) for r in read("cells").collect()} == {("a", 1, 1, 9.0, 0.0), ("b", 1, 1, 4.0, 1.0)}
    assert {(r["cell_id"], r["label_id"]) for r in read("cell_boundaries").collect()} == {("a", 1), ("b", 2)} and {r["cell_id"] for r in read("nucleus_boundaries").collect()} == {"b"}
    p = {r["transcript_id"]: r for r in read("ground_truth/molecule_provenance").collect()}
    assert (p["synth_000000002"]["true_factor"], p["synth_000000002"]["x_um"], p["synth_000000002"]["true_cell_type"], p["synth_000000002"]["is_ghost"], p["synth_000000002"]["tile_idx"]) == (7, 1.0, "unknown", False, 0)
    assert {(r["cell_id"], r["cell_type"], r["area_um2"], r["source"]) for r in read("ground_truth/cells_synth").collect()} == {("a", "duct", 9.0, "observed_anchor"), ("b", "islet", 4.0, "observed_anchor")}
    about = bundle.manifest(spark, folder)
    assert (about["z_step_size"], about["num_transcripts"], about["synth_metadata"]["n_z"]) == (2.5, 3, 3)
    assert json.loads((tmp_path / "b/ground_truth/config.json").read_text()) | {"seed": 3, "n_unobserved_cells": 1} == json.loads((tmp_path / "b/ground_truth/config.json").read_text())
    assert spark.read.csv(f"{folder}/cell_boundaries.csv.gz", header=True).count() == 8


@pytest.mark.parametrize("bad", ["unknown", " ", None])
def test_an_observed_cell_without_a_type_is_an_error(spark, tmp_path, bad):
    with pytest.raises(ValueError, match="known type: 1 rows, such as b"):
        bundle25.write(f"file://{tmp_path}/b", *_parts(spark, bad), [0.0], 1.0)
    assert not (tmp_path / "b").exists()


def test_empty_tables_give_an_empty_bundle(spark, tmp_path):
    rows = bundle25.write(f"file://{tmp_path}/b", *(d.limit(0) for d in _parts(spark)), [0.0], 1.0, mirrors=False)
    assert set(rows.values()) == {0}
