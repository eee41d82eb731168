"""Bundles with a third dimension: molecules and cells at a depth, outlines of the cells that were observed, and the truth beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.operators import contracts, geometry
from cellspan.sources import bundle

#: Columns of the format that are always 0 here.
ZEROS = ("control_probe_counts", "control_codeword_counts", "unassigned_codeword_counts", "deprecated_codeword_counts")
RESOLVER = ("cell_type_source", "cell_type_confidence", "cell_type_evidence")


def _or(df: DataFrame, name: str, kind: str, value: object):  # noqa: ANN202
    """The column where the table has it, else a value; nulls of it take the value too."""
    return (F.coalesce(F.col(name).cast(kind), F.lit(value).cast(kind)) if name in df.columns else F.lit(value).cast(kind)).alias(name)


def outlines(rings: DataFrame, observed: DataFrame) -> DataFrame:
    """(cell_id, vertex_ord, vertex_x, vertex_y, label_id) of the rings (cell_idx, cell_id, vertex_ord, vertex_x, vertex_y) of observed cells; rings of fewer than three corners go."""
    own = rings.join(observed.select("cell_id").distinct(), "cell_id", "left_semi")
    whole = own.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    long = bundle.polygons_long(own.join(whole.select("cell_id"), "cell_id", "left_semi"))
    return long.select("cell_id", "vertex_ord", F.col("vertex_x").cast("float").alias("vertex_x"), F.col("vertex_y").cast("float").alias("vertex_y"), F.col("label_id").cast("long").alias("label_id"))


def tables(molecules: DataFrame, cells: DataFrame, rings: DataFrame, nuclei: DataFrame) -> dict[str, DataFrame]:
    """The tables of a bundle by name, those of the truth under ground_truth/.

    molecules: mol (a number of its own), x_true, y_true, z_true, true_cell_id, and where there are, gene, qv, is_ghost, factor_label, true_cell_type.
    cells: cell_id, centroid_x, centroid_y, cell_type, is_unobserved and whatever else; rings and nuclei as in outlines().  Transcripts are
    numbered in order of mol, as synth_000000000 and on; every molecule keeps its true cell.  Published cells are the observed ones; areas
    are those of their outlines, 0 without one.
    """
    seen = cells.where(~F.col("is_unobserved"))
    numbered = molecules.join(bundle.number_rows(molecules.select("mol"), "mol", "n"), "mol").withColumn("transcript_id", F.format_string("synth_%09d", F.col("n") - 1))
    true = numbered.select(
        "transcript_id", "true_cell_id", *(F.col(f"{a}_true").cast("float").alias(f"{a}_true") for a in "xyz"), F.col("x_true").cast("double").alias("x_um"), F.col("y_true").cast("double").alias("y_um"),
        _or(molecules, "gene", "string", "synth"), _or(molecules, "qv", "float", 40.0), _or(molecules, "is_ghost", "boolean", False), _or(molecules, "factor_label", "long", -1), _or(molecules, "true_cell_type", "string", "unknown"),
    )
    transcripts = true.select(
        "transcript_id", *(F.col(f"{a}_true").alias(f"{a}_location") for a in "xyz"), "qv", F.col("gene").alias("feature_name"), F.col("true_cell_id").alias("cell_id"),
        F.lit(True).alias("overlaps_nucleus"), F.lit(0.0).cast("float").alias("nucleus_distance"),
    )
    provenance = true.select("transcript_id", F.lit(0).cast("long").alias("tile_idx"), "true_cell_id", "is_ghost", "gene", F.col("factor_label").alias("true_factor"), "x_um", "y_um", "x_true", "y_true", "z_true", "true_cell_type")
    counts = molecules.groupBy(F.col("true_cell_id").alias("cell_id")).agg(F.count(F.lit(1)).alias("transcript_counts"))
    area = lambda r, name: geometry.polygon_stats(r.join(seen.select("cell_id"), "cell_id", "left_semi")).select("cell_id", F.col("area").alias(name))
    listed = seen.join(counts, "cell_id", "left").join(area(rings, "cell_area"), "cell_id", "left").join(area(nuclei, "nucleus_area"), "cell_id", "left")
    n = F.coalesce("transcript_counts", F.lit(0))
    published = listed.select(
        "cell_id", F.col("centroid_x").cast("double").alias("x_centroid"), F.col("centroid_y").cast("double").alias("y_centroid"), n.alias("transcript_counts"), *(F.lit(0).cast("long").alias(z) for z in ZEROS),
        n.alias("total_counts"), F.coalesce("cell_area", F.lit(0.0)).alias("cell_area"), F.coalesce("nucleus_area", F.lit(0.0)).alias("nucleus_area"),
    )
    synth = listed.select(
        "cell_id", "cell_type", F.lit(False).alias("is_ghost"), "centroid_x", "centroid_y", F.coalesce("cell_area", F.lit(0.0)).alias("area_um2"), F.lit("observed_anchor").alias("source"),
        *(c for c in RESOLVER if set(RESOLVER) <= set(cells.columns)),
    )
    return {
        "transcripts": transcripts, "cells": published, "cell_boundaries": outlines(rings, seen), "nucleus_boundaries": outlines(nuclei, seen),
        "ground_truth/cells_3d": cells, "ground_truth/molecule_provenance": provenance, "ground_truth/cells_synth": synth,
    }


def write(folder: str, molecules: DataFrame, cells: DataFrame, rings: DataFrame, nuclei: DataFrame, z_slices: list[float], pixel_size: float, config: dict | None = None, mirrors: bool = True) -> dict[str, int]:
    """Writes a bundle and returns the rows of its tables.  An observed cell without a known type is an error, raised before anything is written.

    With mirrors, outlines are there as gzipped CSV too.  The manifest comes last, so that a folder without one is not whole.
    """
    spark, parts = cells.sparkSession, tables(molecules, cells, rings, nuclei)
    rule = contracts.Rule("holds", "lower(trim(cell_type)) not in ('', 'unknown', 'nan')", name="observed cells have a known type")
    contracts.require(contracts.check(parts["ground_truth/cells_synth"], [rule], "cell_id"))
    rows = {}
    for name, table in parts.items():
        path = f"{folder}/{name}.parquet"
        table.write.mode("overwrite").parquet(path)
        rows[name] = spark.read.parquet(path).count()  # from the footers
        if mirrors and name.endswith("boundaries"):
            spark.read.parquet(path).write.mode("overwrite").csv(f"{folder}/{name}.csv.gz", header=True, compression="gzip")
    step = z_slices[1] - z_slices[0] if len(z_slices) > 1 else None
    about = {
        "run_name": "synthetic", "pixel_size": pixel_size, "z_step_size": step, "num_cells": rows["cells"], "num_transcripts": rows["transcripts"], "num_unassigned_transcripts": 0,
        "synth_metadata": {"scene_mode": "2.5d", "n_z": len(z_slices), "ground_truth_in_cell_id_column": True},
    }
    hidden = rows["ground_truth/cells_3d"] - rows["cells"]
    settings = {"scene_mode": "2.5d", "pixel_size_um": pixel_size, "z_slices_um": z_slices, "n_observed_cells": rows["cells"], "n_unobserved_cells": hidden} | (config or {})
    for name, content in (("ground_truth/config.json", settings), (bundle.MANIFEST, about)):
        fs, p = bundle._fs(spark, f"{folder}/{name}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
    return rows
