"""Readers and writers of a bundle: a folder of molecules, cells and boundaries with a JSON manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.functions import columns

# Fixed values of the format: file names, column names and the names that columns may have instead.
MANIFEST = "experiment.json"
TABLES = ("transcripts", "cells", "cell_boundaries", "nucleus_boundaries")
ALIASES = {"cell_id": ("cell_id", "cell"), "centroid_x": ("x_centroid", "x", "centroid_x"), "centroid_y": ("y_centroid", "y", "centroid_y"), "cell_type": ("cell_type", "celltype")}
NUMBERS = ("x", "y", "x_centroid", "y_centroid", "z_centroid", "centroid_x", "centroid_y", "x_location", "y_location", "z_location", "qv", "vertex_x", "vertex_y", "cell_area", "nucleus_area", "transcript_counts", "nucleus_distance", "overlaps_nucleus")
#: Boxes up to which a scan is given each box; beyond, their common bounds.
MOST_BOXES = 64


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest, the file named experiment whatever its ending, with its defaults: pixel_size 1, z_step_size none."""
    rows = spark.read.text(f"{folder}/{MANIFEST.split('.')[0]}.*", wholetext=True).first()
    return {"pixel_size": 1.0, "z_step_size": None, "run_name": None} | json.loads(rows["value"])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a bundle, from Parquet if it is there, else from CSV or gzipped CSV (one task reads a gzip file; it is dealt out after)."""
    if exists(spark, f"{folder}/{name}.parquet"):
        return spark.read.parquet(f"{folder}/{name}.parquet")
    for end in ("csv", "csv.gz"):
        if exists(spark, f"{folder}/{name}.{end}"):
            rows = spark.read.csv(f"{folder}/{name}.{end}", header=True)  # one pass; ids stay text
            rows = rows.withColumns({c: F.col(c).cast("double") for c in rows.columns if c in NUMBERS})
            return rows.repartition(spark.sparkContext.defaultParallelism) if end == "csv.gz" else rows
    raise FileNotFoundError(f"{folder} has no table {name}")


def normalise_cells(cells: DataFrame) -> DataFrame:
    """cell_id, centroid_x, centroid_y, cell_type under these names whatever alias the file has; rows without an id go, nulls are 0 or ''."""
    found = {name: [F.col(c) for c in names if c in cells.columns] for name, names in ALIASES.items()}
    text = lambda name: F.coalesce(*(c.cast("string") for c in found[name]), F.lit(""))
    number = lambda name: F.coalesce(*(c.cast("double") for c in found[name]), F.lit(0.0))
    out = cells.select(text("cell_id").alias("cell_id"), number("centroid_x").alias("centroid_x"), number("centroid_y").alias("centroid_y"), text("cell_type").alias("cell_type"))
    return out.where("cell_id <> ''")


def read_cells(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_cells(read_table(spark, folder, "cells"))


def read_annotation(spark: SparkSession, path: str, column: str = "merged_annotation") -> DataFrame:
    """(cell_id, cell_type) of an annotation file; empty where the column is missing."""
    rows = spark.read.csv(path, header=True)
    return rows.select("cell_id", F.col(column).alias("cell_type")) if column in rows.columns else spark.createDataFrame([], "cell_id string, cell_type string")


def scan_strategy(boxes: int) -> str:
    return "crop_boxes" if boxes <= MOST_BOXES else "union_bounds"


def box_predicate(boxes: list[tuple[float, float, float, float]], x: str = "x_location", y: str = "y_location") -> Column:
    """Ranges of (xmin, xmax, ymin, ymax) that reach the file scan: one for each box, or their common bounds beyond MOST_BOXES."""
    if scan_strategy(len(boxes)) == "union_bounds":
        a, b, c, d = zip(*boxes, strict=True)
        boxes = [(min(a), max(b), min(c), max(d))]
    out = F.lit(False)
    for a, b, c, d in boxes:
        out = out | (F.col(x).between(a, b) & F.col(y).between(c, d))
    return out


def scan_molecules(molecules: DataFrame, boxes: DataFrame, min_qv: float = 20.0, most: int = 4096) -> DataFrame:
    """x_location, y_location, cell_id of molecules that pass the quality filter and lie in some box's range.

    boxes are read to the driver as a predicate if they are at most ``most``, else only the quality filter applies; in
    any case points_in_boxes() has to follow.
    """
    rows = boxes.select("xmin", "xmax", "ymin", "ymax").limit(most + 1).collect()
    out = molecules.select("x_location", "y_location", "qv", "cell_id").where(F.col("qv") >= min_qv)
    return (out.where(box_predicate([tuple(r) for r in rows])) if 0 < len(rows) <= most else out).drop("qv")


def read_boundaries(vertices: DataFrame, box: tuple[float, float, float, float], pad: float) -> DataFrame:
    """(cell_id, ring) of vertices within the padded box, in their order; rings of fewer than three go.

    vertices need vertex_ord.  A ring that crosses the box is cut, as in the format's own reader.
    """
    a, b, c, d = box
    inside = vertices.where(F.col("vertex_x").between(a - pad, b + pad) & F.col("vertex_y").between(c - pad, d + pad))
    ring = F.sort_array(F.collect_list(F.struct("vertex_ord", "vertex_x", "vertex_y"))).alias("ring")
    return inside.groupBy("cell_id").agg(ring).where(F.size("ring") >= 3)


def polygons_long(polygons: DataFrame) -> DataFrame:
    """(cell_id, vertex_x, vertex_y, label_id): label_id numbers cells from 1 in order of cell_idx."""
    labels = polygons.select("cell_idx").distinct()
    return polygons.join(number_rows(labels, "cell_idx", "label_id"), "cell_idx").select("cell_id", "vertex_ord", "vertex_x", "vertex_y", "label_id")


def number_rows(keys: DataFrame, key: str, name: str) -> DataFrame:
    """keys, distinct whole numbers, with their place from 1 in order: places within ranges of 65,536 numbers, after those of the ranges before."""
    from pyspark.sql import Window

    rows = keys.withColumn("range", F.shiftright(F.col(key).cast("long"), 16))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = rows.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(key))
    return rows.withColumn(name, place).join(ranges, "range").withColumn(name, F.col(name) + F.col("before")).drop("range", "before")


def transcripts_table(molecules: DataFrame) -> DataFrame:
    """The table that is written: typed as the format wants it, 1 for nucleus, molecules of no cell without a distance."""
    own = columns.assigned(F.col("cell_id"))
    return molecules.select(
        "mol_key", F.when(own, F.col("cell_id")).otherwise("UNASSIGNED").alias("cell_id"), F.col("overlaps_nucleus").cast("tinyint").alias("overlaps_nucleus"), "feature_name",
        F.col("x_location").cast("float").alias("x_location"), F.col("y_location").cast("float").alias("y_location"), F.lit(0.0).cast("float").alias("z_location"), F.col("qv").cast("float").alias("qv"),
        F.when(F.col("overlaps_nucleus") == 1, 0.0).otherwise(5.0).cast("float").alias("nucleus_distance"),
    )


def cells_table(cells: DataFrame, molecules: DataFrame) -> DataFrame:
    """Cells with the count of their molecules, 0 for none."""
    n = molecules.where(columns.assigned(F.col("cell_id"))).groupBy("cell_id").agg(F.count(F.lit(1)).alias("transcript_counts"))
    out = cells.join(n, "cell_id", "left").withColumn("transcript_counts", F.coalesce("transcript_counts", F.lit(0)))
    return out.select("cell_id", F.col("centroid_x").alias("x_centroid"), F.col("centroid_y").alias("y_centroid"), "transcript_counts", F.col("transcript_counts").alias("total_counts"), "cell_area", "nucleus_area")


def write_bundle(folder: str, molecules: DataFrame, cells: DataFrame, polygons: DataFrame, run_name: str, pixel_size: float = 1.0, mirrors: bool = False) -> None:
    """Molecules, cells, boundaries and manifest; with mirrors, gzipped CSV beside Parquet.  The manifest comes last: a folder without one is not whole."""
    spark = cells.sparkSession
    tables = {"transcripts": transcripts_table(molecules).withColumnRenamed("mol_key", "transcript_id"), "cells": cells_table(cells, molecules), "cell_boundaries": polygons_long(polygons)}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        if mirrors:
            spark.read.parquet(f"{folder}/{name}.parquet").write.mode("overwrite").csv(f"{folder}/{name}.csv.gz", header=True, compression="gzip")
    text = json.dumps({"run_name": run_name, "pixel_size": pixel_size, "num_cells": spark.read.parquet(f"{folder}/cells.parquet").count()})
    fs, p = _fs(spark, f"{folder}/{MANIFEST}")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def replace_table(df: DataFrame, path: str, key: str) -> None:
    """Write df sorted by key within files beside path, then take its place by renaming; between the two renames a reader finds no table.

    Tables that are read while they change are better kept in versions (sources.versioned), which have no such moment.
    """
    fs, p = _fs(df.sparkSession, path)
    fresh, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.repartitionByRange(key).sortWithinPartitions(key).write.parquet(fresh)
    if fs.exists(p):
        fs.rename(p, _fs(df.sparkSession, old)[1])
    fs.rename(_fs(df.sparkSession, fresh)[1], p)
    fs.delete(_fs(df.sparkSession, old)[1], True)
