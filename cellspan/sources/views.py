"""Deterministic spatial views over the driver tables: the same SQL text runs in Spark and in the oracle."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

CELLS = """select c_custkey as cell_idx, concat('cell_', cast(c_custkey as varchar(20))) as cell_id,
  case when c_custkey % 17 = 0 then null else c_mktsegment end as cell_type,
  (c_custkey % 40) * 10.0e0 + ((c_custkey * 7919) % 101) / 20.0e0 as centroid_x,
  floor(c_custkey / 40.0e0) * 10.0e0 + ((c_custkey * 6271) % 103) / 20.0e0 as centroid_y,
  30.0e0 + (c_custkey * 31) % 90 as cell_area, 8.0e0 + (c_custkey * 17) % 40 as nucleus_area from customer"""
MOLECULES = """select l_orderkey * 10 + l_linenumber as mol_key, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  case when l_returnflag = 'N' then 'UNASSIGNED' else concat('cell_', cast(o_custkey as varchar(20))) end as cell_id,
  l_linenumber as factor, p_brand as feature_name,
  v.centroid_x + ((l_partkey * 13) % 121 - 60) / 10.0e0 as x_location,
  v.centroid_y + ((l_suppkey * 29 + l_partkey) % 121 - 60) / 10.0e0 as y_location,
  l_quantity as qv, case when l_linestatus = 'F' then 1 else 0 end as overlaps_nucleus, l_discount * 60.0e0 as nucleus_distance
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join v_cells v on o_custkey = v.cell_idx"""
POLYGONS = """select cell_idx, cell_id, ord as vertex_ord,
  centroid_x + (3.0e0 + cell_idx % 5 * 0.5e0) * ux as vertex_x, centroid_y + (2.0e0 + cell_idx % 3 * 0.5e0) * uy as vertex_y
from v_cells cross join (values (0,1.0e0,0.0e0),(1,0.7e0,0.7e0),(2,0.0e0,1.0e0),(3,-0.7e0,0.7e0),(4,-1.0e0,0.0e0),(5,-0.7e0,-0.7e0),(6,0.0e0,-1.0e0),(7,0.7e0,-0.7e0)) t(ord,ux,uy)"""
CROPS = """select n_nationkey as crop_ord, concat('crop_', n_name) as crop_id,
  (n_nationkey % 5) * 60.0e0 - 10.0e0 as xmin, (n_nationkey % 5) * 60.0e0 + 70.0e0 as xmax,
  floor(n_nationkey / 5.0e0) * 60.0e0 - 10.0e0 as ymin, floor(n_nationkey / 5.0e0) * 60.0e0 + 70.0e0 as ymax from nation"""
PIXELS = """select r_regionkey as scene_id, a.n_nationkey as y, b.n_nationkey as x,
  case when (a.n_nationkey + b.n_nationkey + r_regionkey) % 7 = 0 then 0 else cast(1 + floor(b.n_nationkey / 5.0e0) + 5 * floor(a.n_nationkey / 5.0e0) as int) end as label,
  case when a.n_nationkey % 5 in (1,2,3) and b.n_nationkey % 5 in (1,2,3) then 1 else 0 end as nucleus,
  ((b.n_nationkey * 7 + a.n_nationkey * 13 + r_regionkey * 31) % 97) / 97.0e0 as value
from region cross join nation a cross join nation b"""
Z_ATTRS = """select cell_id, 12.0e0 + (cell_idx * 37) % 90 / 10.0e0 as z_center_um, 5.0e0 + (cell_idx * 53) % 120 / 10.0e0 as z_extent_um,
  (cell_idx * 11) % 100 / 100.0e0 as z_confidence from v_cells where cell_idx % 9 <> 0"""
_STEPS = {n: ", ".join(f"({i})" for i in range(-n, n + 1)) for n in (7, 11)}
MASKS = f"""select cell_idx, cast(floor(centroid_y * 2) + 12 + dy as bigint) as y, cast(floor(centroid_x * 2) + 12 + dx as bigint) as x,
  power(((floor(centroid_x * 2) + dx + 0.5e0) / 2 - centroid_x) / (3.0e0 + cell_idx % 5 * 0.5e0), 2) + power(((floor(centroid_y * 2) + dy + 0.5e0) / 2 - centroid_y) / (2.0e0 + cell_idx % 3 * 0.5e0), 2) as r2
from v_cells cross join (values {_STEPS[11]}) a(dx) cross join (values {_STEPS[7]}) b(dy)"""

VIEWS = {"v_cells": CELLS, "v_molecules": MOLECULES, "v_polygons": POLYGONS, "v_crops": CROPS, "v_pixels": PIXELS, "v_z_attrs": Z_ATTRS, "v_masks": MASKS}
BASE = ("region", "nation", "customer", "part", "orders", "lineitem")


def view(spark: SparkSession, sf_dir: str, name: str, also: str = "", where: str = "") -> DataFrame:
    """A view as a DataFrame; the base tables are read lazily, so columns and filters reach the scans.

    Tables are registered under names of their own, so that no view of the session is replaced.
    Molecules meet their order, part and cell by hashing these: the molecules, by far the most rows, are not sorted, and nothing is broadcast.
    also, where: further columns and a condition, in terms of the base tables; such a condition on molecules holds before they meet the others.
    """
    own = {t: f"cellspan_{zlib.crc32(sf_dir.encode()):08x}_{t}" for t in (*BASE, "v_cells")}
    text = lambda sql: re.sub(r"\b(" + "|".join(own) + r")\b", lambda m: own[m[0]], sql)
    for table in own:  # those that the view names, each listed once in a session
        if re.search(rf"\b{table}\b", VIEWS[name] + CELLS * ("v_cells" in VIEWS[name])) and not spark.catalog.tableExists(own[table]):
            rows = spark.sql(text(CELLS)) if table == "v_cells" else spark.read.parquet(f"{sf_dir}/{table}.parquet")
            rows.createOrReplaceTempView(own[table])
    hint = "/*+ SHUFFLE_HASH(orders, part, v) */" if name == "v_molecules" else ""
    sql = VIEWS[name].replace("select", f"select {hint} {also}{',' * bool(also)}", 1) + f" where {where}" * bool(where)
    return spark.sql(text(sql))


def with_views(sql: str) -> str:
    """sql with the views as common table expressions."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in VIEWS.items() if k in sql or k == "v_cells") + "\n" + sql
