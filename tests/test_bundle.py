"""Readers, writers and scans on a small bundle."""

import gzip
import json

import pytest

from cellspan.operators import spatial
from cellspan.sources import artifacts, bundle

CELLS = "cell_id,x_centroid,y_centroid,cell_type\n0071,3.5,8.25,stroma\nkq-9,140,77,duct\n,60,60,duct\nkq-12,141.5,70,\n"
MOLECULES = (
    "transcript_id,cell_id,feature_name,x_location,y_location,qv\n90001,0071,KRT7,3,9,41\n90002,0071,VIM,4.5,7,19.5\n90003,UNASSIGNED,VIM,2,2,22\n"
    "90004,kq-9,KRT7,139,76,35\n90005,kq-12,KRT7,141,71,27\n90006,UNASSIGNED,KRT7,200,200,40\n"
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / bundle.MANIFEST).write_text(json.dumps({"run_name": "slide 17", "pixel_size": 0.325}))
    for name, text in (("cells", CELLS), ("transcripts", MOLECULES)):
        with gzip.open(tmp_path / f"{name}.csv.gz", "wt") as f:
            f.write(text)
    return f"file://{tmp_path}"


def test_bundle_of_csv(spark, folder):
    m = bundle.manifest(spark, folder)
    assert (m["run_name"], m["pixel_size"], m["z_step_size"]) == ("slide 17", 0.325, None)
    assert {tuple(r) for r in bundle.read_cells(spark, folder).collect()} == {("0071", 3.5, 8.25, "stroma"), ("kq-9", 140.0, 77.0, "duct"), ("kq-12", 141.5, 70.0, "")}
    assert bundle.read_table(spark, folder, "transcripts").schema["transcript_id"].dataType.simpleString() == "string"
    crops = spark.createDataFrame([(0, "left", 0.0, 9.0, 0.0, 9.5), (1, "right", 130.0, 150.0, 65.0, 80.0), (2, "none", 300.0, 310.0, 0.0, 9.0)], "crop_ord int, crop_id string, xmin double, xmax double, ymin double, ymax double")
    counts = spatial.crop_counts(bundle.read_table(spark, folder, "transcripts"), crops).collect()
    assert {tuple(r) for r in counts} == {("left", 2, 1), ("right", 2, 2), ("none", 0, 0)}
    with pytest.raises(FileNotFoundError):
        bundle.read_table(spark, folder, "cell_boundaries")


def test_scan_pushes_boxes_down(spark, tmp_path):
    path = f"file://{tmp_path}/molecules"
    spark.createDataFrame([("m4", 21.5, 2.25, 33.0), ("UNASSIGNED", 61.0, 12.0, 48.0), ("m4", 22.0, 2.5, 11.0)], "cell_id string, x_location double, y_location double, qv double").write.parquet(path)
    boxes = spark.createDataFrame([(20.0, 23.0, 1.0, 4.0), (80.0, 90.0, 20.0, 30.0)], "xmin double, xmax double, ymin double, ymax double")
    scan = bundle.scan_molecules(spark.read.parquet(path), boxes)
    assert [tuple(r) for r in scan.collect()] == [(21.5, 2.25, "m4")]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThanOrEqual(qv,20.0)" in pushed and "x_location" in pushed and "Or(" in pushed
    assert bundle.scan_strategy(4) == "crop_boxes" and bundle.scan_strategy(65) == "union_bounds"
    assert str(bundle.box_predicate([(i, i + 1, 0, 1) for i in range(65)])).count("x_location") == 2


def test_written_bundle_is_read_back(spark, tmp_path):
    from cellspan.sources.views import view

    sf, out = "/root/testdata/sf0.001", f"file://{tmp_path}/out"
    bundle.write_bundle(out, view(spark, sf, "v_molecules"), view(spark, sf, "v_cells"), view(spark, sf, "v_polygons"), "back", 0.25, mirrors=True)
    assert bundle.manifest(spark, out)["num_cells"] == bundle.read_cells(spark, out).count() == view(spark, sf, "v_cells").count()
    assert bundle.read_table(spark, out, "transcripts").count() == view(spark, sf, "v_molecules").count()
    assert spark.read.csv(f"{out}/cells.csv.gz", header=True).count() == view(spark, sf, "v_cells").count()


def test_table_is_replaced_as_a_whole(spark, tmp_path):
    path = f"file://{tmp_path}/z"
    for rows in ([(2, "a"), (1, "b")], [(3, "c")]):
        bundle.replace_table(spark.createDataFrame(rows, "k int, v string"), path, "k")
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(rows)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["z"]


def test_annotation_without_its_column_is_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cell_id,merged_annotation\nm4,acinar\nm7,immune\n")
    assert {tuple(r) for r in bundle.read_annotation(spark, f"file://{tmp_path}/a.csv").collect()} == {("m4", "acinar"), ("m7", "immune")}
    assert bundle.read_annotation(spark, f"file://{tmp_path}/a.csv", "other").count() == 0


def test_regions_files(spark, tmp_path):
    want = [(0, "core", 1.0, 2.0, 30.5, 40.0), (1, "region2", 5.0, 6.0, 7.0, 8.0)]
    forms = {
        "list.json": json.dumps([{"name": "core", "xmin": 1, "ymin": 2, "xmax": 30.5, "ymax": 40}, {"bounds": [5, 6, 7, 8]}]),
        "object.json": json.dumps({"regions": [{"name": "core", "bounds": [1, 2, 30.5, 40]}, {"xmin": 5, "ymin": 6, "xmax": 7, "ymax": 8}]}),
        "table.csv": "ymax,name,xmin,ymin,xmax\r\n40,core,1,2,30.5\n8,,5,6,7\n\n",
    }
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
        assert [tuple(r) for r in artifacts.read_regions(spark, f"file://{tmp_path}/{name}").orderBy("ord").collect()] == want, name
    (tmp_path / "empty.json").write_text("[]")
    assert artifacts.read_regions(spark, f"file://{tmp_path}/empty.json").count() == 0


def test_factor_fractions(spark):
    run = spark.createDataFrame([("m1", 9, 0.25, 0.75, "x"), ("m2", 4, 1.0, 0.0, "y")], "cell_id string, transcript_count int, factor_1_fraction double, factor_2_fraction double, other string")
    types = spark.createDataFrame([("m1", "duct"), ("m1", "duct"), ("m9", "islet")], "cell_id string, cell_type string")
    assert {tuple(r) for r in artifacts.factor_fractions(run, [2]).collect()} == {("m1", 9, 0.75), ("m2", 4, 0.0)}
    assert {tuple(r) for r in artifacts.factor_fractions(run, [1, 2], types).collect()} == {("m1", 9, 0.25, 0.75, "duct"), ("m2", 4, 1.0, 0.0, None)}


def test_priors_go_there_and_back(spark):
    alpha = spark.createDataFrame([("duct \"A\"", 1, 0.25), ("duct \"A\"", 2, 0.75), ("islet", 1, 1.0)], "cell_type string, factor int, alpha double")
    noise = spark.createDataFrame([("all", 0.125)], "part string, share double")
    text = artifacts.priors_json({"alpha": (alpha, ["cell_type", "factor"], "alpha"), "noise": (noise, ["part"], "share")})
    assert json.loads(text.first()["json"]) == {"alpha": {"duct \"A\"": {"1": 0.25, "2": 0.75}, "islet": {"1": 1.0}}, "noise": {"all": 0.125}}
    back = artifacts.read_prior(text, "alpha", ["cell_type", "factor"], "alpha")
    assert {tuple(r) for r in back.collect()} == {(t, str(f), a) for t, f, a in alpha.collect()}
