"""Rules of tables and of JSON artifacts against plain Python."""

import json

import pytest

from cellspan.operators import contracts
from cellspan.operators.contracts import Rule
from cellspan.sources import manifests


def _found(df):
    return {r["rule"]: (r["n"], r["sample"]) for r in df.collect()}


def test_rules_on_rows_keys_and_references(spark):
    rows = [(1, "a", 1.0, "x"), (2, " ", 0.0, "y"), (3, None, -2.0, None), (4, "b", float("nan"), "x"), (5, "b", 0.5, "z")]
    df = spark.createDataFrame(rows, "id int, name string, v double, kind string")
    others = {"kinds": spark.createDataFrame([("x",), ("y",)], "kind string")}
    rules = [
        Rule("required", "name"), Rule("positive", "v"), Rule("not_negative", "v"), Rule("fraction", "v"), Rule("member", "kind", ("x", "y")), Rule("matches", "name", "^[ab]$"),
        Rule("holds", "id < 5", name="early"), Rule("unique", "name"), Rule("unique", "name, kind"), Rule("reference", "kind", "kinds"),
    ]
    assert _found(contracts.check(df, rules, "id", others)) == {
        "required:name": (2, "2"), "positive:v": (3, "2"), "not_negative:v": (2, "3"), "fraction:v": (2, "3"), "member:kind": (2, "3"), "matches:name": (2, "2"),
        "early": (1, "5"), "unique:name": (1, "b"), "unique:name, kind": (0, None), "reference:kind": (1, "5"),
    }
    empty = contracts.check(df.limit(0), rules, "id", others)
    assert set(_found(empty).values()) == {(0, None)}
    contracts.require(empty)
    with pytest.raises(ValueError, match="early: 1 rows, such as 5"):
        contracts.require(contracts.check(df, rules, "id", others))


def _good():
    """One artifact without a fault for each kind: every key there, lists of two, numbers that agree."""
    out = {}
    for kind, name in manifests.TYPES.items():
        obj = {k: f"some {k}" for k in manifests.KEYS[kind].split()}
        obj |= {"schema_version": manifests.SCHEMA_VERSION, ("model_type" if kind == "model" else "type"): f"lab.{name}"}
        for k in manifests.LISTS.get(kind, "").split():
            obj[k] = [{"n": 1}, {"n": 2}]
        for k in manifests.OBJECTS.get(kind, "").split():
            obj[k] = {}
        for w in manifests.INSIDE.get(kind, "").split():
            obj[w.split(".")[0]][w.split(".")[1]] = None
        for w in manifests.LENGTHS.get(kind, "").split():
            a = w.split("=")[0]
            obj[a] = obj[a] if isinstance(obj[a], list) else 2
        if kind in manifests.ITEMS:
            name, keys = manifests.ITEMS[kind]
            obj[name] = [{k: f"{k}{i}" for k in keys.split()} | ({"split": "val"} if kind == "crop" else {}) for i in range(2)]
        out[kind] = obj
    out["scene-review"]["scene_fit"] = "fit.json"
    out["cell-appearance-benchmark"]["evaluation_frame"] = manifests.FRAME
    out["mechanistic-refiner-corpus"]["target_channels"] = ["dapi", "membrane"]
    return out


def _check(spark, artifacts, files=None):
    df = spark.createDataFrame([(k, v if isinstance(v, str) or v is None else json.dumps(v)) for k, v in artifacts.items()], "path string, text string")
    files = None if files is None else spark.createDataFrame([(f,) for f in files], "path string")
    return df, files, sorted((r["path"], r["kind"], r["rule"], r["detail"]) for r in manifests.violations(df, files).collect())


def test_every_kind_without_a_fault_passes_and_each_missing_key_is_found(spark):
    good = _good()
    assert len(good) == 19 and _check(spark, good)[2] == []
    cut = {f"{kind}/{k}": {a: b for a, b in obj.items() if a != k} for kind, obj in good.items() for k in manifests.KEYS[kind].split()}
    found = {(p, d) for p, _, rule, d in _check(spark, cut)[2] if rule == "key"}
    assert {(p, p.split("/")[1]) for p in cut} <= found


def test_faults_of_artifacts(spark):
    g = _good()
    crop, review, sweep, corpus = g["crop"], g["scene-review"], g["cell-flow-sweep"], g["mechanistic-refiner-corpus"]
    bad = {
        "a": None, "b": "[1]", "c": "{", "d": {"type": "lab.other.v0"}, "e": {"x": 1},
        "f": crop | {"schema_version": "0.0.9"}, "g": crop | {"crops": {}}, "h": crop | {"crops": [crop["crops"][0], {"crop_id": 1, "crop_box": 2, "npz_path": "q", "split": "dev", "qc": {}}, 7]},
        "i": {k: v for k, v in review.items() if k != "scene_fit"}, "j": review | {"num_rows": 3}, "k": review | {"num_rows": "x"}, "l": sweep | {"ranking": [1]}, "m": sweep | {"best_candidate": {"name": 1, "slug": 2}},
        "n": corpus | {"target_channels": ["dapi"]}, "o": corpus | {"condition_channels": []}, "p": g["cell-appearance-benchmark"] | {"evaluation_frame": "other"}, "q": review | {"selection_groups": []},
    }
    assert _check(spark, bad)[2] == sorted([
        ("a", None, "object", "text"), ("b", None, "object", "text"), ("c", None, "object", "text"), ("d", None, "type", "lab.other.v0"), ("e", None, "type", "none"),
        ("f", "crop", "schema_version", "0.0.9"), ("g", "crop", "list", "crops"), ("h", "crop", "split", "1:dev"), *(("h", "crop", "key", f"2:{k}") for k in manifests.ITEMS["crop"][1].split()),
        ("i", "scene-review", "key", "scene_summary or scene_fit"), ("j", "scene-review", "length", "num_rows=rows"), ("k", "scene-review", "length", "num_rows=rows"),
        ("l", "cell-flow-sweep", "length", "ranking=candidates"), ("m", "cell-flow-sweep", "key", "best_candidate.metrics"), ("n", "mechanistic-refiner-corpus", "value", "target_channels"),
        ("o", "mechanistic-refiner-corpus", "value", "condition_channels"), ("p", "cell-appearance-benchmark", "value", "evaluation_frame"), ("q", "scene-review", "object", "selection_groups"),
    ], key=lambda r: (r[0], r[1] or "", r[2], r[3]))


def test_files_namespaces_and_summaries(spark):
    g = _good()
    arts = {"/r/a.json": g["crop"] | {"split_path": "splits.json"}, "/r/b/m.json": g["model"] | {"source_manifest": "/r/a.json"}, "/r/b/e.json": g["mechanistic-refiner-eval"] | {"sheet_path": "none.png"}}
    df, files, found = _check(spark, arts, ["/r/splits.json", "/r/npz_path0", "/r/a.json"])
    assert found == [("/r/a.json", "crop", "file", "1:npz_path"), ("/r/b/e.json", "mechanistic-refiner-eval", "file", "sheet_path")]
    assert {r["kind"] for r in manifests.parsed(df, "elsewhere").collect()} == {None} and {r["kind"] for r in manifests.parsed(df, "lab").collect()} == {"crop", "model", "mechanistic-refiner-eval"}
    said = {r["kind"]: r for r in manifests.summaries(df, files).collect()}
    assert (said["crop"]["valid"], said["crop"]["n_violations"], said["crop"]["facts"]["crops"]) == (False, 1, "2") and said["model"]["valid"]
    assert manifests.violations(df.limit(0), files).count() == 0


def test_crop_manifest_round_trip(spark, tmp_path):
    rows = [("c2", 0.0, 1.0, 2.0, 3.0, "crops/c2.npz", "val", ["dapi"], 5, 4, 3, 2, {"source": "polygon"}), ("c1", 4.0, 5.0, 6.0, 7.0, "crops/c1.npz", "train", ["dapi"], 0, 0, 0, 0, {})]
    columns = ["crop_id", *manifests.EDGES, "npz_path", "split", "image_channels", *manifests.COUNTS, "qc"]
    crops = spark.createDataFrame(rows, "crop_id string, xmin double, xmax double, ymin double, ymax double, npz_path string, split string, image_channels array<string>, transcript_count bigint, assigned_transcript_count bigint, cell_count bigint, nucleus_count bigint, qc map<string,string>")
    text = manifests.crop_manifest(crops, "lab", {"bundle": {"root": "x"}, "image_channels": ["dapi"], "crop_selection": {"mode": "grid"}, "split_method": "checkerboard"}).first()["text"]
    assert json.loads(text)["num_crops"] == 2
    (tmp_path / "manifest.json").write_text(text)
    read = manifests.read_artifacts(spark, str(tmp_path))
    assert manifests.violations(read).count() == 0
    missing = manifests.violations(read, manifests.list_files(spark, str(tmp_path))).collect()
    assert sorted(r["detail"] for r in missing) == ["0:npz_path", "1:npz_path", "split_path"]
    got = manifests.crop_records(read).orderBy("ord").select(*columns).collect()
    assert [tuple(r) for r in got] == [tuple(str(tmp_path / v) if c == "npz_path" else v for c, v in zip(columns, r, strict=True)) for r in sorted(rows, key=lambda r: r[0])]
