"""JSON artifacts in bulk: their kinds, what breaks the kind's rules, what they say, and the crops of crop manifests.

An artifact is a row (path, text), so that a folder of any number of them is one scan: ``spark.read.text(folder, wholetext=True)``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "0.1.0"
# Fixed values of the format.  The type of each kind, after its namespace and a dot; a model names it as model_type.
TYPES = {
    "crop": "crop_manifest.v0",
    "model": "parametric_stain_v0",
    "synthetic": "synthetic_manifest.v0",
    "fit-report": "fit_report.v0",
    "qc-report": "qc_report.v0",
    "training-report": "tiny_renderer_training.v0",
    "background-profile": "background_profile.v0",
    "anchor-profile": "anchor_profile.v0",
    "scene-fit": "scene_fit.v0",
    "scene-summary": "scene_probe_summary.v0",
    "scene-review": "scene_review.v0",
    "cell-appearance-benchmark": "cell_appearance_benchmark.v0",
    "cell-flow-corpus": "cell_flow_corpus.v0",
    "cell-flow-training": "cell_flow_training.v0",
    "cell-flow-sweep": "cell_flow_sweep.v0",
    "mechanistic-refiner-corpus": "mechanistic_refiner_corpus.v0",
    "mechanistic-refiner-training": "mechanistic_refiner_training.v0",
    "mechanistic-refiner-samples": "mechanistic_refiner_samples.v0",
    "mechanistic-refiner-eval": "mechanistic_refiner_eval.v0",
}
# The keys that an artifact of a kind must have.
KEYS = {
    "crop": "bundle image_channels num_crops crop_selection split_path split_method crops",
    "model": "image_channels channel_stats source_manifest device",
    "synthetic": "model_path image_channels samples",
    "fit-report": "source_manifest image_channels channel_stats real_summary",
    "qc-report": "manifest_path records",
    "training-report": "source_manifest checkpoint_path steps losses final_loss",
    "background-profile": "source_manifest empirical_model records sheets",
    "anchor-profile": "source_manifest image_channels num_crops_profiled num_anchors all_anchor_summary high_quality_anchor_summary shape_priors emission_priors records",
    "scene-fit": "source_manifest anchor_profile crop_id mode arrays_path compare_sheet metrics component_summary",
    "scene-summary": "scene_fit_paths num_scene_fits aggregate records",
    "scene-review": "sheet_path num_rows selection_groups rows",
    "cell-appearance-benchmark": "source_anchor_profile evaluation_frame quality_filter feature_names holdout reference_summary heldout_summary heldout_vs_reference",
    "cell-flow-corpus": "source_anchor_profile source_manifest npz_path image_channels condition_channels patch_size num_patches records",
    "cell-flow-training": "source_corpus checkpoint_path steps batch_size device losses final_loss model",
    "cell-flow-sweep": "checkpoint_path anchor_profile_path selection_objective base_sample_options benchmark_options num_candidates best_candidate ranking candidates",
    "mechanistic-refiner-corpus": "source_manifest mechanistic_render_manifest npz_path image_channels condition_channels target_channels num_examples records split_counts support_masks",
    "mechanistic-refiner-training": "source_corpus checkpoint_path steps losses final_loss model",
    "mechanistic-refiner-samples": "source_corpus checkpoint_path npz_path num_samples records",
    "mechanistic-refiner-eval": "source_corpus source_samples patch_size patch_stride num_real_patches num_refined_patches paired_metrics spectrum anisotropy dino",
}
# Keys that hold a list, keys that hold an object.
LISTS = {
    "crop": "crops", "model": "channel_stats", "synthetic": "samples", "scene-summary": "scene_fit_paths records", "scene-review": "rows",
    "cell-appearance-benchmark": "feature_names", "cell-flow-corpus": "records", "cell-flow-training": "losses", "cell-flow-sweep": "candidates ranking",
    "mechanistic-refiner-corpus": "records condition_channels", "mechanistic-refiner-training": "losses", "mechanistic-refiner-samples": "records",
}
OBJECTS = {"scene-summary": "aggregate", "scene-review": "selection_groups", "cell-appearance-benchmark": "holdout", "cell-flow-sweep": "best_candidate"}
# Pairs of a number (or list) and the list whose length it must be.
LENGTHS = {
    "scene-summary": "num_scene_fits=records scene_fit_paths=records", "scene-review": "num_rows=rows", "cell-flow-corpus": "num_patches=records",
    "cell-flow-sweep": "num_candidates=candidates ranking=candidates", "mechanistic-refiner-corpus": "num_examples=records", "mechanistic-refiner-samples": "num_samples=records",
}
# Keys of an object inside, as object.key; keys that every item of a list must have, as list.key.
INSIDE = {
    "scene-summary": "aggregate.total_candidates aggregate.total_accepted_candidates aggregate.mae_reduction",
    "cell-appearance-benchmark": "holdout.num_reference_anchors holdout.num_heldout_anchors",
    "cell-flow-sweep": "best_candidate.name best_candidate.slug best_candidate.metrics",
}
ITEMS = {"crop": ("crops", "crop_id crop_box npz_path split qc"), "synthetic": ("samples", "sample_id npz_path latent image_channels")}
SPLITS = ("train", "val", "test")
# Keys that name a file beside the artifact, and keys that name one by its own path; those with a question mark may lack.
BESIDE = {"crop": "split_path", "cell-flow-corpus": "npz_path", "mechanistic-refiner-corpus": "npz_path", "mechanistic-refiner-samples": "npz_path", "mechanistic-refiner-eval": "sheet_path? rgb_sheet_path?"}
ELSEWHERE = {"model": "source_manifest", "mechanistic-refiner-corpus": "source_manifest mechanistic_render_manifest"}
FRAME = "population_anchor_feature_distribution_v0"
TARGETS = (["dapi", "membrane"], ["dapi", "membrane", "polya"])
# What a summary tells of a kind; of a list its length.
FACTS = {
    "crop": "crops image_channels split_method", "synthetic": "samples image_channels", "model": "image_channels source_manifest", "fit-report": "num_crops", "qc-report": "num_records",
    "training-report": "steps checkpoint_path", "background-profile": "num_crops_profiled", "anchor-profile": "num_crops_profiled num_anchors num_high_quality_anchors",
    "scene-fit": "crop_id mode image_channels latent_cell_budget num_latent_cells arrays_path compare_sheet", "scene-summary": "num_scene_fits", "scene-review": "num_rows sheet_path scene_summary scene_fit review_mode",
    "cell-appearance-benchmark": "quality_filter", "cell-flow-corpus": "num_patches patch_size image_channels target_mode", "cell-flow-training": "steps checkpoint_path final_loss target_mode",
    "cell-flow-sweep": "num_candidates", "mechanistic-refiner-corpus": "num_examples condition_channels target_channels npz_path", "mechanistic-refiner-training": "source_corpus checkpoint_path steps",
    "mechanistic-refiner-samples": "source_corpus num_samples npz_path",
}

_BAD = "array<struct<rule:string,detail:string>>"


def read_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the JSON files in a folder and those below it."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return files.select(local(F.input_file_name()).alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all files in a folder and those below it; no contents are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(local(F.col("path")).alias("path"))


def local(path: Column) -> Column:
    """A path without the scheme of local files, however many slashes follow it."""
    return F.regexp_replace(path, "^file:/+", "/")


def _of(table: dict[str, str]) -> Column:
    """The words that a table has for the row's kind, none where it has none."""
    words = F.create_map(*(c for k, v in table.items() for c in (F.lit(k), F.lit(v))))
    return F.coalesce(F.split(F.element_at(words, F.col("kind")), " "), F.array().cast("array<string>"))


def _at(m: Column, key: Column) -> Column:
    return F.element_at(m, key)


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _number(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "bigint"), F.size(_list(v)).cast("bigint"))


def _all(words: Column, rule: str, broken) -> Column:  # noqa: ANN001
    """Of the words those that are broken, as violations of a rule."""
    return F.transform(F.filter(words, broken), lambda w: F.struct(F.lit(rule).alias("rule"), w.alias("detail")))


def _one(broken: Column, rule: str, detail: Column) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.array(F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))).otherwise(F.array().cast(_BAD))


def parsed(texts: DataFrame, namespace: str | None = None) -> DataFrame:
    """(path, kind, m): each artifact's top level as a map, null where the text is not a JSON object; kind is null where its type is not known.

    With a namespace, types of another one are not known.
    """
    m = _object(F.try_parse_json("text"))
    kinds = F.create_map(*(F.lit(x) for k, t in TYPES.items() if k != "model" for x in (t, k)))
    split = lambda t: (F.regexp_extract(t, r"^([^.]*)\.(.*)$", 1), F.regexp_extract(t, r"^([^.]*)\.(.*)$", 2))
    out = texts.select("path", m.alias("m"))
    (space, name), (model_space, model) = (split(F.coalesce(_text(_at(F.col("m"), F.lit(k))), F.lit(""))) for k in ("type", "model_type"))
    mine = lambda s: F.lit(True) if namespace is None else s == namespace
    kind = F.coalesce(F.when(mine(space), _at(kinds, name)), F.when((model == TYPES["model"]) & mine(model_space), "model"))
    return out.select("path", kind.alias("kind"), "m")


def violations(texts: DataFrame, files: DataFrame | None = None, namespace: str | None = None) -> DataFrame:
    """(path, kind, rule, detail): everything in which artifacts (path, text) break the rules of their kind; nothing for those that are right.

    With files (path), the files that artifacts name must be among them.  A text that is null or not a JSON object breaks
    ``object``; one of an unknown type breaks ``type``; rules on a value hold where the value is there.  Equal rows are reported each.
    """
    p = parsed(texts, namespace)
    m, kind = F.col("m"), F.col("kind")
    keys, value = F.map_keys("m"), lambda k: _at(m, F.lit(k))
    shape = lambda k: F.coalesce(F.schema_of_variant(_at(m, k)), F.lit(""))
    has = lambda k: F.array_contains(keys, k)
    part = lambda w, i: F.split_part(w, F.lit("."), F.lit(i))
    pair = lambda w, i: F.split_part(w, F.lit("="), F.lit(i))
    inner = lambda w: _object(_at(m, part(w, 1)))
    size = lambda k: F.size(_list(_at(m, k))).cast("bigint")
    targets = F.try_variant_get(value("target_channels"), "$", "array<string>")
    version = _text(value("schema_version"))
    known = [
        _one(~version.eqNullSafe(F.lit(SCHEMA_VERSION)), "schema_version", F.coalesce(version, F.lit("none"))),
        _all(_of(KEYS), "key", lambda k: ~has(k)),
        _all(_of(LISTS), "list", lambda k: has(k) & ~shape(k).startswith("ARRAY")),
        _all(_of(OBJECTS), "object", lambda k: has(k) & ~shape(k).startswith("OBJECT")),
        _all(_of(LENGTHS), "length", lambda w: F.coalesce(_number(_at(m, pair(w, 1))) != size(pair(w, 2)), has(pair(w, 1)) & size(pair(w, 2)).isNotNull())),
        _all(_of(INSIDE), "key", lambda w: inner(w).isNotNull() & ~F.array_contains(F.map_keys(inner(w)), part(w, 2))),
        _one((kind == "scene-review") & ~has("scene_summary") & ~has("scene_fit"), "key", F.lit("scene_summary or scene_fit")),
        _one((kind == "cell-appearance-benchmark") & has("evaluation_frame") & ~_text(value("evaluation_frame")).eqNullSafe(F.lit(FRAME)), "value", F.lit("evaluation_frame")),
        _one((kind == "mechanistic-refiner-corpus") & (F.size(_list(value("condition_channels"))) == 0), "value", F.lit("condition_channels")),
        _one((kind == "mechanistic-refiner-corpus") & has("target_channels") & ~F.coalesce(targets.isin(*(F.array(*map(F.lit, t)) for t in TARGETS)), F.lit(False)), "value", F.lit("target_channels")),
    ]
    bad = F.when(m.isNull(), F.array(F.struct(F.lit("object").alias("rule"), F.lit("text").alias("detail"))))
    bad = bad.when(kind.isNull(), F.array(F.struct(F.lit("type").alias("rule"), F.coalesce(_text(value("type")), _text(value("model_type")), F.lit("none")).alias("detail"))))
    whole = p.select("path", "kind", F.inline(bad.otherwise(F.concat(*known))))

    items = _items(p)
    lacks = items.select("path", "kind", F.inline(F.concat(
        _all(F.col("keys"), "key", lambda k: ~F.coalesce(F.array_contains(F.map_keys("item"), k), F.lit(False))),
        _one((kind == "crop") & F.array_contains(F.map_keys("item"), "split") & ~F.coalesce(_text(_at(F.col("item"), F.lit("split"))).isin(*SPLITS), F.lit(False)), "split", F.coalesce(_text(_at(F.col("item"), F.lit("split"))), F.lit("none"))),
    )), "ord")
    out = [whole, lacks.select("path", "kind", "rule", F.concat(F.col("ord"), F.lit(":"), F.col("detail")).alias("detail"))]
    if files is not None:
        out.append(_missing(p, items, files))
    return reduce(DataFrame.unionByName, out)


def _items(p: DataFrame) -> DataFrame:
    """(path, kind, ord, item, keys) of the lists whose items have keys of their own; item is null where it is not an object."""
    named = F.create_map(*(c for k, (name, _) in ITEMS.items() for c in (F.lit(k), F.lit(name))))
    rows = p.where(F.col("kind").isin(*ITEMS)).select("path", "kind", F.posexplode(_list(_at(F.col("m"), _at(named, F.col("kind"))))).alias("ord", "v"))
    return rows.select("path", "kind", "ord", _object(F.col("v")).alias("item"), _of({k: words for k, (_, words) in ITEMS.items()}).alias("keys"))


def _missing(p: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """Files that artifacts name and that are not there, one anti join for all of them."""
    folder = F.regexp_extract(F.col("path"), "^(.*/)?", 0)
    m, bare = F.col("m"), lambda w: F.regexp_replace(w, r"\?", "")
    named = lambda table, prefix: F.transform(_of(table), lambda w: F.struct(bare(w).alias("detail"), F.concat(prefix, F.nullif(_text(_at(m, bare(w))), F.lit(""))).alias("file")))
    asked = p.select("path", "kind", F.inline(F.concat(named(BESIDE, folder), named(ELSEWHERE, F.lit("")))))
    item_file = F.concat(folder, F.nullif(_text(_at(F.col("item"), F.lit("npz_path"))), F.lit("")))
    asked = asked.unionByName(items.select("path", "kind", F.concat(F.col("ord"), F.lit(":npz_path")).alias("detail"), item_file.alias("file"))).where("file is not null")
    asked = asked.withColumn("file", local(F.col("file")))
    return asked.join(files.select(F.col("path").alias("file")), "file", "left_anti").select("path", "kind", F.lit("file").alias("rule"), "detail")


def summaries(texts: DataFrame, files: DataFrame | None = None, namespace: str | None = None) -> DataFrame:
    """(path, kind, schema_version, valid, n_violations, facts) of artifacts; facts names what a kind tells, of lists their length, all as text."""
    m = F.col("m")
    shown = lambda k: F.coalesce(F.size(_list(_at(m, k))).cast("string"), _text(_at(m, k)))
    facts = F.map_from_arrays(_of(FACTS), F.transform(_of(FACTS), shown))
    n = violations(texts, files, namespace).groupBy("path").agg(F.count(F.lit(1)).alias("n_violations"))
    said = parsed(texts, namespace).select("path", "kind", _text(_at(m, F.lit("schema_version"))).alias("schema_version"), facts.alias("facts"))
    n_bad = F.coalesce("n_violations", F.lit(0))
    return said.join(n, "path", "left").select("path", "kind", "schema_version", (n_bad == 0).alias("valid"), n_bad.alias("n_violations"), "facts")


CROP = (
    "struct<crop_id:string,crop_box:struct<xmin:double,xmax:double,ymin:double,ymax:double>,npz_path:string,split:string,image_channels:array<string>,"
    "transcript_count:bigint,assigned_transcript_count:bigint,cell_count:bigint,nucleus_count:bigint,qc:map<string,string>>"
)
EDGES = ("xmin", "xmax", "ymin", "ymax")
COUNTS = ("transcript_count", "assigned_transcript_count", "cell_count", "nucleus_count")


def crop_records(texts: DataFrame) -> DataFrame:
    """The crops of crop manifests (path, text): manifest, ord, crop_id, the four edges, npz_path (beside the manifest), split, image_channels, counts (0 if none), qc."""
    rows = texts.select("path", F.posexplode(F.from_json("text", f"struct<crops:array<{CROP}>>")["crops"]).alias("ord", "c"))
    edges = [F.col(f"c.crop_box.{e}").alias(e) for e in EDGES]
    beside = F.when(F.col("c.npz_path").startswith("/"), F.col("c.npz_path")).otherwise(F.concat(F.regexp_extract("path", "^(.*/)?", 0), F.col("c.npz_path")))
    return rows.select(
        F.col("path").alias("manifest"), "ord", "c.crop_id", *edges, beside.alias("npz_path"), "c.split", F.coalesce("c.image_channels", F.array().cast("array<string>")).alias("image_channels"),
        *(F.coalesce(f"c.{n}", F.lit(0)).alias(n) for n in COUNTS), F.coalesce("c.qc", F.create_map().cast("map<string,string>")).alias("qc"),
    )


def crop_manifest(crops: DataFrame, namespace: str, head: dict[str, object]) -> DataFrame:
    """One row, ``text``: the manifest of chosen crops (crop_id, four edges, npz_path, split, image_channels, counts, qc), in order of their ids.

    head holds the other keys (bundle, image_channels, crop_selection, split_method and more).  A manifest is one file, so its crops
    meet in one row: crops are what a selection chose, not what a table holds.
    """
    box = F.struct(*EDGES).alias("crop_box")
    one = F.struct("crop_id", box, "npz_path", "split", "image_channels", *COUNTS, "qc")
    lead = json.dumps({"type": f"{namespace}.{TYPES['crop']}", "schema_version": SCHEMA_VERSION, "split_path": "splits.json"} | head, sort_keys=True)[:-1]
    before = lambda a, b: F.when(a["crop_id"] < b["crop_id"], -1).when(a["crop_id"] > b["crop_id"], 1).otherwise(0)
    listed = crops.agg(F.array_sort(F.collect_list(one), before).alias("crops"))  # a map (qc) has no order of its own
    return listed.select(F.concat(F.lit(lead), F.lit(', "num_crops": '), F.size("crops").cast("string"), F.lit(', "crops": '), F.to_json("crops"), F.lit("}")).alias("text"))
