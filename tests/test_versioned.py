"""Versioned tables and the strips of a stream."""

import random

import pytest
from pyspark.sql import functions as F

from cellspan.sources import versioned
from cellspan.streaming import strips


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "cell_id string, z double")


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/z"
    assert versioned.read(spark, folder) is None and versioned.vacuum(spark, folder) == 0
    first = versioned.upsert(rows(spark, ("a", 1.0), ("b", 2.0)), folder, "cell_id")
    assert first == versioned.current(spark, folder) and first.state == "partial"
    old = versioned.read(spark, folder)
    second = versioned.upsert(rows(spark, ("b", 5.0), ("c", 3.0)), folder, "cell_id")
    assert (second.number, second.state) == (2, "partial")
    # A reader that began before the swap still finds its table; a new one the new rows.
    assert content(old) == [("a", 1.0), ("b", 2.0)]
    assert content(versioned.read(spark, folder)) == [("a", 1.0), ("b", 5.0), ("c", 3.0)]
    # A second writer on the same base is refused, and leaves nothing behind.
    before = len(list((tmp_path / "z").iterdir()))
    with pytest.raises(versioned.LostRace):
        versioned.publish(rows(spark, ("x", 0.0)), folder, "complete", "cell_id", first)
    assert len(list((tmp_path / "z").iterdir())) == before
    # A writer that died before its pointer was whole doesn't exist.
    (tmp_path / "z" / "_v000000000003.json").write_text('{"numb')
    assert versioned.current(spark, folder) == second
    with pytest.raises(versioned.LostRace):
        versioned.upsert(rows(spark, ("d", 1.0)), folder, "cell_id")
    (tmp_path / "z" / "_v000000000003.json").unlink()
    assert versioned.upsert(rows(spark, ("d", 1.0)), folder, "cell_id", "complete").number == 3
    assert versioned.vacuum(spark, folder, 1) == 2
    assert content(versioned.read(spark, folder)) == [("a", 1.0), ("b", 5.0), ("c", 3.0), ("d", 1.0)]
    assert sorted(p.name[:5] for p in (tmp_path / "z").iterdir() if not p.name.startswith(".")) == ["_v000", "rows-"]
    with pytest.raises(ValueError):
        versioned.publish(rows(spark), folder, "half", "cell_id", None)


def test_load_or_fit(spark, tmp_path):
    folder, asked = f"file://{tmp_path}/cache", []
    whole = spark.createDataFrame([(f"c{i}", float(i)) for i in range(100)], "cell_id string, x double")

    def fit(box):
        asked.append(box)
        return whole if box is None else whole.where((F.col("x") >= box[0]) & (F.col("x") <= box[1]))

    get = lambda region=None: versioned.load_or_fit(spark, folder, "cell_id", fit, region, 5.0).count()
    assert get((10, 20, 0, 0)) == 21 and get((50, 50, 0, 0)) == 32
    assert versioned.current(spark, folder).state == "partial"
    assert get() == 100 and get((10, 20, 0, 0)) == 100 and get() == 100
    assert asked == [(5, 25, -5.0, 5.0), (45, 55, -5.0, 5.0), None]


@pytest.mark.parametrize("tail", [False, True])
def test_strips_of_a_stream(spark, tmp_path, tail):
    """Tiles in any order, some twice, in three runs that each restart from the checkpoint: every strip once, and as in the batch form."""
    rng = random.Random(7)
    tiles = [(t, float(t)) for t in range(6 * 5)]
    order = [*tiles, *rng.sample(tiles, 9), (99, 1.0), (-1, 1.0)]
    rng.shuffle(order)
    out, counts = f"file://{tmp_path}/out", []
    for k in range(3):
        spark.createDataFrame(order[k * 14 : (k + 1) * 14 if k < 2 else None], "tile bigint, value double").write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("tile bigint, value double").parquet(f"file://{tmp_path}/in")
        strips.write_ready(stream, out, f"file://{tmp_path}/checkpoint", 6, 5, tail).awaitTermination()
        got = spark.read.schema(strips.OUT).parquet(out)
        counts.append(got.count())
        so_far = spark.read.parquet(f"file://{tmp_path}/in")
        assert content(got) == content(strips.ready(so_far, 6, 5, tail))
    assert counts[-1] == (7 if tail else 6) and counts == sorted(counts)
