"""Tables in versions: a folder of each version and a pointer file that names it, so that a reader always finds a whole one.

A version's rows are written first, to a folder that nobody reads; the pointer file of its number comes last and is created only if
no other writer has made it.  Readers take the highest pointer that they can parse.  A cache is such a table with a state:
``complete`` covers everything, ``partial`` what has been asked for so far.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.sources.bundle import _fs

STATES = ("partial", "complete")


class Version(NamedTuple):
    number: int
    state: str
    path: str


class LostRace(RuntimeError):
    """Another writer has published a version since the one that this write builds on."""


def _pointer(number: int) -> str:
    return f"_v{number:012d}.json"


def versions(spark: SparkSession, folder: str) -> list[Version]:
    """All published versions, the newest last; a pointer that is not (yet) whole doesn't count."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    out = []
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if name.startswith("_v") and name.endswith(".json"):
            stream = fs.open(f.getPath())
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                v = json.loads(text)
            except ValueError:
                continue
            out.append(Version(v["number"], v["state"], f"{folder}/{v['rows']}"))
    return sorted(out)


def current(spark: SparkSession, folder: str) -> Version | None:
    found = versions(spark, folder)
    return found[-1] if found else None


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of the newest version; None where there is none."""
    v = current(spark, folder)
    return spark.read.parquet(v.path) if v else None


def publish(df: DataFrame, folder: str, state: str, key: str, base: Version | None) -> Version:
    """df, sorted by key within files, as the version after ``base`` (None: the first); LostRace if there is a newer one than base."""
    if state not in STATES:
        raise ValueError(f"state must be one of {', '.join(STATES)}")
    spark = df.sparkSession
    number = base.number + 1 if base else 1
    rows = f"rows-{number:012d}-{uuid.uuid4().hex}"
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(f"{folder}/{rows}")
    now = current(spark, folder)
    fs, p = _fs(spark, f"{folder}/{_pointer(number)}")
    try:
        if (now.number if now else 0) != number - 1:
            raise LostRace(f"{folder} is at version {now.number if now else 0}, not {number - 1}")
        try:
            out = fs.create(p, False)  # not over an existing one
        except Exception as e:
            raise LostRace(f"version {number} of {folder} has been taken") from e
    except LostRace:
        fs.delete(_fs(spark, f"{folder}/{rows}")[1], True)
        raise
    out.write(bytearray(json.dumps({"number": number, "state": state, "rows": rows}).encode()))
    out.close()
    return Version(number, state, f"{folder}/{rows}")


def upsert(df: DataFrame, folder: str, key: str, state: str | None = None) -> Version:
    """A new version in which the rows of df replace those of the same key; the state stays as it is (partial at first) if None."""
    spark = df.sparkSession
    base = current(spark, folder)
    if base is None:
        return publish(df, folder, state or "partial", key, None)
    kept = spark.read.parquet(base.path).join(df.select(key), key, "left_anti")
    return publish(kept.unionByName(df), folder, state or base.state, key, base)


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete all versions but the newest ``keep``, and rows that no pointer names; how many versions went.  For when nobody writes."""
    found = versions(spark, folder)
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return 0
    gone = found[:-keep] if keep else found
    for v in gone:
        fs.delete(_fs(spark, f"{folder}/{_pointer(v.number)}")[1], False)
    named = {v.path.rpartition("/")[2] for v in found[len(gone) :]}
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if name.startswith("rows-") and name not in named:
            fs.delete(f.getPath(), True)
    return len(gone)


def load_or_fit(spark: SparkSession, folder: str, key: str, fit: Callable[[tuple | None], DataFrame], region: tuple | None = None, halo: float = 25.0) -> DataFrame:
    """The cached table, fitted where it is missing.

    A complete cache serves everything.  With a region (xmin, xmax, ymin, ymax) and no complete cache, fit(region and halo) is merged in
    as partial; without one, fit(None) is the whole and makes the cache complete.
    """
    base = current(spark, folder)
    if base and base.state == "complete":
        return spark.read.parquet(base.path)
    if region is None:
        return spark.read.parquet(publish(fit(None), folder, "complete", key, base).path)
    xmin, xmax, ymin, ymax = region
    return spark.read.parquet(upsert(fit((xmin - halo, xmax + halo, ymin - halo, ymax + halo)), folder, key, "partial").path)
