"""Strips of a tiled image that are ready as their tiles arrive, in any order, each once.

Tiles lie in rows that overlap: strip s needs all tiles of rows s - 1 and s, the first and the last one those of a single row.
Every strip is a key with a state of its own: the tiles seen so far.  A tile that comes again, or after a restart, changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "strip bigint, tiles bigint, total double"


def by_strip(tiles: DataFrame, rows: int, columns: int, tail: bool) -> DataFrame:
    """(strip, tile, value, needed) for the one or two strips that each tile (tile, value) serves; tiles outside the grid go.

    tail: there is a strip below the last row.  needed: tiles of the strip.
    """
    row = F.floor(F.col("tile") / columns).cast("long")
    good = tiles.where((F.col("tile") >= 0) & (F.col("tile") < rows * columns))
    both = good.select("tile", F.col("value").cast("double").alias("value"), F.explode(F.array(row, row + 1)).alias("strip"))
    last = rows if tail else rows - 1
    needed = F.when((F.col("strip") == 0) | (F.col("strip") == rows), columns).otherwise(2 * columns)
    return both.where(F.col("strip") <= last).withColumn("needed", needed.cast("long"))


def ready(tiles: DataFrame, rows: int, columns: int, tail: bool = False) -> DataFrame:
    """(strip, tiles, total) of the strips all of whose tiles are there: the batch form.  Of a repeated tile the least value counts."""
    one = by_strip(tiles, rows, columns, tail).groupBy("strip", "needed", "tile").agg(F.min("value").alias("value"))
    s = one.groupBy("strip", "needed").agg(F.count(F.lit(1)).alias("tiles"), F.sum("value").alias("total"))
    return s.where(F.col("tiles") == F.col("needed")).drop("needed")


def _arrive(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: tiles seen and their values; both empty, with done set, once the strip is out."""
    seen, values, done = state.get if state.exists else ([], [], False)
    held = dict(zip(seen, values, strict=True))
    needed = 0
    for p in parts:
        needed = int(p["needed"].iloc[0]) if len(p) else needed
        if not done:
            for tile, value in zip(p["tile"].tolist(), p["value"].tolist(), strict=True):
                held.setdefault(tile, value)
    if done or len(held) < needed:
        state.update(([], [], True) if done else (list(held), list(held.values()), False))
        return
    state.update(([], [], True))
    yield pd.DataFrame({"strip": [key[0]], "tiles": [len(held)], "total": [sum(held.values())]})


def ready_stream(tiles: DataFrame, rows: int, columns: int, tail: bool = False) -> DataFrame:
    """The same for a stream of tiles: each strip comes out once, in the batch in which its last tile arrives; of a repeated tile the first value counts."""
    keyed = by_strip(tiles, rows, columns, tail)
    return keyed.groupBy("strip").applyInPandasWithState(_arrive, OUT, "seen array<bigint>, held array<double>, done boolean", "append", GroupStateTimeout.NoTimeout)


def write_ready(tiles: DataFrame, path: str, checkpoint: str, rows: int, columns: int, tail: bool = False) -> StreamingQuery:
    """Takes in all tiles that have arrived and appends the strips that are ready to Parquet; what has been seen stays in the checkpoint."""
    out = ready_stream(tiles, rows, columns, tail)
    return out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
