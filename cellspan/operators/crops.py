"""Choice of crops: square windows around cells, spread, on a grid, where cells are dense, or by tissue composition.

The choices are deterministic: cells are in order of x, y and id.  What is kept on the driver is a list of picks (as many as crops
are asked for) or of cluster centres.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspan.operators import nearest, ranks
from cellspan.operators.quantiles import quantile_table
from cellspan.operators.staging import cut
from cellspan.operators.suppression import suppress

#: Columns of a cell: its id and place, its molecules, its type (null: none).
CELL = ["cell_id", "x", "y", "molecules", "cell_type"]
Bounds = tuple[float, float, float, float]


def inside(cells: DataFrame, size: float, bounds: Bounds | None) -> DataFrame:
    """Cells whose crop lies in the bounds (xmin, xmax, ymin, ymax); all without bounds."""
    if bounds is None:
        return cells
    half, (xmin, xmax, ymin, ymax) = size / 2, bounds
    return cells.where((F.col("x") - half >= xmin) & (F.col("x") + half <= xmax) & (F.col("y") - half >= ymin) & (F.col("y") + half <= ymax))


def squares(cells: DataFrame, size: float) -> DataFrame:
    """cells with the square (bx, by) of the side ``size`` that they lie in."""
    return cells.withColumns({"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)})


def around(counts: DataFrame, reach: int, values: list[str], keys: list[str], of: DataFrame) -> DataFrame:
    """Sums of values over the (2 reach + 1) squared squares around each square of ``of``; counts: (bx, by, keys, values)."""
    shifts = F.array(*(F.lit(i) for i in range(-reach, reach + 1)))
    spread = counts
    for b in ("bx", "by"):
        spread = spread.withColumn("by_", F.explode(shifts)).withColumn(b, F.col(b) + F.col("by_")).drop("by_")
    sums = spread.groupBy("bx", "by", *keys).agg(*(F.sum(v).alias(v) for v in values))
    return sums.join(of.select("bx", "by"), ["bx", "by"], "left_semi")


def density(cells: DataFrame, size: float) -> DataFrame:
    """cells with the number of cells in the 3 x 3 squares of half a crop around them."""
    binned = squares(cells, max(size / 2, 1.0))
    counts = binned.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("density"))
    n = around(counts, 1, ["density"], [], counts)
    return binned.join(n, ["bx", "by"]).drop("bx", "by")


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows with their ``pick`` from 1; sorted in parts, merged once."""
    rows = df.orderBy(*order).limit(n)  # n rows
    return rows.withColumn("pick", F.row_number().over(Window.orderBy(*order)))


def spread_cells(cells: DataFrame, n: int) -> DataFrame:
    """n cells evenly spaced in order; all where there are no more."""
    placed = ranks.places(cells.withColumn("all", F.lit(0)), "all", ["x", "y", "cell_id"])
    k = F.least(F.lit(n), F.col("size"))
    step = (F.col("size") - 1) / F.greatest(k - 1, F.lit(1))
    # The pick that a place would be, and whether that pick's place is this one.
    j = F.rint(F.col("place") / F.greatest(step, F.lit(1e-12))).cast("int")
    hit = F.filter(F.array(j - 1, j, j + 1), lambda i: (i >= 0) & (i < k) & (F.rint(i * step) == F.col("place")))
    return placed.where(F.size(hit) > 0).withColumn("pick", hit[0] + 1).drop("all", "place", "size")


def grid_cells(cells: DataFrame, n: int, size: float, bounds: Bounds | None = None) -> DataFrame:
    """For each of n grid points in turn, row by row, the nearest cell that no earlier point has taken.

    Every open point asks for the nearest of its candidates that is not taken; the earliest keeps it.  A point needs at most
    as many candidates as there are points before it, so lists grow only for points that have used theirs up.
    """
    half = size / 2
    if bounds is None:
        e = cells.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if e[0] is None:
            return cells.withColumn("pick", F.lit(0)).limit(0)
        bounds = (e[0] - half, e[1] + half, e[2] - half, e[3] + half)
    xmin, xmax, ymin, ymax = bounds
    width, height = max(xmax - xmin, size), max(ymax - ymin, size)
    columns = max(1, -int(-((n * width / max(height, 1e-6)) ** 0.5) // 1))
    rows = max(1, -(-n // columns))
    even = lambda a, b, k: [a + (b - a) * i / (k - 1) for i in range(k)] if k > 1 else [a]
    points = [(x, y) for y in even(ymin + half, ymax - half, rows) for x in even(xmin + half, xmax - half, columns)][:n]
    spark, taken, k = cells.sparkSession, {}, 8
    total = cells.limit(n + 1).count()
    numbered = cut(ranks.places(cells.withColumn("all", F.lit(0)), "all", ["cell_id"]).select(*cells.columns, F.col("place").alias("key")), "cells")
    lists: dict[int, list[int]] = {}
    while True:
        short = [i for i in range(len(points)) if len(lists.get(i, ())) < min(k, total)]
        asked = spark.createDataFrame([(-1 - i, *points[i]) for i in short], "key bigint, x double, y double")
        near = nearest.nearest(asked, numbered.select("key", "x", "y"), k, "key", "x", "y").collect() if short else []  # k a point
        for i in short:
            lists[i] = []
        for r in sorted(near, key=lambda r: (r.src, r["rank"])):
            lists[-1 - r.src].append(r.dst)
        # In order of the points, each takes the first of its list that is free.
        taken, open_ = {}, False
        for i in range(len(points)):
            free = next((c for c in lists[i] if c not in taken), None)
            if free is None and len(lists[i]) < total and len(taken) < total:
                open_ = True
                break
            if free is not None:
                taken[free] = i
        if not open_:
            break
        k *= 4
    picks = spark.createDataFrame([(c, i + 1) for c, i in taken.items()], "key bigint, pick int")
    return numbered.join(F.broadcast(picks), "key").drop("key")  # n rows


def dense_cells(cells: DataFrame, n: int, size: float) -> DataFrame:
    """n cells by falling density, then molecules, none nearer than a crop to an earlier one; filled up from the rest in the same order."""
    scored = cut(density(cells, size), "density")
    order = [-F.col("density"), -F.col("molecules"), F.col("x"), F.col("y")]
    key = "cell_id"
    apart = suppress(scored, max(size, 1.0), order, key, "x", "y")
    chosen = cut(first_rows(apart, [*order, F.col(key)], n), "chosen")
    missing = n - chosen.count()
    if missing > 0:
        rest = first_rows(scored.join(chosen, key, "left_anti"), [*order, F.col(key)], missing)
        chosen = chosen.unionByName(rest.withColumn("pick", F.col("pick") + (n - missing)))
    return chosen.drop("density")


def composition(cells: DataFrame, size: float) -> DataFrame:
    """(bx, by, cells, types): for each square of half a crop its cells, and as a map the shares of types in the 5 x 5 squares around it."""
    binned = squares(cells, max(size / 2, 1.0))
    counts = binned.groupBy("bx", "by", "cell_type").agg(F.count(F.lit(1)).alias("n"))
    own = binned.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("cells"))
    near = around(counts.where("cell_type is not null"), 2, ["n"], ["cell_type"], own)
    whole = near.groupBy("bx", "by").agg(F.sum("n").alias("all"))
    shares = near.join(whole, ["bx", "by"]).groupBy("bx", "by").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cell_type", F.col("n") / F.col("all"))))).alias("types"))
    return own.join(shares, ["bx", "by"], "left")


def distance2(types: str, centre: dict[str, float]) -> Column:
    """Squared distance of a map of shares from a centre; what a map lacks is 0."""
    out = F.lit(0.0)
    for t, v in sorted(centre.items()):
        d = F.coalesce(F.col(types)[t], F.lit(0.0)) - F.lit(v)
        out = out + d * d
    return out


def cluster(points: DataFrame, names: list[str], k: int, rounds: int = 25) -> tuple[DataFrame, list[dict[str, float]]]:
    """points (bx, by, cells, types) with ``cluster``, and the centres: k-means of the maps, weighted by cells.

    It starts from the point of most cells and goes on to the farthest from all centres so far (ties to the first square); each round is
    one aggregate of k times types numbers.
    """
    first = points.agg(F.min_by("types", F.struct(-F.col("cells"), "bx", "by"))).first()[0]
    full = lambda m: {t: float((m or {}).get(t, 0.0)) for t in names}
    centres = [full(first)]
    far = lambda cs: F.least(*(distance2("types", c) for c in cs)) if len(cs) > 1 else distance2("types", cs[0])
    while len(centres) < k:
        r = points.agg(F.min_by(F.struct("types", F.round(far(centres), 12).alias("d")), F.struct(-F.round(far(centres), 12), "bx", "by")).alias("m")).first()["m"]
        if r["d"] <= 0:
            break  # no more unlike points
        centres.append(full(r["types"]))
    for _ in range(rounds):
        named = points.withColumn("cluster", _closest(centres))
        sums = named.groupBy("cluster").agg(F.sum("cells").alias("n"), *(F.sum(F.coalesce(F.col("types")[t], F.lit(0.0)) * F.col("cells")).alias(f"s{i}") for i, t in enumerate(names))).collect()  # k rows
        new = list(centres)
        for r in sums:
            new[r["cluster"]] = {t: r[f"s{i}"] / r["n"] for i, t in enumerate(names)}
        moved = max(abs(a[t] - b[t]) for a, b in zip(centres, new, strict=True) for t in names)
        centres = new
        if moved < 1e-9:
            break
    return points.withColumn("cluster", _closest(centres)), centres


def _closest(centres: list[dict[str, float]]) -> Column:
    """The number of the nearest centre, the smaller of equally near ones."""
    return F.array_min(F.array(*(F.struct(F.round(distance2("types", c), 12).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))["i"]


def quotas(sizes: dict[int, int], n: int, alpha: float) -> dict[int, int]:
    """n dealt in proportion to sizes to the power alpha: whole parts, then the largest remainders (ties to the smaller number)."""
    weights = {c: s**alpha for c, s in sizes.items()}
    raw = {c: n * w / sum(weights.values()) for c, w in weights.items()}
    out = {c: int(r) for c, r in raw.items()}
    for c in sorted(raw, key=lambda c: (round(out[c] - raw[c], 12), c))[: n - sum(out.values())]:
        out[c] += 1
    return out


def farthest(rows: DataFrame, group: str, coords: list[str], quota: dict, order: list[str], first: Column, score: Callable[[Column], Column]) -> DataFrame:
    """Up to quota[group] rows of each group with their ``turn``: the one of least ``first``, then again and again that of the greatest score(distance to the picks).

    Ties go to the first in order.  One aggregate a turn for all groups; distances are kept in a table.
    """
    spark = rows.sparkSession
    rows = cut(rows.withColumn("near", F.lit(float("inf"))), "farthest")
    keep = [group, *coords, *order]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*dict.fromkeys(keep)).schema) + ", turn int"
    picked, names = [], list(dict.fromkeys(keep))
    for turn in range(1, max(quota.values(), default=0) + 1):
        open_ = [g for g, q in quota.items() if q >= turn]
        rank = first if turn == 1 else -score(F.col("near"))
        best = rows.where(F.col(group).isin(open_)).where("near >= 0").groupBy(group).agg(F.min_by(F.struct(*names), F.struct(F.round(rank, 9), *order)).alias("p"))
        new = [tuple(r["p"]) for r in best.collect()]  # a row for each group
        if not new:
            break
        picked += [(*p, turn) for p in new]
        table = spark.createDataFrame([p for p in new], schema.removesuffix(", turn int")).select(group, *(F.col(c).alias(f"_{c}") for c in names if c != group))
        gap, itself = F.lit(0.0), F.lit(True)
        for c in coords:
            gap = gap + (F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}"))
        for c in order:
            itself = itself & F.col(c).eqNullSafe(F.col(f"_{c}"))
        near = F.when(itself, -1.0).otherwise(F.least("near", F.coalesce(F.sqrt(gap), F.col("near"))))  # a pick is out
        rows = rows.join(F.broadcast(table), group, "left").withColumn("near", near).drop(*(f"_{c}" for c in names if c != group))
        if turn % 4 == 0:
            rows = cut(rows, "farthest")
    return spark.createDataFrame(picked, schema)


def stratified_cells(cells: DataFrame, n: int, size: float, k: int = 20, alpha: float = 0.5, within: str = "centroid") -> DataFrame:
    """n cells by clusters of the composition around them: quotas by cluster size to the power alpha, in each cluster spread as far as can be.

    The first of a cluster is the nearest to its centre, or with within="density" the densest (then density times distance decides).  Fewer
    than two types: dense_cells().
    """
    names = [r[0] for r in cells.where("cell_type is not null").select("cell_type").distinct().orderBy("cell_type").collect()]
    if len(names) < 2:
        return dense_cells(cells, n, size)
    total = cells.count()
    points, centres = cluster(cut(composition(cells, size), "composition"), names, max(2, min(k, n, total // 4)))
    gap = F.coalesce(*(F.when(F.col("cluster") == i, distance2("types", c)) for i, c in enumerate(centres)))
    points = cut(points.select("bx", "by", "cluster", gap.alias("gap")), "clusters")
    rows = squares(density(cells, size), max(size / 2, 1.0)).join(points, ["bx", "by"])
    rows = cut(rows.withColumns({"px": F.col("x").cast("double"), "py": F.col("y").cast("double")}), "members")
    sizes = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}  # k rows
    quota = {c: min(q, sizes[c]) for c, q in quotas(sizes, n, alpha).items()}
    dense = within == "density"
    picks = farthest(
        rows, "cluster", ["px", "py"], quota, ["x", "y", "cell_id"], -F.col("density") if dense else F.col("gap"),
        (lambda d: F.col("density") * d) if dense else (lambda d: d),
    )
    chosen = picks.select("cell_id", F.row_number().over(Window.orderBy("cluster", "turn")).alias("pick")).where(F.col("pick") <= n)  # n rows
    return cells.join(F.broadcast(chosen), "cell_id")


def random_cells(cells: DataFrame, n: int, seed: int) -> DataFrame:
    """n cells, each as likely as any other, the same for a seed whatever the partitions."""
    return first_rows(cells, [F.xxhash64("cell_id", F.lit(seed)), F.col("cell_id")], n)


def choose_crops(cells: DataFrame, n: int, size: float, bounds: Bounds | None = None, selection: str = "spread", seed: int = 1, **more: object) -> DataFrame:
    """crop_id, xmin, xmax, ymin, ymax of n squares around cells (cell_id, x, y, molecules, cell_type); fewer where there are fewer cells.

    selection: spread, random, grid, density or stratified (more: k, alpha, within).  Cells without an id or a place take no part.
    """
    usable = inside(cells.select(*CELL).where("cell_id is not null and cell_id <> '' and x is not null and y is not null"), size, bounds)
    ways = {
        "spread": lambda: spread_cells(usable, n), "random": lambda: random_cells(usable, n, seed), "grid": lambda: grid_cells(usable, n, size, bounds),
        "density": lambda: dense_cells(usable, n, size), "stratified": lambda: stratified_cells(usable, n, size, **more),
    }
    if selection not in ways:
        raise ValueError(f"selection must be one of {', '.join(ways)}")
    if n < 1 or usable.isEmpty():
        raise ValueError("no cells remain to choose crops from")
    half = size / 2
    name = F.concat(F.lit("crop_"), F.lpad(F.row_number().over(Window.orderBy("pick")).cast("string"), 5, "0"))  # n rows
    edges = [(F.col("x") - half).alias("xmin"), (F.col("x") + half).alias("xmax"), (F.col("y") - half).alias("ymin"), (F.col("y") + half).alias("ymax")]
    return ways[selection]().select(name.alias("crop_id"), *edges)


def bench_regions(cells: DataFrame, n: int, size: float, least: int = 25, bounds: Bounds | None = None) -> DataFrame:
    """region, xmin, ymin, n_cells of n unlike windows of half-stride squares inside the extent, densest first.

    Windows of ``least`` cells; of these the ones at or above the 40th percentile, if n are left; the densest first, then the farthest from
    all picks over standardised centre, log count, mean molecules and mean area.  cells: x, y, molecules, area.
    """
    if bounds is None:
        e = cells.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        bounds = tuple(e) if e[0] is not None else (0.0, 0.0, 0.0, 0.0)
    xmin, xmax, ymin, ymax = bounds
    stride, member = size / 2, cells
    for w, v, low, high in (("wx", "x", xmin, xmax), ("wy", "y", ymin, ymax)):
        last = int(max(0.0, high - size - low + 1e-6) / stride)
        at = F.floor((F.col(v) - low) / stride)
        member = member.withColumn(w, F.explode(F.array_distinct(F.array(at - 1, at)))).where((F.col(w) >= 0) & (F.col(w) <= last) & (F.col(v) >= low))
    windows = member.groupBy("wy", "wx").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("molecules").alias("molecules"), F.avg("area").alias("area"))
    windows = cut(windows.where(F.col("n_cells") >= least), "windows")
    if (found := windows.count()) > n:
        floor = quantile_table(windows, [], {"n": F.col("n_cells")}, [0.4]).first()["value"]
        dense = windows.where(F.col("n_cells") >= floor)
        windows = dense if dense.count() >= n else windows
    values = {"cx": F.col("wx").cast("double"), "cy": F.col("wy").cast("double"), "cn": F.log1p("n_cells"), "cm": F.col("molecules"), "ca": F.col("area")}
    rows = windows.withColumns(values)
    moments = rows.agg(*(f(c).alias(f"{k}{c}") for c in values for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    for c in values:
        rows = rows.withColumn(c, (F.col(c) - F.lit(moments[f"m{c}"] or 0.0)) / F.lit(moments[f"s{c}"] or 1.0))
    picks = farthest(rows.withColumn("all", F.lit(0)), "all", list(values), {0: min(n, found)}, ["wy", "wx"], -F.col("n_cells"), lambda d: d)
    chosen = windows.join(F.broadcast(picks.select("wy", "wx", "turn")), ["wy", "wx"])  # n rows
    rank = F.row_number().over(Window.orderBy(F.desc("n_cells"), "turn"))
    return chosen.select(F.concat(F.lit("region"), rank).alias("region"), (F.col("wx") * stride + xmin).alias("xmin"), (F.col("wy") * stride + ymin).alias("ymin"), "n_cells")
