"""Statistics of types, pixels, depths and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspan.functions.columns import clip
from cellspan.operators.quantiles import quantile_table, wide_quantiles
from cellspan.operators.ranks import places, running
from cellspan.operators.staging import cut


def quantile_targets(stats: DataFrame, values: list[str], qs: list[float], least: int) -> DataFrame:
    """Quantiles of values per type of at least ``least`` complete cells (touches_edge false)."""
    whole = stats.where(~F.col("touches_edge") & F.col("cell_type").isNotNull())
    n = whole.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    wide = wide_quantiles(whole, ["cell_type"], {v: F.col(v) for v in values}, {f"p{int(round(q * 100))}": q for q in qs})
    return n.join(wide.drop(*(f"{v}_n" for v in values)), "cell_type", "left")


def admixture_rate(alpha: DataFrame, rules: DataFrame) -> DataFrame:
    """Mass of the factors that a rule (factor, target) gives to a type; 0 for types without a rule."""
    hit = rules.select("factor", F.col("target").alias("cell_type")).distinct().withColumn("hit", F.lit(1.0))
    return alpha.join(hit, ["factor", "cell_type"], "left").groupBy("cell_type").agg(F.sum(F.col("alpha") * F.coalesce("hit", F.lit(0.0))).alias("rate"))


def typical_area(pixels: DataFrame, size: int, pixel: float) -> DataFrame:
    """Median area of each label over the scenes where it does not touch the border, the median over all labels where it always does."""
    n = pixels.where("label > 0").groupBy("scene_id", "label").agg((F.count(F.lit(1)) * pixel * pixel).alias("area"), F.max(F.col("y").isin(0, size - 1) | F.col("x").isin(0, size - 1)).alias("border"))
    inner = n.where(~F.col("border"))
    whole = quantile_table(inner, [], {"area": F.col("area")}, [0.5]).agg(F.max("value").alias("all"))
    own = quantile_table(inner, ["label"], {"area": F.col("area")}, [0.5]).select("label", F.col("value").alias("own"))
    labels = n.select("label").distinct().join(own, "label", "left")
    return labels.crossJoin(F.broadcast(whole)).select("label", F.coalesce("own", "all").alias("area"))  # one row


def tile_alpha(fractions: DataFrame, tiles: DataFrame, overall: DataFrame, weight: float = 0.7) -> DataFrame:
    """(tile, cell_type, factor, alpha): the mean share over a tile's cells of the type, mixed with the type's overall alpha."""
    cells = fractions.select("cell_id", "cell_type").distinct().join(tiles, "cell_id")
    n = cells.groupBy("tile", "cell_type").agg(F.count(F.lit(1)).alias("cells"))
    own = fractions.join(tiles, "cell_id").groupBy("tile", "cell_type", "factor").agg(F.sum("share").alias("share"))
    grid = n.join(overall, "cell_type")
    mixed = weight * F.coalesce("share", F.lit(0.0)) / F.col("cells") + (1 - weight) * F.col("alpha")
    return grid.join(own, ["tile", "cell_type", "factor"], "left").select("tile", "cell_type", "factor", mixed.alias("alpha"))


def channel_means(pixels: DataFrame, types: DataFrame, least_area: int) -> DataFrame:
    """Mean over a type's labels of their mean value; types without a label of least_area take the mean of all such labels."""
    cell = pixels.where("label > 0").groupBy("scene_id", "label").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("area")).where(F.col("area") >= least_area)
    own = cell.join(types, "label").groupBy("cell_type").agg(F.avg("m").alias("own"))
    return types.select("cell_type").distinct().join(own, "cell_type", "left").crossJoin(F.broadcast(cell.agg(F.avg("m").alias("all")))).select("cell_type", F.coalesce("own", "all").alias("mean"))  # one row


def render_ratio(real: DataFrame, synth: DataFrame, least: int) -> DataFrame:
    """Per type the ratio of mean values, held to 0.5 to 2.5; 1 where a side has fewer than least rows.  Both sides: (cell_type, m)."""
    side = lambda d, k: d.groupBy("cell_type").agg(F.avg("m").alias(f"m{k}"), F.count(F.lit(1)).alias(f"n{k}"))
    ok = (F.col("n1") >= least) & (F.col("n2") >= least) & (F.col("m2") > 0)
    return side(real, 1).join(side(synth, 2), "cell_type", "left").select("cell_type", F.when(ok, clip(F.col("m1") / F.col("m2"), 0.5, 2.5)).otherwise(1.0).alias("ratio"))


def relative_efficiency(values: DataFrame, group: str, value: str) -> DataFrame:
    """Median of value in each group over the median of all rows, held to 0.25 to 4, with log-moments of positive values."""
    whole = quantile_table(values, [], {"v": F.col(value)}, [0.5]).agg(F.max("value").alias("all"))
    own = quantile_table(values, [group], {"v": F.col(value)}, [0.5]).select(group, F.col("value").alias("own"))
    g = values.groupBy(group).agg(F.avg(F.when(F.col(value) > 0, F.ln(value))).alias("log_mean"), F.stddev_pop(F.when(F.col(value) > 0, F.ln(value))).alias("log_std"))
    return g.join(own, group, "left").crossJoin(F.broadcast(whole)).select(group, clip(F.col("own") / F.col("all"), 0.25, 4.0).alias("efficiency"), "log_mean", "log_std")  # one row


def ridge_fit(samples: DataFrame, edges: list[float], background: float, least: int) -> DataFrame:
    """(cell_type, amplitude, width) of a Gaussian of the distance: the line through ln(median excess) over squared bin centres.

    samples: (cell_type, cell, distance, value).  Types of fewer than ``least`` cells, of fewer than two bins above the
    background, or without a falling line have none.
    """
    # The least excess and slope, the bounds of amplitude and width.
    pairs = list(zip(edges, edges[1:], strict=False))
    bin_ = F.coalesce(*(F.when((F.col("distance") >= a) & (F.col("distance") < b), F.lit((a + b) / 2)) for a, b in pairs))
    enough = samples.groupBy("cell_type").agg(F.count_distinct("cell").alias("cells")).where(F.col("cells") >= least)
    middle = quantile_table(samples.withColumn("centre", bin_).where("centre is not null"), ["cell_type", "centre"], {"v": F.col("value")}, [0.5])
    m = middle.select("cell_type", "centre", (F.col("value") - background).alias("excess"))
    fit = m.where("excess > 1e-4").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.ln("excess"), F.col("centre") * F.col("centre")).alias("slope"), F.regr_intercept(F.ln("excess"), F.col("centre") * F.col("centre")).alias("at"))
    fit = fit.where("n >= 2 and slope < -1e-4").join(enough, "cell_type")
    return fit.select("cell_type", clip(F.exp("at"), 0.0, 2.0).alias("amplitude"), clip(F.sqrt(-1 / (2 * F.col("slope"))), 0.5, 20.0).alias("width"))


def welch_rules(t: DataFrame, tail: Column, least: int, effect: float, level: float) -> DataFrame:
    """Rows of evidence.welch() that pass the gates: enough rows on both sides, t above 0, an effect, a small p-value."""
    return t.withColumn("p", tail).where((F.col("n_with") >= least) & (F.col("n_without") >= least) & (F.col("t") > 0) & (F.col("delta") >= effect) & (F.col("p") < level))


def f1_calibration(scores: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(threshold, f1, precision, recall, n_detected): the lowest of the score thresholds of best F1; keys without a score are never found."""
    t = truth.select(*keys).distinct().withColumn("truth", F.lit(1))
    by = scores.join(t, keys, "left").groupBy("strength").agg(F.sum(F.coalesce("truth", F.lit(0))).alias("tp"), F.count(F.lit(1)).alias("n"))
    run = running(by, "strength", ["tp", "n"], descending=True)
    r = run.crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("real")))).where("tp > 0")  # one row
    f1 = 2 * F.col("tp") / (F.col("n") + F.col("real"))
    best = F.max_by(F.struct(F.col("strength").alias("threshold"), f1.alias("f1"), (F.col("tp") / F.col("n")).alias("precision"), (F.col("tp") / F.col("real")).alias("recall"), F.col("n").alias("n_detected")), F.struct(f1, -F.col("strength")))
    return r.agg(best.alias("b")).select("b.*")


def naive_bayes(flags: DataFrame, methods: list[str], truth: str = "truth", eps: float = 0.02) -> DataFrame:
    """P(real | pattern) for every pattern of the methods' flags; rates held to [eps, 1 - eps], the prior to eps at least."""
    rate = lambda m, t: clip(F.sum(F.when(F.col(truth) == t, F.col(m).cast("double")).otherwise(0.0)) / F.greatest(F.count_if(F.col(truth) == t), F.lit(1)), eps, 1 - eps)
    r = flags.agg(F.avg(F.col(truth).cast("double")).alias("prior"), *(rate(m, t).alias(f"{m}{k}") for m in methods for k, t in (("1", True), ("0", False))))
    yes_no = flags.sparkSession.createDataFrame([(True,), (False,)], "v boolean")
    grid = r
    for m in methods:
        grid = grid.crossJoin(F.broadcast(yes_no.withColumnRenamed("v", m)))  # two rows each
    odds = F.ln(F.greatest("prior", F.lit(eps))) - F.ln(F.greatest(1 - F.col("prior"), F.lit(eps)))
    for m in methods:
        a, b = F.col(f"{m}1"), F.col(f"{m}0")
        odds = odds + F.when(F.col(m), F.ln(a / b)).otherwise(F.ln((1 - a) / (1 - b)))
    return grid.select(*methods, (1 / (1 + F.exp(-odds))).alias("posterior"))


def calibrated_consensus(methods: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rules of several methods: tier, strengths over their F1 threshold (truth: at least two methods), their geometric mean, posterior."""
    names = list(methods)
    rows = cut(reduce(DataFrame.unionByName, (d.select(*keys, "strength", F.lit(m).alias("method")) for m, d in methods.items())), "rules")
    wide = rows.groupBy(*keys).pivot("method", names).agg(F.max("strength"))
    wide = wide.withColumns({f"by_{m}": F.col(m).isNotNull() for m in names})
    wide = wide.withColumn("n_methods", reduce(lambda a, b: a + b, (F.col(f"by_{m}").cast("int") for m in names)))
    wide = cut(wide, "found")
    truth = wide.where("n_methods >= 2").select(*keys)
    for m in names:
        best = f1_calibration(rows.where(F.col("method") == m).select(*keys, "strength"), truth, keys).select(F.col("threshold").alias(f"cut_{m}"))
        wide = wide.join(F.broadcast(best), F.lit(True), "left")  # one row at most
    post = naive_bayes(wide.select(*(F.col(f"by_{m}") for m in names), (F.col("n_methods") >= 2).alias("truth")), [f"by_{m}" for m in names])
    wide = wide.withColumns({f"{m}_calibrated": F.when(F.col(f"by_{m}") & (F.col(f"cut_{m}") != 0), F.col(m) / F.col(f"cut_{m}")).otherwise(0.0) for m in names})
    strengths = F.filter(F.array(*(F.col(f"{m}_calibrated") for m in names)), lambda v: v > 0)
    score = F.when(F.size(strengths) > 0, F.exp(F.aggregate(strengths, F.lit(0.0), lambda a, v: a + F.ln(v)) / F.size(strengths))).otherwise(0.0)
    tier = F.when(F.col("n_methods") >= 3, 1).when(F.col("n_methods") >= 2, 2).otherwise(3)
    out = wide.join(F.broadcast(post), [f"by_{m}" for m in names])  # 2 to the number of methods rows
    return out.select(*keys, tier.alias("tier"), "n_methods", *(f"by_{m}" for m in names), *(f"{m}_calibrated" for m in names), score.alias("combined_score"), "posterior")


def roundtrip(rules: DataFrame, planted: DataFrame, keys: list[str]) -> DataFrame:
    """For each planted rule whether and how strongly it was found, and how many other rules were."""
    found = planted.join(rules, keys, "left").select(*keys, F.col("strength").isNotNull().alias("detected"), F.coalesce("strength", F.lit(0.0)).alias("strength"))
    other = rules.join(planted, keys, "left_anti").agg(F.count(F.lit(1)).alias("other_rules"))
    return found.crossJoin(F.broadcast(other))  # one row


def sensor_noise(pixels: DataFrame, least: int = 1000, least_dark: int = 100, half: float = 30.0) -> DataFrame:
    """(scene_id, read_std, dark_mean, shot_k): deviation of pixels below the 5th percentile plus 1, and what the middle varies beyond it."""
    p = pixels.where("value > 0")
    q = wide_quantiles(p, ["scene_id"], {"v": F.col("value")}, {"5": 0.05, "50": 0.5}).select("scene_id", F.col("v_5").alias("p5"), F.col("v_50").alias("p50"), F.col("v_n").alias("n"))
    j = p.join(q, "scene_id")
    dark, mid = F.col("value") < F.col("p5") + 1, F.col("value").between(F.greatest(F.col("p50") - half, F.lit(1.0)), F.col("p50") + half)
    pick = lambda f, c: f(F.when(c, F.col("value")))
    s = j.groupBy("scene_id").agg(F.first("n").alias("n"), F.first("p50").alias("p50"), *(pick(f, c).alias(k) for f, c, k in ((F.count, dark, "nd"), (F.stddev_pop, dark, "sd"), (F.avg, dark, "md"), (F.count, mid, "nm"), (F.var_pop, mid, "vm"))))
    on = F.col("n") >= least
    read = F.when(on & (F.col("nd") > least_dark), F.col("sd")).otherwise(0.0)
    shot = F.when(on & (F.col("nm") > least) & (F.col("p50") > 0), F.sqrt(F.greatest(F.col("vm") - read * read, F.lit(0.0)) / F.col("p50"))).otherwise(0.0)
    return s.select("scene_id", read.alias("read_std"), F.when(on & (F.col("nd") > least_dark), F.col("md")).otherwise(0.0).alias("dark_mean"), shot.alias("shot_k"))


def fwhm(profile: DataFrame, floor: float, spacing: float) -> DataFrame:
    """(label, z_center, z_extent, z_confidence) of profiles (label, z, v): refined peak, width of the run above half of it, range over baseline."""
    by = Window.partitionBy("label")
    p = profile.withColumn("base", F.min("v").over(by)).withColumn("b", F.col("v") - F.col("base"))
    p = p.withColumn("peak", F.max("b").over(by)).where(F.col("peak") > floor)
    first = F.min(F.when(F.col("b") == F.col("peak"), F.col("z"))).over(by)
    w = by.orderBy("z")
    p = p.withColumns({"at": first, "y0": F.lag("b").over(w), "y2": F.lead("b").over(w)})
    # Islands: runs of values above half; the number of low values before tells them apart.
    p = p.withColumn("above", F.col("b") > F.col("peak") / 2).withColumn("run", F.sum(F.when(F.col("above"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    here = p.where("z = at").select("label", "peak", "base", "at", "y0", "y2", F.col("run").alias("own"))
    span = p.where("above").groupBy("label", "run").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    denom = F.col("y0") - 2 * F.col("peak") + F.col("y2")
    delta = F.when(F.col("y0").isNotNull() & F.col("y2").isNotNull() & (F.abs(denom) > 1e-6), clip((F.col("y0") - F.col("y2")) / 2 / denom, -1.0, 1.0)).otherwise(0.0)
    j = here.join(span, (here["label"] == span["label"]) & (F.col("own") == F.col("run"))).drop(span["label"])
    return j.select("label", ((F.col("at") + delta) * spacing).alias("z_center"), ((F.col("hi") - F.col("lo")) * spacing).alias("z_extent"), (F.col("peak") / F.greatest("base", F.lit(1.0))).alias("z_confidence"))


def quantile_remap(values: DataFrame, target: DataFrame, group: str, key: list[str], points: int) -> DataFrame:
    """values replaced by the target table (group, q, t) at their rank: uniform rank within the group, linear between the table's points."""
    at = F.col("place") / F.greatest(F.col("size") - 1, F.lit(1)) * (points - 1)
    rows = places(values, group, ["value", *key]).withColumn("at", at).drop("place", "size").withColumn("q", F.least(F.floor("at"), F.lit(points - 2)).cast("int"))
    table = target.withColumn("next", F.lead("t").over(Window.partitionBy(group).orderBy("q")))
    return rows.join(table, [group, "q"]).withColumn("remapped", F.col("t") + (F.col("at") - F.col("q")) * (F.col("next") - F.col("t"))).drop("at", "q", "t", "next")


def inverse_cdf(rows: DataFrame, weights: DataFrame, group: str, choice: str, u: str) -> DataFrame:
    """rows with the first choice, in order, whose running share of weight exceeds u; weights has few choices a group."""
    w = Window.partitionBy(group)
    c = weights.withColumn("cdf", F.sum("weight").over(w.orderBy(choice).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(w))
    table = c.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("cdf", choice))).alias("table"))
    hit = F.filter("table", lambda x: x["cdf"] > F.col(u))
    return rows.join(table, group).withColumn(choice, F.coalesce(F.get(hit, F.lit(0))[choice], F.element_at("table", -1)[choice])).drop("table")


def match_summary(links: DataFrame, n_a: DataFrame, n_b: DataFrame) -> DataFrame:
    """Rates, mean and median IoU, shares above 0.5 and 0.75 of matches (iou), against the numbers of labels (one row n each)."""
    m = links.agg(F.count(F.lit(1)).alias("matched"), F.avg("iou").alias("mean_iou"), *(F.avg((F.col("iou") >= t).cast("double")).alias(f"iou_at_{int(t * 100)}") for t in (0.5, 0.75)))
    middle = quantile_table(links, [], {"iou": F.col("iou")}, [0.5]).agg(F.max("value").alias("median_iou"))
    m = m.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(n_a.select(F.col("n").alias("na")))).crossJoin(F.broadcast(n_b.select(F.col("n").alias("nb"))))  # one row each
    return m.select("matched", (F.col("matched") / F.greatest("na", F.lit(1))).alias("match_rate_a"), (F.col("matched") / F.greatest("nb", F.lit(1))).alias("match_rate_b"), "mean_iou", "median_iou", "iou_at_50", "iou_at_75", (F.col("nb") - F.col("na")).alias("count_delta"))
