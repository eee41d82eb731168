"""Secret scan: fixed patterns plus a randomness test battery, in DataFrame functions only.

Fixed patterns give the base spans.  Every other run of encoding characters is tested for randomness: the
alphabet of its encoding (hex, base32 or base64) is inferred, then

* chi-squared uniformity over the cells of that alphabet (Wilson-Hilferty normal approximation),
* a Wald-Wolfowitz runs test about the middle of the alphabet,
* lag-1 serial correlation of the symbol values

give three p-values under "this run is random", combined by Fisher's method.  Random runs have uniform p-values
and words have p-values near 0, so within each length class the share of words above a threshold t is estimated
as 1 - 2 * #(p > 0.5) * (1 - t) / #(p > t).  The threshold is 1 / STEPS, a fixed level of the test, unless the
estimate exceeds ``fdr`` there by more than ERRORS standard errors; then it is the smallest t up to 0.5 at which it
does not.  So a class of few runs has the fixed level, and a random run is lost by it with a chance of 1 / STEPS.
The counts behind it are a histogram of bounded size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import checked_broadcast, free_names, quoted, stage

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Runs that are tested for randomness.
RUN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "random"]

HEX_SYMBOLS = "0123456789abcdef"
BASE32_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: The letters that make up two thirds of written words in the languages of Latin script.
OFTEN = "AEINORST"
#: Lower ends of the length classes of the false-discovery control, and steps of its thresholds.
LENGTHS, STEPS = (20, 24, 32, 48, 96), 100
#: Standard errors by which an estimate must exceed the false-discovery rate to count as above it.
ERRORS = 3


def _matches(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """Matches in order, each with the length of the text since the match before; linear in the text."""
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    found = F.transform(
        F.filter(found, lambda x: x["hit"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("n"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("len"),
            F.length(x["value"]).alias("value_len"), F.when(F.lit(kind == 3), x["hit"]).alias("run"),
        ),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:int,n:int,gap:int,len:int,value_len:int,run:string>>"))


def _upper_tail(z: Column) -> Column:
    """P(N(0,1) > z) for z >= 0, Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / 2.5066282746310002 * poly


def randomness(rows: DataFrame, run: str = "run") -> DataFrame:
    """rows with ``p``: the combined p-value of the string column under "random over its inferred alphabet"."""
    c, keep = F.col(run), rows.columns
    hexes, base32 = F.col("encoding") == "hex", F.col("encoding") == "base32"
    rows = rows.withColumn("encoding", F.when(c.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(c.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64"))
    rows = rows.withColumn("plain", F.when(hexes, F.lower(c)).otherwise(F.translate(c, "-_", "+/")))
    rows = rows.withColumn("symbols", F.when(hexes, HEX_SYMBOLS).when(base32, BASE32_SYMBOLS).otherwise(BASE64_SYMBOLS))
    values = F.transform(F.regexp_extract_all("plain", F.lit("."), F.lit(0)), lambda x: F.call_function("instr", F.col("symbols"), x).cast("double") - 1)
    rows = rows.withColumn("values", values).withColumn("n", F.size("values").cast("double")).withColumn("middle", F.length("symbols") / 2)
    # Cells of the alphabet with their shares: single symbols for hex; for the larger ones, letters of either case that words are
    # mostly made of, the other letters, digits, signs.  Names stand out by the first, random runs fill all alike.
    often = len(OFTEN)
    shares = F.when(hexes, F.array_repeat(F.lit(1 / 16), 16)).when(base32, F.array(*(F.lit(n / 32) for n in (often, 26 - often, 6))))
    rows = rows.withColumn("shares", shares.otherwise(F.array(*(F.lit(n / 64) for n in (often, 26 - often, often, 26 - often, 10, 2)))))
    common = lambda x: (x % 26).isin(*(float(ord(c) - 65) for c in OFTEN))
    letter = lambda x, a: F.when(common(x), a).otherwise(a + 1)
    wide = lambda x: F.when(x < 26, letter(x, 0)).when(x < 52, letter(x, 2)).when(x < 62, 4).otherwise(5)
    cell = lambda x: F.when(hexes, x.cast("int")).when(base32, F.when(x < 26, letter(x, 0)).otherwise(2)).otherwise(wide(x))
    rows = rows.withColumn("cells", F.transform("values", cell))
    zero = F.struct(*(F.lit(v).cast("double").alias(k) for k, v in (("last", -1), ("s", 0), ("ss", 0), ("sp", 0), ("runs", 0), ("up", 0))))
    high = lambda v: v >= F.col("middle")

    def fold(a: Column, x: Column) -> Column:
        return F.struct(
            x.alias("last"),
            (a["s"] + x).alias("s"),
            (a["ss"] + x * x).alias("ss"),
            (a["sp"] + F.when(a["last"] >= 0, a["last"] * x).otherwise(0.0)).alias("sp"),
            (a["runs"] + F.when((a["last"] < 0) | (high(a["last"]) != high(x)), 1.0).otherwise(0.0)).alias("runs"),
            (a["up"] + F.when(high(x), 1.0).otherwise(0.0)).alias("up"),
        )

    count = lambda i: F.size(F.filter("cells", lambda x: x == i))
    chi = F.aggregate(F.transform("shares", lambda q, i: F.pow(count(i) - F.col("n") * q, 2) / (F.col("n") * q)), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("chi", chi).withColumn("v", 2 / (9 * (F.size("shares") - 1))).withColumn("acc", F.aggregate("values", zero, fold))
    rows = rows.withColumn("first", F.col("values")[0]).withColumn("mean", F.col("acc.s") / F.col("n")).withColumn("both", 2 * F.col("acc.up") * (F.col("n") - F.col("acc.up")))
    rows = rows.drop("values", "cells", "plain", "symbols").select("*", "acc.*")
    rows = rows.withColumn("var", F.expr("ss / n - mean * mean")).withColumn("runs_var", F.expr("both * (both - n) / (n * n * (n - 1))"))
    rows = rows.withColumn("z_chi", F.expr("(power(chi / (size(shares) - 1), 1 / 3D) - (1 - v)) / sqrt(v)"))
    rows = rows.withColumn("z_runs", F.expr("if(runs_var > 0, abs(runs - both / n - 1) / sqrt(runs_var), 38D)"))
    # The sum over neighbours of (x - mean) * (y - mean); either side of the pairs lacks one end of the run.
    rows = rows.withColumn("cov", F.expr("(sp - mean * (2 * s - first - last) + (n - 1) * mean * mean) / n"))
    rows = rows.withColumn("z_serial", F.expr("if(var > 0, abs(cov / var + 1 / (n - 1)) * sqrt(n), 38D)"))
    for name, two in (("chi", False), ("runs", True), ("serial", True)):
        z = F.col(f"z_{name}")
        rows = rows.withColumn(f"t_{name}", _upper_tail(F.abs(z)))
        t = F.col(f"t_{name}")
        p = F.least(F.lit(1.0), 2 * t) if two else F.when(z >= 0, t).otherwise(1 - t)
        rows = rows.withColumn(f"p_{name}", F.greatest(p, F.lit(1e-300)))
    rows = rows.withColumn("half", F.expr("-(ln(p_chi) + ln(p_runs) + ln(p_serial))"))  # half of Fisher's statistic, 6 degrees of freedom
    return rows.select(*keep, F.expr("exp(-half) * (1 + half + half * half / 2)").alias("p"))


def length_class(n: Column) -> Column:
    return reduce(lambda c, x: F.when(n >= x, x).otherwise(c), LENGTHS[1:], F.lit(LENGTHS[0]))


def thresholds(tested: DataFrame, fdr: float) -> DataFrame:
    """(class, t) for every class of tested: the smallest threshold on p, 1 / STEPS at least and 0.5 at most, at which
    the estimated share of non-random runs is not significantly above fdr."""
    hist = tested.groupBy("class", F.least(F.floor(F.col("p") * STEPS), F.lit(STEPS - 1)).alias("step")).count()
    above = Window.partitionBy("class").orderBy(F.desc("step"))  # STEPS rows a class
    upper = F.sum(F.when(F.col("step") >= STEPS // 2, F.col("count")).otherwise(0)).over(Window.partitionBy("class"))
    hist = hist.select("class", "step", F.sum("count").over(above).alias("above"), upper.alias("upper"))
    t = F.col("step") / STEPS
    # above - 2 * upper * (1 - t) = lower - upper * (1 - 2 * t), lower the runs from t to 0.5: two independent counts.
    lower = F.col("above") - F.col("upper")
    error = F.sqrt(lower + F.col("upper") * F.pow(1 - 2 * t, 2))
    fine = lower - F.col("upper") * (1 - 2 * t) <= fdr * F.col("above") + ERRORS * error
    fine = fine & (F.col("step") >= 1) & (F.col("step") < STEPS // 2)
    return hist.groupBy("class").agg((F.coalesce(F.min(F.when(fine, F.col("step"))), F.lit(STEPS // 2)) / STEPS).alias("t"))


def find_secrets(docs: DataFrame, fdr: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_key, spans as an array of (start, kind, end), kind an index of KINDS.

    Offsets count code points, the end is exclusive.  Base spans are always there; a random run is added where it
    overlaps no base span.  Texts of any length are read whole; null ones count as empty and have no spans; repeated
    rows and null ids keep rows of their own; extra columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = F.concat(_matches(text, 0, ASSIGN, 2), _matches(text, 1, ACCESS), _matches(text, 2, HEX), _matches(text, 3, RUN))
    rows = stage(
        docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.monotonically_increasing_id().alias("rid"), hits.alias("hits")),
        "secret-hits",
    )
    upto = Window.partitionBy("rid", "kind").orderBy("n")
    placed = (
        rows.where(F.size("hits") > 0)
        .select("doc_id", "text_key", "rid", F.explode("hits").alias("hit"))
        .select("doc_id", "text_key", "rid", "hit.*")
        .repartition("rid")
        .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto).cast("long"))
        .withColumn("start", F.col("end") - F.col("len"))
        .where((F.col("kind") != 0) | (F.col("value_len") >= 12))
    )
    # A run overlaps a base span if one that starts before its end ends after its start.
    order = Window.partitionBy("rid").orderBy("start", "end")
    base_end = F.when(F.col("kind") < 3, F.col("end"))
    before = F.max(base_end).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(F.col("kind") < 3, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    placed = placed.withColumn("before", before).withColumn("after", after)
    clear = (F.coalesce(F.col("before"), F.lit(0)) <= F.col("start")) & (F.col("after").isNull() | (F.col("after") >= F.col("end")))
    placed = stage(placed.where((F.col("kind") < 3) | clear).select("doc_id", "text_key", "rid", "kind", "start", "end", "run"), "secret-spans")
    tested = randomness(placed.where("kind = 3")).select("doc_id", "text_key", "rid", "kind", "start", "end", "p", length_class(F.length("run")).alias("class"))
    tested = stage(tested, "secret-tested")
    limits = stage(thresholds(tested, fdr), "secret-limits")  # a row per length class at most
    random = tested.join(F.broadcast(limits), "class").where("p >= t")
    out = ["doc_id", "text_key", "rid", "kind", "start", "end"]
    spans = placed.where("kind < 3").select(*out).unionByName(random.select(*out))
    found = spans.groupBy("rid", "doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    bare = rows.where(F.size("hits") == 0).select("doc_id", "text_key", none.alias("spans"))
    tried = rows.where(F.size("hits") > 0).select("rid", "doc_id", "text_key").join(found.select("rid", "spans"), "rid", "left")
    return bare.unionByName(tried.select("doc_id", "text_key", F.coalesce("spans", none).alias("spans")))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, fdr: float = 0.01, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by ``mark`` and all rows kept; n_chars, where there, follows the text.

    Rows are told apart by id and text, null ids among them; columns may have any names.
    """
    spans = find_secrets(docs, fdr, id_col, text_col).where(F.size("spans") > 0)
    own_id, own_key, own = free_names(docs, "span_id", "span_key", "spans")
    spans = spans.dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), F.col("spans").alias(own))
    spans = checked_broadcast(stage(spans, "secret-redact"), 100_000)
    text = F.col(text_col)
    joined = docs.join(spans, docs[id_col].eqNullSafe(spans[own_id]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == spans[own_key]), "left")
    # Reach: the furthest end of the spans so far, so that overlapping spans give one mark.
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def take(a: Column, x: Column) -> Column:
        fresh = x["start"] >= a["at"]
        piece = F.concat(F.substr(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(fresh, F.concat(a["parts"], F.array(piece))).otherwise(a["parts"]).alias("parts"))

    def done(a: Column) -> Column:
        return F.concat(F.array_join(a["parts"], ""), F.substr(text, (a["at"] + 1).cast("int"), F.length(text)))

    new = F.when(F.col(own).isNull(), text).otherwise(F.aggregate(own, zero, take, done))
    change = {text_col: new}
    if "n_chars" in docs.columns:
        change["n_chars"] = F.when(F.col(own).isNull(), F.col("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
    return joined.withColumns(change).select(*map(quoted, docs.columns))
