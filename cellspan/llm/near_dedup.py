"""Near-duplicate components: MinHash bands, sequential Bayesian verification, exact confirmation.

1.  Documents with equal word sequences form a class; one row per class goes on.
2.  Signatures are cut into bands.  Classes that share a band value are candidates.  To avoid all pairs of a
    bucket, every member is first compared with a pivot, the member that shares the most band values overall (the
    text that a group was copied from).  Afterwards the pairs of a bucket that are still in different components
    are compared.  Before that, the shingles of the classes in question are counted: one that a single class has
    is in no intersection, so a class's shared shingles bound its intersections; so do, for a pair, bitmaps of
    hashed shingles.  The bounds drop no link.
3.  A pair's signatures are compared batch by batch; once the posterior probability that its similarity reaches
    the threshold is below ``miss``, it is dropped.  Survivors are confirmed on full shingle sets.
4.  Components by min-label propagation with shortcuts, one row per class.

A class is found by a 128-bit digest of its set; from there on it has a number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import bound_batches, checked_broadcast, free_names, small, stage, unstage

BANDS, ROWS = 32, 5
K = BANDS * ROWS
#: Signature rows that are compared at a time.
BATCH = 16
#: Times that shingles are counted, each time without the classes that the counts before ruled out.
COUNTS = 3
#: Members of a bucket from which on it is split, in as many parts on either side; pairs of one class beyond which they are split.
SPLIT, HUB = 2048, 65536
#: A class of more than one in so many rows is frequent.
FREQUENT = 1024
#: Longs of the bitmap that a class's shingles are hashed into.
WORDS = 32

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.RandomState(20240607)
_A = (_RNG.randint(0, 1 << 31, K).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.randint(0, 1 << 31, K).astype(np.uint32)[:, None]
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def split_words(text: str) -> list[bytes]:
    """Words between runs of ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text; one for a shorter text, none without words."""
    lists = [split_words(t) for t in texts]
    flat = [w for x in lists for w in x]
    if not flat:
        return [np.empty(0, np.uint64)] * len(texts)
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    hashed = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in distinct], np.uint64)[codes]
    # h[i]: of the words i to i + width - 1, whatever text they are in; each text takes those that lie within it
    h = np.zeros(len(hashed), np.uint64)
    for k in range(min(width, len(hashed))):
        h[: len(hashed) - k] = _mix(h[: len(hashed) - k] + hashed[k:] + np.uint64(k + 1))
    out, at = [], 0
    for x in lists:
        n = len(x)
        if n >= width:
            out.append(np.unique(h[at : at + n - width + 1]))
        elif n:
            own = np.zeros(1, np.uint64)
            for k in range(n):
                own = _mix(own + hashed[at + k] + np.uint64(k + 1))
            out.append(_mix(own + np.uint64(0x5BF0 + n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of linear permutations of the shingles' upper 32 bits; long sets in blocks."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        out = np.minimum(out, (x[at : at + 2048] * _A + _B).min(axis=1))
    return out


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def least_matches(n: int, threshold: float, miss: float, chance: float = 0.0) -> int:
    """The fewest matches among n rows that leave a posterior P(similarity >= threshold) of miss; prior uniform.  chance: that unlike rows match."""
    grid = (np.arange(1000) + 0.5) / 1000
    match = grid + (1 - grid) * chance
    for m in range(n + 1):
        log = m * np.log(match) + (n - m) * np.log1p(-match)
        w = np.exp(log - log.max())
        if w[grid >= threshold].sum() >= miss * w.sum():
            return m
    return n


def short_codes(signatures: np.ndarray) -> np.ndarray:
    """Two bits of each signature row, 32 rows to a long: [text, rows / 32]."""
    two = ((signatures * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64).reshape(-1, signatures.shape[-1] // 32, 32)
    return np.bitwise_or.reduce(two << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2).view(np.int64)


def may_match(a: str, b: str, threshold: float, percent: int, miss: float) -> Column:
    """The first, native batch of the verification: sizes and short codes of two sides with columns {a}n, {a}code and so on."""
    most = K - least_matches(K, threshold, miss, 0.25)
    return F.expr(f"100 * least({a}n, {b}n) >= {percent} * greatest({a}n, {b}n) AND {unlike(a, b)} <= {most}")


def unlike(a: str, b: str) -> str:
    """Rows in which two codes differ."""
    x = [f"({a}code[{i}] ^ {b}code[{i}])" for i in range(K // 32)]
    return "(" + " + ".join(f"bit_count(({v} | shiftrightunsigned({v}, 1)) & 6148914691236517205L)" for v in x) + ")"


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The shingles hashed into WORDS longs: a bit that only one of two sets has stands for a shingle that only it has."""
    bits = np.zeros(WORDS * 64, bool)
    bits[(shingles % np.uint64(WORDS * 64)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which pairs of signatures keep a posterior P(similarity >= threshold) of at least miss after every batch."""
    least = {n: least_matches(n, threshold, miss) for n in range(BATCH, K + 1, BATCH)}
    alive, matches = np.arange(len(a)), np.zeros(len(a), int)
    for n in range(BATCH, K + 1, BATCH):
        matches = matches + (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(axis=1)
        ok = matches >= least[n]
        alive, matches = alive[ok], matches[ok]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def components(nodes_links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b) of long ids: smallest reachable id.  Staged each round; rounds grow as the log of the diameter."""
    both = stage(nodes_links.select("a", "b").union(nodes_links.select("b", "a")).distinct(), "near-links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "near-labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(around, labels["node"] == around["a"]).select("node", "label", F.least("label", "near").alias("low"))
        # Shortcut: the label of the label.
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        new = stage(new.join(up, "low", "left").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") != F.col("label")).alias("moved")), "near-labels")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Texts of fewer than ``width`` words are one shingle, long ones are read whole; null texts and texts without words
    have none and link with nothing.  Repeated rows share a component; a null id never names a component that has another id.  Extra columns
    are ignored; an empty table gives an empty result.
    """
    return settled(docs, width, percent, miss, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def settled(docs: DataFrame, width: int, percent: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates() with text_key and component, a number of the component: null without words, and its own where ids repeat."""
    bound_batches(docs.sparkSession)
    threshold = percent / 100

    def sketch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            texts = p["text"].tolist()
            for at in range(0, len(texts), 500):
                block, seen = texts[at : at + 500], {}
                for t, s in zip(block, shingle_sets(block, width), strict=True):
                    key = set_digest(s)
                    if key not in seen:
                        seen[key] = signature(s).tobytes()
                    out.append((key, len(s), seen[key]))
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "text_key": p["text_key"], "digest": [x[0] for x in out], "n_shingles": [x[1] for x in out], "sig": [x[2] for x in out]})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = stage(source.withColumn("text_key", text_key(F.col("text"))).mapInPandas(sketch, "doc_id bigint, text_key bigint, digest binary, n_shingles bigint, sig binary"), "near-rows")
    # Classes of equal sets; the partial aggregation takes up groups of copies on the map side.
    classes = rows.where("n_shingles > 0").groupBy("digest")
    classes = classes.agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))

    def coded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                p["code"] = list(short_codes(np.frombuffer(b"".join(p["sig"]), np.uint32).reshape(len(p), K)))
                yield p

    classes = classes.mapInPandas(coded, "digest binary, low bigint, n bigint, sig binary, copies bigint, code array<bigint>")
    classes = stage(classes.withColumn("set_id", F.monotonically_increasing_id()), "near-classes")  # written at once, so numbers never change

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                sig = np.frombuffer(b"".join(p["sig"]), np.uint32).reshape(len(p), BANDS, ROWS).astype(np.uint64)
                h = np.zeros(sig.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    h = _mix(h + sig[:, :, k] + np.uint64(k + 1))
                yield pd.DataFrame({"set_id": np.repeat(p["set_id"].to_numpy(), BANDS), "bucket": h.astype(np.int64).ravel()})

    every = classes.select("set_id", "sig").mapInPandas(cut, "set_id bigint, bucket bigint")
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    bands = stage(every.join(shared, "bucket"), "near-buckets")
    score = bands.groupBy("set_id").agg(F.sum("members").alias("score"))
    best = F.max_by("set_id", F.struct("score", "set_id"))
    pivots = stage(bands.join(score, "set_id").groupBy("bucket").agg(best.alias("pivot")), "near-pivots")
    first = bands.join(pivots, "bucket").where("set_id <> pivot").select(F.col("set_id").alias("a"), F.col("pivot").alias("b"))
    first = stage(first.distinct(), "near-pairs")
    links = confirm(first, classes, rows, source, threshold, percent, miss, width)
    merged = components(links)

    # All candidates between components: one of the two is outside the component of the pivot.
    named = bands.join(merged.withColumnRenamed("node", "set_id"), "set_id", "left").select("bucket", "members", "set_id", F.coalesce("component", "set_id").alias("component"))
    heads = pivots.join(merged.withColumnRenamed("node", "pivot"), "pivot", "left").select("bucket", F.coalesce("component", "pivot").alias("main"))
    named = stage(named.join(heads, "bucket"), "near-named")
    open_ = stage(named.where("component <> main").select("bucket").distinct(), "near-open")
    named = stage(named.join(open_, "bucket"), "near-named")
    common = shared_counts(named, classes, source, percent, width)
    held = F.expr(" + ".join(f"bit_count(bits[{i}])" for i in range(WORDS))).alias("held")
    common = stage(common.select("set_id", "n", "common", "bits", held), "near-counted")
    named = stage(named.join(common, "set_id").join(classes.select("set_id", "code"), "set_id"), "near-named")
    # Large buckets are split into a grid: a part of the one side meets a part of the other.
    used, parts = ["set_id", "component", "n", "common", "code", "held", "bits"], F.ceil(F.col("members") / SPLIT)
    part, all_parts = F.pmod(F.xxhash64("set_id"), parts), F.explode(F.sequence(F.lit(0), parts - 1))
    outside = named.where("component <> main").select("bucket", part.alias("row"), all_parts.alias("column"), *(F.col(c).alias(f"x{c}") for c in used))
    inside = named.select(F.col("bucket").alias("in"), all_parts.alias("of_row"), part.alias("of_column"), "main", *(F.col(c).alias(f"y{c}") for c in used))
    cell = (F.col("bucket") == F.col("in")) & (F.col("row") == F.col("of_row")) & (F.col("column") == F.col("of_column"))
    other = cell & F.expr("xcomponent <> ycomponent") & F.expr("ycomponent = main or xset_id < yset_id")
    other = other & F.expr(f"(100 + {percent}) * least(xcommon, ycommon) >= {percent} * (xn + yn)") & may_match("x", "y", threshold, percent, miss)
    both = " + ".join(f"bit_count(xbits[{i}] & ybits[{i}])" for i in range(WORDS))
    other = other & F.expr(f"(100 + {percent}) * (least(xn - xheld, yn - yheld) + {both}) >= {percent} * (xn + yn)")
    tasks = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small tables, much work: as many tasks as asked for
    met = outside.repartition(tasks, "bucket", "row", "column").join(inside.repartition(tasks, "in", "of_row", "of_column"), other)
    unordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    rest = met.select(F.col("xset_id").alias("a"), F.col("yset_id").alias("b")).select(*unordered).distinct()
    rest = stage(rest.join(first.select(*unordered), ["a", "b"], "left_anti"), "near-rest")
    if not rest.isEmpty():
        more = confirm(rest, classes, rows, source, threshold, percent, miss, width)
        if not more.isEmpty():
            links = links.union(more)
            merged = components(links)

    member = classes.select("set_id", "low").join(merged.withColumnRenamed("node", "set_id"), "set_id")
    least = member.groupBy("component").agg(F.min("low").alias("component_id"))
    grouped = stage(member.join(least, "component").select("set_id", "component", "component_id"), "near-components")
    unstage(bands, score, pivots, first, heads, open_, named, common, rest, merged)
    # A class without a component is one of its own; classes of null ids only have a component without an id.
    own_id = F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("component_id"))
    lone = classes.join(grouped, "set_id", "left").select("digest", "copies", own_id.alias("component_id"), F.coalesce("component", "set_id").alias("component"))
    # Rows without words have no class; those of classes of many copies find theirs without a shuffle.
    slim, total = rows.where("n_shingles > 0").select("doc_id", "text_key", "digest", "n_shingles"), rows.count()
    many = lone.where(F.col("copies") > total // FREQUENT).drop("copies")  # fewer than FREQUENT rows
    heavy = slim.join(F.broadcast(many), "digest")
    light = slim.join(F.broadcast(many.select("digest")), "digest", "left_anti").join(lone.drop("copies"), "digest")
    wordless = rows.where("n_shingles = 0").select("doc_id", "text_key", "digest", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    out = heavy.unionByName(light).unionByName(wordless)
    return out.select("doc_id", "text_key", "n_shingles", "component", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def shared_counts(named: DataFrame, classes: DataFrame, source: DataFrame, percent: int, width: int) -> DataFrame:
    """(set_id, n, common, bits) of the classes of named that may still have a link among them.

    common counts the shingles that a second class of these has too: no intersection is larger.  Where it is below
    percent of n, no link is possible and the class is left out; then the rest is counted again.
    """

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = p["text"].tolist()
            for at in range(0, len(texts), 500):
                own = shingle_sets(texts[at : at + 500], width)
                yield pd.DataFrame({"digest": [set_digest(s) for s in own], "shingles": [s.view(np.int64) for s in own], "bits": [bitmap(s) for s in own]})

    ids = stage(named.select("set_id").distinct().join(classes.select("set_id", "digest"), "set_id"), "near-asked")
    sets = texts_of(ids, classes, source).mapInPandas(listed, "digest binary, shingles array<bigint>, bits array<bigint>")
    sets = stage(sets.join(ids, "digest").dropDuplicates(["set_id"]).drop("digest"), "near-listed")
    left = ids.count()
    for _ in range(COUNTS):
        each = sets.join(ids, "set_id", "left_semi").select("set_id", F.explode("shingles").alias("shingle"))
        lone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"), F.min("set_id").alias("set_id")).where("sets = 1")
        lone = lone.groupBy("set_id").agg(F.count(F.lit(1)).alias("lone"))
        counted = ids.select("set_id").join(classes.select("set_id", "n"), "set_id").join(lone, "set_id", "left")
        counted = counted.select("set_id", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("common"))
        ids = stage(counted.where(f"100 * common >= {percent} * n"), "near-counted")
        before, left = left, ids.count()
        if left * 10 >= before * 9:
            break
    return ids.join(sets.select("set_id", "bits"), "set_id")


def texts_of(asked: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """The texts of the first documents of classes (set_id), others of the same ids possibly among them."""
    first = asked.select("set_id").join(classes, "set_id").select(F.col("low").alias("id")).distinct()
    first = checked_broadcast(stage(first, "near-asked"))
    return source.join(first, source["doc_id"].eqNullSafe(first["id"]), "left_semi").select("text")


def confirm(pairs: DataFrame, classes: DataFrame, rows: DataFrame, source: DataFrame, threshold: float, percent: int, miss: float, width: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked: Bayesian pruning on signatures, then exact similarity of whole sets."""

    def prune(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                sa, sb = (np.frombuffer(b"".join(p[c]), np.uint32).reshape(len(p), K) for c in ("sa", "sb"))
                yield p.loc[survivors(sa, sb, threshold, miss), ["a", "b"]]

    size = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")  # else no intersection is large enough
    both = pairs.join(classes.select(F.col("set_id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a")
    both = join_hubs(both, classes.select(F.col("set_id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), hubs_of(pairs)).where(size)
    left = stage(both.select("a", "b", "sa", "sb").mapInPandas(prune, "a bigint, b bigint"), "near-survivors")

    # One text for each class in question, then its set.
    asked = left.select(F.col("a").alias("set_id")).union(left.select("b")).distinct()

    def sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = p["text"].tolist()
            for at in range(0, len(texts), 500):
                own = shingle_sets(texts[at : at + 500], width)
                yield pd.DataFrame({"digest": [set_digest(s) for s in own], "shingles": [s.tobytes() for s in own]})

    asked = stage(asked.join(classes.select("set_id", "digest"), "set_id"), "near-confirm")
    full = texts_of(asked, classes, source).mapInPandas(sets, "digest binary, shingles binary").join(asked, "digest").dropDuplicates(["set_id"])
    full = stage(full.select("set_id", "shingles"), "near-sets")

    def exact(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            keep = []
            for x, y in zip(p["xa"], p["xb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield p.loc[keep, ["a", "b"]]

    # A member's set travels with its pair; a pivot's is there once for each of its parts.
    both = left.join(full.select(F.col("set_id").alias("a"), F.col("shingles").alias("xa")), "a")
    both = join_hubs(both, full.select(F.col("set_id").alias("b"), F.col("shingles").alias("xb")), hubs_of(left))
    return stage(both.select("a", "b", "xa", "xb").mapInPandas(exact, "a bigint, b bigint"), "near-confirmed")


def hubs_of(pairs: DataFrame) -> DataFrame | None:
    """(b, parts) of the classes that more than HUB of the staged pairs have as their b; None where there can be none."""
    if small(pairs, HUB):
        return None
    hubs = stage(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("parts")).where("parts > 1"), "near-hubs")
    return None if hubs.isEmpty() else checked_broadcast(hubs)


def join_hubs(pairs: DataFrame, values: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """pairs joined with values on b; the pairs of a hub go to as many tasks as it has parts."""
    if hubs is None:
        return pairs.join(values, "b")
    left = pairs.join(hubs, "b", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    right = values.join(hubs, "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, ["b", "part"]).drop("part")


def drop_near_duplicates(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, all columns as they are.

    Rows without words stay.  Rows are told apart by id and text, null ids among them.  Of several rows of a component
    with the id that stays (or all without an id) one stays: that of the smallest text key, any of repeated rows.
    """
    found = stage(settled(docs, width, 80, 1e-6, id_col, text_col).where("n_shingles > 0"), "near-result")
    ids = ["doc_id", "text_key"]
    several = found.where("kept").groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.min("text_key").alias("first")).where("rows > 1")
    several = stage(found.where("kept").join(several.select("component", "first"), "component").select(*ids, "first"), "near-several")
    dropped = found.where(~F.col("kept")).select(*ids).union(several.where("text_key <> first").select(*ids))
    own_id, own_key, n = free_names(docs, "near_id", "near_key", "n")
    dropped = stage(dropped.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).distinct(), "near-dropped")

    def same(keys: DataFrame) -> Column:
        return docs[id_col].cast("long").eqNullSafe(keys[own_id]) & (text_key(docs[text_col]) == keys[own_key])

    out = docs.join(checked_broadcast(dropped), same(dropped), "left_anti")
    repeated = several.where("text_key = first").groupBy(*ids).count().where("count > 1")
    repeated = stage(repeated.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)), "near-repeated")
    if repeated.isEmpty():
        return out
    again = out.join(checked_broadcast(repeated), same(repeated), "left_semi")
    first = Window.partitionBy(F.col(id_col), text_key(F.col(text_col))).orderBy(F.lit(0))
    again = again.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(n)
    return out.join(checked_broadcast(repeated), same(repeated), "left_anti").unionByName(again)
