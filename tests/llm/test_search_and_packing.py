"""Hard negatives, ranked search and harmonic packing against plain Python, with nulls, ties, repeated rows and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellspan.llm import hard_negatives, harmonic, lexical, queries
from cellspan.llm.tokenizers import library

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, length int, worker string, `a.b` int"


def check_packing(rows, texts, size=2048, end=1):
    """texts: (doc_id, text) of every document; rows are their pieces."""
    one = library("byte_bpe_50k.json")
    ids = lambda t: [*one.encode(t or "", add_special_tokens=False).ids, end]
    due = Counter()
    for doc_id, text in texts:
        own = np.array(ids(text), "<u4")
        edges = np.cumsum([0, *harmonic.lengths(len(own), size)]).tolist()
        due.update((doc_id, a, b - a, zlib.crc32(own[a:b].tobytes()), len(own)) for a, b in zip(edges, edges[1:]))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == due
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    used = []
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        used.append(at)
    assert all(n <= size and n & (n - 1) == 0 for n in used)  # full, or at a smaller power of two: no padding
    short = [n for n in used if n < size]
    assert len(set(short)) == len(short)


@given(st.integers(0, 9000), st.sampled_from([1, 2, 64, 2048]))
def test_lengths(n, size):
    own = harmonic.lengths(n, size)
    assert sum(own) == n and own == sorted(own, reverse=True) and all(size % x == 0 for x in own)


def test_harmonic_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_packing(queries.op13_harmonic_packing(spark, SF).collect(), texts)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_harmonic_edges(spark, parts):
    rng = random.Random(parts)
    rows = [(1, None), (2, ""), (None, "a b"), (3, "same text"), (3, "same text"), (4, "word " * 9000)] + [(k, "x y " * rng.randrange(90)) for k in range(5, 60)]
    docs = spark.createDataFrame([(*r, 1, "w", 2) for r in rows], DOCS).repartition(parts)
    check_packing(harmonic.pack_harmonic(docs).collect(), rows)
    check_packing(harmonic.pack_harmonic(docs, max_len=64).collect(), rows, 64)
    assert harmonic.pack_harmonic(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        harmonic.pack_harmonic(docs, max_len=100)


def brute_search(docs, items, k=10):
    """Every document against every item, as the formula says."""
    words = [(i, Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    n, total, df = len(words), sum(sum(c.values()) for _, c in words), Counter(t for _, c in words for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        asked = set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        found = []
        for i, c in words:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def searched(docs, items, **more):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank_documents(docs, items, **more).collect())


def test_search_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in queries.op12_lexical_search(spark, SF).collect()) == brute_search(docs, items)


@pytest.mark.parametrize("blocks", [(128, 1 << 22, 4096), (2, 1, 2)])
def test_search_edges(spark, monkeypatch, blocks):
    """Small blocks, groups of one block and passes of two queries give the same as large ones."""
    for name, v in zip(("DOCS", "HELD", "QUERIES"), blocks):
        monkeypatch.setattr(lexical, name, v)
    rng = random.Random(5)
    docs = [(1, None), (2, ""), (3, "--- !!"), (None, "alpha beta"), (None, "alpha beta"), (4, "Alpha BETA"), (4, "Alpha BETA"), (5, "ÄPFEL alpha ñ"), (6, "alpha " * 30_000)]
    docs += [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x1", "日本語"]) for _ in range(rng.randrange(1, 40)))) for k in range(7, 120)]
    items = [(1, "alpha, beta"), (2, None), (3, "..."), (None, "gamma"), (4, "gamma gamma DELTA"), (4, "gamma gamma DELTA"), (4, "日本語 ñ"), (5, "nowhere"), (6, "äpfel ÄPFEL")]
    d = spark.createDataFrame([(*r, 1, "w", 2) for r in docs], DOCS).repartition(5)
    i = spark.createDataFrame([(*r, 7) for r in items], "item_id bigint, text string, q int")
    assert searched(d, i) == brute_search(docs, items)
    assert searched(d, i, k=1) == brute_search(docs, items, 1)
    assert searched(d.limit(0), i) == searched(d, i.limit(0)) == Counter()


def test_search_with_keys_of_other_types(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id int, text string")
    items = spark.createDataFrame([("first", "two")], "item_id string, text string")
    assert [(r.item_id, r.doc_id) for r in lexical.rank_documents(docs, items).collect()] == [("first", 1)]


def brute_negatives(rows, every=100, n_positive=5, n_negative=10):
    good = []
    for i, label, v in rows:
        if i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v):
            good.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * c) for c in v)))
    out = Counter()
    for a, label, x in set(g for g in good if g[0] % every == 0):
        scored = sorted((-sum(p * q for p, q in zip(x, v)), i, of) for i, of, v in good if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:n_positive]:
            near = [(t, i) for t, i, of in scored if of != label and 30 * -s <= 100 * -t <= 90 * -s][:n_negative]
            out.update((a, p, r, i, -s, -t) for r, (t, i) in enumerate(near, 1))
    return out


def mined(df, **more):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.mine(df, **more).collect())


VECTORS = "vec_id bigint, label int, embedding array<float>, part int, `group` string, `a.b` int"


def test_negatives_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    got = Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in queries.op11_hard_negatives(spark, SF).collect())
    assert got == brute_negatives(rows) and sum(got.values()) > 0


@pytest.mark.parametrize("sizes", [(64, 2048, 2048), (3, 20, 16)])
def test_negatives_edges(spark, monkeypatch, sizes):
    """Clusters of unlike lengths, equal vectors, unlike dimensions, odd values; small groups and parts give the same as large ones."""
    for name, v in zip(("PIVOTS", "SAMPLE", "LEAST"), sizes):
        monkeypatch.setattr(hard_negatives, name, v)
    rng = random.Random(sizes[0])
    rows = [(None, 1, [1.0, 0.0]), (100, None, [1.0, 0.0]), (200, 1, None), (300, 1, []), (400, 1, [1.0, None]), (500, 1, [float("nan"), 1.0]), (600, 1, [float("inf"), 1.0])]
    rows += [(100, 2, [0.5, 0.5, 0.125]), (100, 2, [0.5, 0.5, 0.125]), (100, 3, [0.5, 0.5]), (800, 11, [0.0, 0.0, 0.0]), (900, -4, [-1.0, -1.0, 0.0])]
    for k in range(1, 400):
        centre, length = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1)][k % 4], rng.choice([0.5, 1, 3])
        rows.append((1000 + k, rng.choice([0, 0, 0, 1, 2, 9, 11]), [round(16 * length * (c + rng.gauss(0, 0.2))) / 16 for c in centre]))
    df = spark.createDataFrame([(*r, 1, "g", 2) for r in rows], VECTORS).repartition(4)
    assert mined(df, every=20) == brute_negatives(rows, 20)
    assert mined(df, every=100, positives=2, negatives=1) == brute_negatives(rows, 100, 2, 1)
    assert mined(df.limit(0)) == Counter()
    assert mined(df.where("label = 99")) == Counter()


def test_bounds_spare_far_rows(spark, monkeypatch):
    """Of clusters that lie far apart, groups of anchors are sent the rows near them only, and the result is whole."""
    monkeypatch.setattr(hard_negatives, "LEAST", 16)
    copied, dealt = [], hard_negatives.dealt
    monkeypatch.setattr(hard_negatives, "dealt", lambda *a: dealt(*a, copied=copied))
    rng = random.Random(1)
    rows = [(k, k % 2, [10.0 * (k % 8 == c) + rng.gauss(0, 0.05) for c in range(8)]) for k in range(1, 1600)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    assert mined(df, every=10) == brute_negatives(rows, 10)
    groups, sent = copied[0].select("group").distinct().count(), copied[0].count()
    assert groups > 1 and sent < 0.6 * groups * len(rows)


@given(st.integers(0, 10**6), st.integers(-(10**6), 10**6))
@settings(deadline=None)
def test_windows(positive, score):
    a, b = hard_negatives.window_of(positive, 30, 90)
    assert (a <= score <= b) == (30 * positive <= 100 * score <= 90 * positive)


def test_wide_scores_are_exact():
    a, b = np.array([[float(1 << 40), 3.0]]), np.array([[float(1 << 41), 5.0], [1e60, 0.0], [-1e60, 0.0]])
    assert hard_negatives.scores(a, b).tolist() == [[hard_negatives.HIGH, hard_negatives.HIGH, hard_negatives.LOW]]
    assert hard_negatives.scores(a[:, 1:], b[:, 1:]).tolist() == [[15, 0, 0]]
    assert hard_negatives.scores(np.array([[float(1 << 30), 1.0]]), np.array([[float(1 << 30), 1.0]])).tolist() == [[(1 << 60) + 1]]
