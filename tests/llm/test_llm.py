"""The operators against brute force, the libraries or round trips, with nulls, empty and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellspan.llm import exact_dedup, html_extract, lang_id, near_dedup, packing, secrets, sharding, sp_wfst, token_counts, topk
from cellspan.llm.tokenizers import library

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, size int, kept string"
BASE = "the quick brown fox jumps over the lazy dog and then runs far away from here to there again and again "
ROWS = [
    (1, None, None, 1, "x"), (2, "", "en", 2, None), (3, "a  b\tc", "en", 3, "x"), (4, "a b c", "en", 4, "x"), (4, "a b c", "en", 4, "x"), (None, "a b c", None, 5, "x"),
    (6, BASE * 3, "en", 6, "x"), (7, BASE * 3 + "more", "en", 7, "x"), (8, "x" * 50_000, "en", 8, "x"), (9, 'api_key = "abcdefABCDEF123456"', "en", 9, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@given(st.lists(st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 4))
@settings(max_examples=100, deadline=None)
def test_capacity_is_smallest(sizes, n):
    def best(at, left):
        if left == 1:
            return sum(sizes[at:])
        return min(max(sum(sizes[at:k]), best(k, left - 1)) for k in range(at, len(sizes) + 1))

    cuts = [0, *sharding.cut_points(sizes, n), len(sizes)]
    assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])) == sharding.smallest_capacity(sizes, n) == best(0, n)


def test_shards(spark, odd, empty):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == len(ROWS) and sharding.shard_documents(empty).count() == 0
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"a b c")}) == 1


def test_exact_groups(spark, odd, empty):
    rows = exact_dedup.exact_groups(odd).collect()
    assert exact_dedup.exact_groups(empty).count() == 0
    same = [r for r in rows if r.text_sha256 == hashlib.sha256(b"a b c").hexdigest()]
    assert len(same) == 4 and {r.keep_id for r in same} == {3} and sum(r.kept for r in same) == 1
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7, 8, 9]


def test_packing(spark, odd, empty):
    assert packing.pack_documents(empty).count() == 0
    rows = packing.pack_documents(odd).collect()
    t, place = library("byte_bpe_50k.json"), defaultdict(list)
    for r in rows:
        place[r.sequence_id].append((r.offset, r.length))
    for x in place.values():
        x.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and x[0][0] == 0 and sum(x[-1]) <= 2048
    long = sorted((r for r in rows if r.doc_id == 8), key=lambda r: r.piece)
    ids = np.array([*t.encode("x" * 50_000, add_special_tokens=False).ids, 0], "<u4")
    assert sum(r.length for r in long) == len(ids)
    assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in long)


@given(st.text(alphabet="ab ▁é①\n\tthe", max_size=40))
@settings(max_examples=200, deadline=None)
def test_pieces_are_the_librarys(text):
    t = sp_wfst.transducer("piece_bpe_32k.model")
    ids = t.encode([text])[0].tolist()
    assert ids == library("piece_bpe_32k.model").encode(text)
    assert t.decode(ids) == text.replace("▁", " ")


def test_top_k(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding, float)).astype(int)) for r in e.collect()]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(e).collect()}
    want = {}
    for q, x in rows:
        if q % 50 == 0:
            for k, (s, v) in enumerate(sorted((-int(x @ y), v) for v, y in rows if v != q)[:5]):
                want[q, k + 1] = (v, -s)
    assert got == want
    odd = spark.createDataFrame([(0, None), (50, [1.0, None]), (100, [float("nan")]), (150, [1.0, 2.0]), (151, [1.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(odd).collect()] == [(150, 1, 151, 65536)]


def brute_components(docs, width):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent, index = {i: i for i in sets}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in index[s]).items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in sets[i]:
            index[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width=4).collect()} == want
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS) and {r.component_id for r in rows if r.doc_id in (6, 7)} == {6} and near_dedup.near_duplicates(empty).count() == 0


def test_near_copies_of_an_absent_text(spark):
    """Copies that are mostly unlike each other, some of which share an edit: the bounds drop no link between them."""
    rng = random.Random(5)
    base, docs = [f"w{k}" for k in range(250)], []
    for i in range(120):
        words = list(base)
        for part, size in ((i, rng.randint(0, 30)), (1000 + i // 3, rng.randint(0, 12))):
            at = (part * 37) % 200
            words[at : at + size] = [f"x{part}-{k}" for k in range(size)]
        docs.append((i, " ".join(words)))
    want = brute_components(docs, 4)
    assert 1 < len({c for _, c in want.values()}) < len(docs)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), width=4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_secrets(spark, odd, empty):
    assert secrets.find_secrets(empty).count() == 0
    spans = {r.doc_id: r.spans for r in secrets.find_secrets(odd).collect()}
    assert [(x.start, x.kind, x.end) for x in spans[9]] == [(0, 0, 29)] and spans[1] == spans[2] == []
    text = {r.doc_id: r.text for r in secrets.redact_secrets(odd).collect()}
    assert text[9] == '[SECRET]"' and text[1] is None and text[6] == BASE * 3


def test_one_random_run_in_each_length_class(spark):
    rng = random.Random(3)
    letters = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(48, 58)])) + "+/"
    words = ["tionationmententstion", "heitkeitlichkeitenverung", "n" * 40, "internationalisation" * 3, "again-and-" * 12]
    docs = [(i, f"see {w} here") for i, w in enumerate(words * 4)]
    runs = {100 + n: "".join(rng.choice(letters) for _ in range(n)) for n in secrets.LENGTHS}
    docs += [(i, f"the value {r} is new") for i, r in runs.items()]
    found = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert {i: [(x.start, x.kind, x.end) for x in s] for i, s in found.items() if s} == {i: [(10, 3, 10 + len(r))] for i, r in runs.items()}


def test_thresholds_rise_where_words_are_above_them(spark):
    rows = [(20, (i + 0.5) / 2000) for i in range(2000)] + [(20, 0.045)] * 500 + [(24, 1e-9)] * 50 + [(32, 0.3)]
    got = {r["class"]: r.t for r in secrets.thresholds(spark.createDataFrame(rows, "class int, p double"), 0.01).collect()}
    assert got == {20: 0.05, 24: 0.5, 32: 0.3}


def test_html():
    m = html_extract.model()
    body = "<h1>A title of words</h1><p>Some text &amp; more,  of a page.<br>It goes on.<p>And ends here, after a while.</p>"
    page = f'<html><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><article>{body}</article><div class="comments"><p>First!</p></div><footer>(c)</footer></body></html>'
    assert html_extract.main_text(page, m) == "A title of words\n\nSome text & more, of a page. It goes on.\n\nAnd ends here, after a while."
    assert html_extract.main_text("", m) == ""


def test_token_counts(spark, odd, empty, tmp_path):
    t, cache = library("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    assert token_counts.count_tokens(empty).count() == 0
    for _ in range(2):  # the second time from the cache
        got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(odd, cache_path=cache).collect())
        assert got == sorted((i or 0, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in ROWS)
    assert token_counts.read_cache(spark, cache).count() == 7


def test_languages(spark, odd, empty):
    assert lang_id.identify(empty).count() == 0
    assert {r.doc_id: r.lang_pred for r in lang_id.identify(odd).collect()}[1] == "und"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lang_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_forward_sums_all_segmentations_of_whole_words():
    """Pieces of any length and of shared slots, words beyond 24 characters, counts as in brute force."""
    sp, v = library("piece_bpe_32k.model"), lang_id.vocabulary("piece_bpe_32k.model")
    own = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    number = {}
    for index, pieces in lang_id.lattices(own, v):
        number |= {own[i]: int(pieces[k, -1, len(own[i]) - 1]) for k, i in enumerate(index)}
    assert sorted(number.values()) == list(range(len(own)))
    rng = np.random.RandomState(4)
    p = np.vstack([rng.rand(len(own), 2) ** 8, np.zeros((1, 2))])
    p /= p.sum(axis=0)
    words = ["▁a", "▁function", "▁something", "▁translationformation", "▁internationalisationsdifferentsomething", "▁é①xq"]
    logs, counts = np.zeros((len(words), 2)), np.zeros_like(p)
    for index, pieces in lang_id.lattices(words, v):
        logs[index] = lang_id.forward(pieces, p)
        counts += lang_id.expected(pieces, p, np.ones((len(index), 1)))
    want, wanted = np.zeros_like(logs), np.zeros_like(p)
    for k, w in enumerate(words):
        arcs = {(a, b): np.maximum(p[number.get(w[a:b], -1)], lang_id.UNKNOWN if b == a + 1 else 0) for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
        f, g = [np.ones(2)], {len(w): np.ones(2)}
        for b in range(1, len(w) + 1):
            f.append(sum(f[a] * arcs[a, b] for a in range(b)))
        for a in range(len(w) - 1, -1, -1):
            g[a] = sum(arcs[a, b] * g[b] for b in range(a + 1, len(w) + 1))
        want[k] = np.log(f[-1])
        for (a, b), q in arcs.items():
            wanted[number.get(w[a:b], -1)] += f[a] * q * g[b] / f[-1]
    assert np.allclose(logs, want) and np.allclose(counts, wanted)
    long = next(lang_id.lattices(["▁something" * 400], v))[1]
    assert np.isfinite(lang_id.forward(long, p)).all() and np.isfinite(lang_id.expected(long, p, np.ones((1, 1)))).all()


def test_keep_identified(spark):
    """Without labels all lettered texts stay; with them the model rejects long texts of no language, and nothing else."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    clean = {r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text))}
    junk = "Привет как дела сегодня хорошая погода " * 10
    some = docs.where("doc_id < 3").collect()[0].text
    odd = [(-1, junk, None), (-2, "1234 !!", "en"), (-3, None, "en"), (-4, some + " " + "qzx7" * 2000, None), (-5, "Zyzzyva", None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    assert sorted(r.doc_id for r in lang_id.keep_identified(docs).collect()) == sorted(clean | {-4, -5})
    for labels in ("cast(null as string)", "if(crc32(cast(doc_id as string)) % 5 = 0, lang, null)"):
        blind = docs.selectExpr("doc_id", "text", f"{labels} as lang")
        assert sorted(r.doc_id for r in lang_id.keep_identified(blind).collect()) == sorted(clean | {-1, -4, -5})


def test_near_copies_of_null_and_shared_ids_are_dropped_by_row(spark):
    near, own, other = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [
        (1, near, "a"), (5, near + " more", "gone: near copy of 1"), (5, own, "b"),  # one id, a near copy and a clean text
        (7, other, "c"), (7, "an entirely unlike text of some words", "d"), (8, "", "e"), (8, None, "f"), (8, "  ", "g"),
        (None, near + " and more", "gone: near copy of 1"), (None, own + " end", "gone: near copy of 5"), (None, "a text without an id that has no copy", "h"),
        (None, "first " + other[::-1], "i"), (None, "first " + other[::-1] + " end", "i"), (9, "repeated " + own[::-1], "j"), (9, "repeated " + own[::-1], "j"),
        (10, near[::-1], "k"), (10, near[::-1] + " end", "k"),
    ]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, note string"))
    assert kept.columns == ["doc_id", "text", "note"] and sorted(r.note for r in kept.collect()) == list("abcdefghijk")


def test_top_k_of_wide_and_repeated_rows(spark):
    """Against brute force in Python's integers: huge and tiny components, repeated ids and vectors, clashing names, no rows."""
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.1, -0.1, -1e-20, 2.5, 3e38, -3e38, 7e6]) * rng.random() for _ in range(3)], i) for i in range(40)]
    rows += [(50, [1.0, 2.0, 3.0], 1), (50, [1.0, 2.0, 3.0], 2), (50, [-1.0, 0.5, 0.0], 3), (100, [1e300, 0.0, 0.0], 4), (None, [1.0, 1.0, 1.0], 5), (150, [], 6)]
    whole = [(i, [floor(256 * v) for v in x]) for i, x, _ in rows if i is not None and x and max(map(abs, x)) < 1e90]
    want = Counter()
    for i, x in {(i, tuple(x)) for i, x in whole if i % 50 == 0}:
        scores = sorted((-max(min(sum(a * b for a, b in zip(x, y)), topk.HIGH), topk.LOW), j) for j, y in whole if j != i)
        want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:5]))
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int")
    assert Counter(map(tuple, topk.top_k(table).collect())) == want
    assert topk.top_k(table.limit(0)).collect() == []


def test_pruning_loses_no_row():
    """Candidates in several blocks, thresholds known: the k best stay."""
    rng = np.random.RandomState(1)
    x = np.floor(rng.randn(5000, 16) * rng.rand(5000, 1) * 500)
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    q, rotation = x[:40], np.linalg.svd(x.T @ x)[0]
    i, ids, score = topk.best_rows(q, np.arange(40), x, np.arange(5000), rotation, np.full(40, -np.inf), 5)
    for k in range(40):
        s = (x.astype(int) @ q[k].astype(int)).tolist()
        assert list(zip(score[i == k], ids[i == k])) == [(a, b) for a, b in sorted(((v, j) for j, v in enumerate(s) if j != k), key=lambda t: (-t[0], t[1]))[:5]]


def test_token_cache_with_repeated_digests(spark, odd, tmp_path):
    cache = f"file://{tmp_path}/twice"
    first = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(odd, cache_path=cache).collect())
    stored = token_counts.read_cache(spark, cache)
    spark.createDataFrame(stored.collect(), stored.schema).write.mode("append").parquet(cache)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(odd, cache_path=cache).collect()) == first


def clashing(spark):
    """Rows whose other columns have names that operators might use inside."""
    names = ["__id", "__sha", "__n", "__key", "__spans", "spans", "span_id", "span_key", "kept_id", "kept_sha", "n", "rid", "key", "digest", "set_id", "text_key", "text_sha256", "kept", "start", "end", "lang"]
    schema = "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in names)
    texts = [(1, "a b c"), (2, "a  b c"), (2, "other"), (3, 'secret = "abcdefABCDEF123456"'), (None, "a b c"), (4, None), (5, BASE * 3), (6, BASE * 3 + "more")]
    return spark.createDataFrame([(i, t, *(f"{c}{k}" for c in names)) for k, (i, t) in enumerate(texts)], schema)


def test_columns_of_any_name_stay(spark):
    docs = clashing(spark)
    for function, gone in ((exact_dedup.drop_copies, 2), (near_dedup.drop_near_duplicates, 3), (secrets.redact_secrets, 0), (lang_id.keep_identified, 1)):
        got = function(docs)
        assert got.columns == docs.columns
        rows = got.collect()
        assert len(rows) == docs.count() - gone, function
        assert all(r["__n"][3:] == r["spans"][5:] == r["end"][3:] for r in rows)
    for function in (sharding.shard_documents, packing.pack_documents, secrets.find_secrets, token_counts.count_tokens, sp_wfst.encode_digest, near_dedup.near_duplicates, lang_id.identify, exact_dedup.exact_groups):
        assert function(docs).count() >= docs.count()


def test_pieces_of_a_table(spark, odd, empty):
    """Digests and ids of whole rows against the library, and back."""
    sp = library("piece_bpe_32k.model")
    assert sp_wfst.encode_digest(empty).count() == sp_wfst.encode_documents(empty).count() == 0
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True) for i, t, *_ in ROWS for x in [sp.encode(t or "")])
    assert Counter(map(tuple, sp_wfst.encode_digest(odd).collect())) == want
    back = sp_wfst.decode_ids(sp_wfst.encode_documents(odd).withColumn("decoded", F.lit(1))).collect()
    assert len(back) == len(ROWS) and all(r.decoded == r.text and list(r.ids) == sp.encode(r.text) for r in back)
    assert sp_wfst.decode_ids(spark.createDataFrame([(None,), ([],)], "ids array<int>")).collect()[0].decoded is None


def test_normaliser_is_read_from_the_file():
    field = lambda k, v: bytes([k << 3 | 2, len(v)]) + v
    flag = lambda k, v: bytes([k << 3, v])
    n = sp_wfst.Normaliser.of(field(1, b"x") + field(3, field(1, b"identity") + flag(3, 0) + flag(4, 1)))
    assert n("  a  b ") == "a▁b" and sp_wfst.Normaliser.of(field(3, flag(4, 0)))(" a") == "▁▁a"
    for refused in (field(2, b"table"), flag(5, 0)):
        with pytest.raises(ValueError):
            sp_wfst.Normaliser.of(field(3, refused))


LEAD = "The first results came in after a long winter, and they were better than anyone at the station had hoped. Nobody slept."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><body>{LEAD}<p>{LEAD}</body></html>", [LEAD, LEAD]),
        (f'<body><nav><a href="/">Home</a></nav><div>{LEAD}<div>{LEAD}</div></div></body>', [LEAD, LEAD]),
        (f"<article><h1>A river</h1><p>{LEAD}</p><h2>Sources</h2><ul><li><a href=1>One source</a></li><li><a href=2>Another of them</a></li></ul></article>", ["A river", LEAD, "Sources", "One source", "Another of them"]),
        (f"<article><p>{LEAD}</p><aside><p>Read also: <a href=x>that</a></p></aside><p>{LEAD}</p></article>", [LEAD, LEAD]),
        (f"<article><p>{LEAD}</p></article><section class=reader-comments><h3>Say</h3><p>{LEAD}</p></section>", [LEAD]),
        (f"<article><h1>A play</h1>{'<p>Never mind.</p>' * 60}<p>{LEAD}</p></article><footer>All rights reserved.</footer>", ["A play", *["Never mind."] * 60, LEAD]),
        (f"<p>{LEAD}", [LEAD]),
        ('<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><footer>&copy; 2020</footer>', []),
    ],
)
def test_main_text_of_odd_pages(page, want):
    assert html_extract.main_text(page, html_extract.model()) == "\n\n".join(want)


def test_main_text_of_layouts_that_were_not_learnt():
    """Words of main texts found and kept clean on layouts, class names and texts that the training pages don't have."""
    rng, found, right, all_ = random.Random(11), 0, 0, 0
    say = lambda n: " ".join(rng.choice(["Ships", "came", "late", "but", "nobody", "minded,", "as", "bread", "was", "cheap", "again."]) for _ in range(n))
    tops = ['<div class="masthead"><a href="/">Globe</a> <a href="/w">Weather</a></div>', '<header role="banner"><nav class="primary"><ul><li><a href="/a">Arts</a><li><a href="/b">Books</a></ul></nav></header>', "<center><a href=/>Index</a> - <a href=/n>Next</a></center>"]
    sides = ['<div class="sidebar-right widget"><h4>{}</h4><ul><li><a href="/x">{}</a></li></ul></div>', '<aside id="secondary"><h3>{}</h3><p>{}</p></aside>', '<div class="ad-slot ad"><p>{} {}</p></div>', '<form id="signup-form"><p>{} {}</p><input></form>']
    ends = ['<div id="comments-area" class="comments"><ol><li class="comment"><p>{}</p></li></ol></div>', '<footer id="colophon"><p>{}</p></footer>', '<section class="user-comments"><p>{}</p></section>']
    shells = ['<div class="hentry post-12"><h1>{0}</h1>{1}</div>', '<main><h1>{0}</h1>{1}</main>', '<article class="single"><header><h1>{0}</h1></header><div class="prose">{1}</div></article>', '<div id="body-copy"><h2>{0}</h2>{1}</div>', "<section id=text><h1>{0}</h1><div>{1}</div></section>"]
    for i in range(200):
        words = lambda t: Counter(re.findall(r"\w+", t))
        head, body = say(4), [say(rng.randint(8, 120)) for _ in range(rng.randint(2, 9))]
        inner = "".join(f"<p>{t}</p>" if k % 4 else f"<h3>{say(3)}</h3><p>{t}</p>" for k, t in enumerate(body))
        text = re.sub("<[^>]+>", " ", inner) + " " + head
        page = tops[i % 3] + sides[i % 4].format(say(2), say(5)) + shells[i % 5].format(head, inner) + sides[(i + 1) % 4].format(say(2), say(9)) + ends[i % 3].format(say(14))
        got, want = words(html_extract.main_text(f"<html><body>{page}</body></html>", html_extract.model())), words(text)
        found, right, all_ = found + (got & want).total(), right + got.total(), all_ + want.total()
    precision, recall = found / right, found / all_
    print("precision", precision, "recall", recall)
    assert 2 * precision * recall / (precision + recall) >= 0.95


def test_pages_of_a_table(spark):
    pages = [(1, "u", f"<article><p>{LEAD}</p></article>", "x"), (1, "u", f"<article><p>{LEAD}</p></article>", "x"), (2, None, None, "y"), (None, "v", "", None), (3, "w", f"<article>{f'<p>{LEAD}</p>' * 3000}</article>", "z")]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string, text string")
    rows = html_extract.extract_pages(table).collect()
    assert sorted((r.page_id or 0, r.url, r.n_chars) for r in rows if r.page_id in (1, 3)) == [(1, "u", len(LEAD))] * 2 + [(3, "w", 3000 * (len(LEAD) + 2) - 2)]
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in rows if r.page_id in (2, None)} == {(2, None, "", 0), (None, "v", "", 0)}
    assert html_extract.extract_pages(table.limit(0)).collect() == []
