"""Operators against brute force, round trips and held-out rows on small fixtures, and their edge cases."""



import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm import bpe, extraction, fingerprint, language, neardup, neighbours, packing, sharding, suffixes, toxicity
from llm.queries import ORACLES, QUERIES
from tests.oracle import difference

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over the lazy dog while seven wizards box with a very grumpy toad near the old mill pond "
TEXTS = [None, "", "a", LONG * 3, LONG * 3, "x " + LONG + "y", LONG + "z", "é" * 150, "= " * 200, None, "word " * 5000, "tiny text"]
#: One column more, whose name clashes with what operators call their own.
EXTRA = "doc_id long, text string, score string, row string, n string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "s", "r", "n") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3]], EXTRA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


def test_oracle(spark):
    assert difference(spark, SF, QUERIES["op9_neardup"], ORACLES["op9_neardup"]) == ""


def test_bpe_equals_library(docs, none):
    lib = Tokenizer.from_file(bpe.default_path())
    lib.no_truncation()
    lib.no_padding()
    mine = bpe.WordBpe(bpe.default_path())
    for t in [t for t in TEXTS if t] + ["İΣ it's we'll ''s a\x1cb 漢字 ²½ <|endoftext|>x", " \x85\xa0 "]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids
        assert mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(docs, bpe.default_path()).count() == docs.count()
    assert bpe.encode_decode(none, bpe.default_path()).count() == 0


def brute_removed(rows):
    seen, out = set(), {}
    for i, t in sorted(set(rows)):
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        out[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("frequent", [2000, 0])
def test_suffixes_equal_brute_force(docs, none, frequent):
    want = brute_removed([(i * 3, t) for i, t in enumerate(TEXTS)])
    got = suffixes.removed(docs, frequent=frequent).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == want
    assert suffixes.removed(none).count() == 0


def common_line(n, same):
    """Texts of n documents with ids of their own: a line that all hold, between words of each one's own; every third has `same` before it."""
    line = "".join(chr(97 + k * k % 23) + " " * (k % 7 == 0) for k in range(160))
    own = lambda k: " ".join(f"{zlib.crc32(bytes([j, k % 251, k // 251])):08x}" for j in range(30))
    return [(k, own(k) + (same if k % 3 == 0 else " ") + line + own(k + n)) for k in range(n)]


@pytest.mark.parametrize("frequent", [2000, 50, 3])
def test_suffixes_of_frequent_anchors_equal_brute_force(spark, frequent):
    rows = common_line(120, " some words that only a third of the documents have before it ")
    got = suffixes.removed(spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == brute_removed(rows)


def test_frequent_anchors_do_not_multiply_what_is_sorted(spark, monkeypatch):
    # A line with other surroundings in each document: what is dealt out to the sorts stays in proportion to the texts.
    rows, moved, sort = common_line(300, " "), [], suffixes.sorted_repeats

    def spy(frame, length):
        moved.append(frame.selectExpr("coalesce(sum(octet_length(context)), 0) AS n").first()["n"])
        return sort(frame, length)

    monkeypatch.setattr(suffixes, "sorted_repeats", spy)
    assert suffixes.removed(spark.createDataFrame(rows, "doc_id long, text string"), frequent=20).count() == 300
    assert 0 < moved[0] < 4 * sum(len(t) for _, t in rows)


def test_copies_are_not_sorted(spark, monkeypatch):
    # Contexts that all equal one another need no sort: only the different ones of an anchor travel as bytes.
    own, moved, sort = common_line(40, " "), [], suffixes.sorted_repeats
    rows = [(k + 40 * c, t) for c in range(5) for k, t in own]

    def spy(frame, length):
        moved.append(frame.count())
        return sort(frame, length)

    monkeypatch.setattr(suffixes, "sorted_repeats", spy)
    got = suffixes.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == brute_removed(rows)
    assert moved[0] < 10 * len(own)


def test_suffix_sort_orders_suffixes():
    data = np.frombuffer(b"banana bandana banana", np.uint8)
    pos = np.arange(len(data))
    size = len(data) - pos
    order, ext = suffixes.suffix_sort(data, fingerprint.prefix_hashes(data), np.zeros(len(data), int), pos, size)
    raw = data.tobytes()
    assert [raw[k:] for k in order] == sorted(raw[k:] for k in pos)
    assert all(raw[a : a + e] == raw[b : b + e] for a, b, e in zip(order, order[1:], ext[1:], strict=False))


def test_fingerprints(docs, none):
    got = fingerprint.fingerprint_edits(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(TEXTS[r["doc_id"] // 3] or "", set()).add(r["fingerprint"])
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert all(len(v) == 1 for v in by.values())
    assert fingerprint.fingerprint_edits(none).count() == 0


def test_sketches_peel_to_the_difference():
    a, b = fingerprint.digests(["one\ntwo\nthree\n" * 9]), fingerprint.digests(["one\ntwo\nfour\n" * 9])
    left, right, took = fingerprint.compare(a, b, 1, cells=3)
    assert left[0] == len(set(a[1]) - set(b[1])) and right[0] == len(set(b[1]) - set(a[1])) and took[0] > 3


def test_packing(docs, none):
    rows = packing.packed_documents(docs, bpe.default_path()).collect()
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(rows) == docs.count() + sum(r["piece"] > 0 for r in rows)
    assert packing.packed_documents(none, bpe.default_path()).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    n, c = np.unique(rng.integers(1, 2049, 20_000), return_counts=True)
    placed, made = packing.plan(dict(zip(n.tolist(), c.tolist(), strict=True)))
    assert placed[:, 2].sum() == 20_000 and made <= 1.02 * (n * c).sum() / 2048


def test_extraction(spark):
    page = "<body><nav><a href=/>Home</a></nav><div class=content><h1>T &amp; x</h1><p>Some words   here<br>more of them.<p>Second one stands here.</div><div class='ad'>Buy it</div><footer>c</footer>"
    rows = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, "w", ""), (4, "x", "<<<>&#")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(rows).collect()}
    assert got[1] == "T & x\n\nSome words here more of them.\n\nSecond one stands here."
    assert got[2] == got[3] == ""
    assert extraction.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["<body class='single no-ads'>", "<main id=search>", "<div class='content no-sidebar'>", "<div class='post comment-open'>", "<div class='post category-legal'>", "<div class=legal>", "<form>"])
def test_extraction_keeps_containers(tag):
    text = "Some words of the article stand here and they go on for a while."
    assert extraction.main_text(f"<nav class=x>Home</nav>{tag}<p>{text}</p><p>{text}</p>", extraction.learn()) == f"{text}\n\n{text}"


def test_extraction_keeps_captions_and_endings():
    text = "Some words of the article stand here and they go on for a while."
    aside = "<aside>" + "<p>related words on other pages stand here</p>" * 40 + "</aside>"
    page = f"<article><p>{text * 3}</p><figure><figcaption>A caption</figcaption></figure><p>E <math><mi>x</mi></math> y</p>{aside}<p>The very last words.</p></article><div class='site-footer'>c</div>"
    assert extraction.main_text(page, extraction.learn()) == f"{text * 3}\n\nA caption\n\nE x y\n\nThe very last words."


def test_sharding(docs, none):
    rows = sharding.assign(docs, shards=4).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == docs.count() and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())
    assert sharding.assign(none).count() == 0


def test_sharding_keeps_groups_that_fit_whole(spark):
    texts = ["hot"] * 400 + [f"pair {k}" for k in range(300) for _ in range(2)] + [f"one {k}" for k in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    where, sizes = {}, {}
    for r in sharding.assign(rows, shards=8).collect():
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + 1
    assert set(sizes.values()) == {150}
    assert [t for t, s in where.items() if len(s) > 1] == ["hot"]


def test_near_duplicates_edges(docs, none):
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got[9] == got[12] == 9 and got[0] == 0 and got[3] == 3
    assert neardup.near_duplicates(none).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16)).astype("float32")
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id")
    got = neighbours.search(df, q, nearest=5).collect()
    hits, x = 0, x.astype(float)
    for i in range(0, 400, 20):
        s = x @ x[i]
        s[i] = -np.inf
        want = set(np.lexsort((np.arange(400), -s))[:5])
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == i)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s[v] - sc) < 1e-9 for _, v, sc in mine)
        hits += len(want & {v for _, v, _ in mine})
    assert hits >= 90
    assert neighbours.search(df.limit(0), q.limit(0)).count() == 0


def test_neighbours_grow_until_recall_holds(spark):
    x = np.random.default_rng(4).standard_normal((3000, 32)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.search(df, df.filter("vec_id % 60 = 0").selectExpr("vec_id AS query_id"), tables=2, probes=4).collect()
    hits, x = 0, x.astype(float)
    for i in range(0, 3000, 60):
        s = x @ x[i]
        s[i] = -np.inf
        mine = {r["vec_id"] for r in got if r["query_id"] == i}
        assert len(mine) == 20
        hits += len(mine & set(np.argsort(-s)[:20]))
    assert hits >= 0.9 * 50 * 20


def test_language(spark, docs, none):
    train = spark.createDataFrame([(LONG * 4, "en"), ("der schnelle braune fuchs springt über den faulen hund und läuft davon " * 6, "de")] * 3, "text string, lang string")
    model = language.fit(train)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert got[0] == got[3] == got[24] == "und" and got[9] == "en"
    assert language.identify(none, model).count() == 0 and language.fit(train.limit(0)) is None
    probs = sum(np.exp(model.at(np.array([32, 32, 116, c], np.uint32))[0]) for c in {ord(c) for c in LONG + "übdfszäi"})
    assert (probs <= 1.05).all()  # every unseen symbol gets the share of all of them


def test_language_every_language_gets_a_threshold(spark):
    words = {"en": LONG.split(), "de": "der schnelle braune fuchs springt über den faulen hund und läuft davon".split(), "fr": "le renard brun saute par dessus le chien paresseux et il part".split()}
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice(words[lang], 20)), lang) for lang, n in (("en", 40), ("de", 40), ("fr", 3)) for _ in range(n)]
    rows += [rows[0]] * 200
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), calibrate=25)
    assert np.isfinite(model.limit).all()
    some = spark.createDataFrame([(1, rows[80][0]), (2, "xqzw " * 40)], "doc_id long, text string")
    assert {r["doc_id"]: r["rejected"] for r in language.identify(some, model).collect()} == {1: False, 2: True}


def test_toxicity(spark, docs, none):
    words = LONG.split()
    rng = np.random.default_rng(3)
    clean = [" ".join(rng.choice(words, 60)) for _ in range(120)]
    bad = [t[:150] + " dreadfulness " + t[150:] + " horribleword dreadfulness" for t in clean[:60]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(clean + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 120)) for i in range(180)], "doc_id long, toxic int")
    model = toxicity.fit(rows, toxicity.marks(labels))
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(rows, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([(s >= 0.7) == (i >= 120) for i, s in got]) > 0.9
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(none, model).count() == 0
    assert toxicity.fit(rows, toxicity.marks(labels.filter("toxic = 0"))) is None


def test_pipeline(spark):
    import corpus_pipeline as cp

    rows = cp.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows.columns)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[2:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(texts) - {0} <= {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
