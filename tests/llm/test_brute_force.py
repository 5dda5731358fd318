"""Operators against plain versions of themselves, and edge cases that the round trips don't reach."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import bpe, extraction, fingerprint, language, neardup, packing, sharding, toxicity
from tests.llm.test_operators import LONG, TEXTS, brute_removed

SF = "/root/testdata/sf0.001"


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def shingle_set(text):
    words = (text or "").translate({k: k + 32 for k in range(65, 91)})
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in words).split(" ") if w]
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def components_by_hand(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, t, least.get(find(k), i)) for k, (i, t) in enumerate(rows)]


def near_table():
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(160)]
    rows = []
    for k in range(70):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(90)}"
        rows.append((k, " ".join(words)))
    other = "one two three four five six seven eight nine ten eleven twelve"
    # One id with two texts, of which the second is linked with another row; repeated rows; no id; no text.
    rows += [(101, LONG), (102, LONG + "tail"), (102, other), (103, other + " "), (103, other + " "), (None, other), (None, "alone with no id at all here"), (110, None), (111, ""), (112, "two words"), (113, "TWO  words")]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_table()
    got = neardup.near_duplicates(rows_of(spark, *rows))
    want = components_by_hand(rows)
    key = lambda x: (-1 if x[0] is None else x[0], -1 if x[1] is None else x[1])
    assert sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=key) == sorted(((i, c) for i, _, c in want), key=key)


def test_representatives(spark):
    rows = near_table()
    kept = neardup.representatives(rows_of(spark, *rows), ["doc_id", "text"]).collect()
    pairs = [(r["doc_id"], r["text"]) for r in kept]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= set(rows)
    want = components_by_hand(rows)
    assert {i for i, _ in pairs if i is not None} == {c for _, _, c in want if c is not None}
    assert (102, None) not in pairs and [t for i, t in pairs if i == 102] == ["one two three four five six seven eight nine ten eleven twelve"]
    assert [t for i, t in pairs if i is None] == ["alone with no id at all here"]


def test_forest_joins_what_all_links_join(spark, monkeypatch):
    """With tiny blocks the tiles of a bucket find the components that one would."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "RAY", 3)
    rows = near_table()[:70]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(rows_of(spark, *rows)).collect()}
    assert got == {i: c for i, _, c in components_by_hand(rows)}


def kneser_ney(texts, order):
    """Plain interpolated Kneser-Ney: {n-gram: probability} by a function."""
    grams = {}
    for t in texts:
        s = " " * (order - 2) + "".join(map(chr, language.symbols(t)))
        for k in range(len(s) - order + 1):
            grams[s[k : k + order]] = grams.get(s[k : k + order], 0) + 1
    level = {order: grams}
    for k in range(order - 1, 0, -1):
        level[k] = {}
        for g in level[k + 1]:
            level[k][g[1:]] = level[k].get(g[1:], 0) + 1
    d = {}
    for k, c in level.items():
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d[k] = one / (one + 2 * two) if one and two else 0.5 if k == 1 else 0.75
    total = sum(level[1].values())

    def p(gram):
        k = len(gram)
        if k == 1:
            return max(level[1].get(gram, 0) - d[1], 0) / total + d[1] * len(level[1]) / total / (len(level[1]) + 1)
        same = [v for g, v in level[k].items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return max(level[k].get(gram, 0) - d[k], 0) / sum(same) + d[k] * len(same) / sum(same) * p(gram[1:])

    return p


def test_language_counts_and_thresholds_come_from_all_texts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcdefg"), 4)) for _ in range(8)) for _ in range(60)]
    train = spark.createDataFrame([(t, "a") for t in [*texts, *texts[:20], "", None]], "text string, lang string")
    seen, limits = [], language.limits
    monkeypatch.setattr(language, "limits", lambda own, few: seen.extend(own) or limits(own, few))
    model = language.fit(train, order=3)
    # Every text counts in the model, copies too.
    p = kneser_ney([*texts, *texts[:20], "", ""], 3)
    grams = sorted({g for t in texts for g in (t[i : i + 3] for i in range(len(t) - 2)) if " " not in g})
    got = np.exp([model.at(np.array([ord(c) for c in g], np.uint32))[0, 0] for g in grams])
    assert max(abs(x - p(g)) for x, g in zip(got, grams, strict=True)) < 1e-5
    # Every distinct text with a letter counts once for the threshold, as a model without its part finds it.
    key = {r["text"]: r["fold"] for r in spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", f"pmod(xxhash64(xxhash64(text)), {language.FOLDS}) AS fold").collect()}
    want = []
    for k in range(language.FOLDS):
        rows = [(t, "a") for t in [*texts, *texts[:20]] if key[t] != k] + [("", "a")] * (2 if spark.sql(f"SELECT pmod(xxhash64(xxhash64('')), {language.FOLDS})").first()[0] != k else 0)
        apart = language.fit_counts(language.counted(spark.createDataFrame(rows, "text string, lang string"), 3), language.Scratch(spark, "apart"), 3)
        want += apart.entropies([t for t in texts if key[t] == k])[0][:, 0].tolist()
    found = np.repeat(seen[0][:, 0], seen[0][:, 1].astype(int))
    assert len(found) == 60 and np.allclose(np.sort(found), np.sort(want), atol=language.STEP)
    middle = np.median(found)
    assert abs(model.limit[0] - (middle + 12 * max(np.median(np.abs(found - middle)), 0.05))) < 1e-9


def test_language_model_equals_plain_kneser_ney(spark):
    texts = {"a": ["abra cadabra", "a barbara", "bab"], "b": ["berber xe", "rex"]}
    train = spark.createDataFrame([(t, lang) for lang, ts in texts.items() for t in ts] + [(None, "a"), ("nothing", None)], "text string, lang string")
    model = language.fit(train, order=3)
    for k, lang in enumerate(model.langs):
        p = kneser_ney([*texts[lang], ""] if lang == "a" else texts[lang], 3)
        for gram in ("abr", "bra", " ab", "rex", "zzz", "r x", "xab"):
            got = float(np.exp(model.at(np.array([ord(c) for c in gram], np.uint32))[0, k]))
            assert abs(got - p(gram)) < 1e-5, (lang, gram)


def test_fingerprints_equal_brute_force(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(rows_of(spark, *rows)).collect()}
    pieces = lambda t: {int(v) for v in fingerprint.digests([t])[1]}
    like = lambda a, b: 1 - len(pieces(a) ^ pieces(b)) / (len(pieces(a)) + len(pieces(b))) if pieces(a) or pieces(b) else 1.0
    for k, (i, t) in enumerate(rows):
        old, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(old) // 4
        new = old[: len(old) - n] + following[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_text"]) == (len(old), new)
        assert abs(r["near_edited"] - like(old, new)) < 1e-12 and abs(r["near_next"] - like(old, following)) < 1e-12
    with pytest.raises(TypeError):
        fingerprint.fingerprint_edits(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_best_region_equals_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        s = [rng.choice([-3, -2, -1, 0, 1, 2]) for _ in range(rng.randrange(0, 12))]
        lo, hi, top = extraction.best(s)
        every = [sum(s[i:j]) for i in range(len(s) + 1) for j in range(i, len(s) + 1)]
        assert top == max([0, *every]) and sum(s[lo:hi]) == top


def test_extraction_needs_the_scan():
    """Text under unknown names, apart from the article, is left out by the region alone; nesting and stray quotes are no matter."""
    w = extraction.learn()
    text = "Some words of the article stand here and they go on for a while."
    page = f"<div><div><div class=qz1><span>Zap</span></div></div></div><div><div><table><tr><td></td></tr></table></div></div><main><p>{text}</p><p>{text}</p></main><div><div><i></i></div></div>"
    assert extraction.main_text(page, w) == f"{text}\n\n{text}"
    whole = [t.text for t in extraction.tokens(page, w.odds) if t.kind == "word"]
    assert "Zap" in whole
    assert extraction.main_text("<div>" * 5000 + text + "</div>" * 5000, w) == text
    assert extraction.main_text(f"<p class=it's>{text}</p>", w) == text


def test_pieces_equal_the_library(spark):
    lib = Tokenizer.from_file(bpe.default_path())
    lib.no_truncation()
    lib.no_padding()
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {(r["doc_id"], r["piece"]): r for r in packing.packed_documents(rows_of(spark, *rows), bpe.default_path()).collect()}
    seen = 0
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            r = got[i, piece]
            assert (r["start"], r["length"], r["ids_crc32"]) == (start, len(part), zlib.crc32(part.tobytes()))
            seen += 1
    assert seen == len(got)


def test_shards_do_not_depend_on_files(spark):
    rows = [(k, f"text {k % 37}" if k % 3 else f"own {k}") for k in range(400)]
    a, b = rows_of(spark, *rows).repartition(7, "text"), rows_of(spark, *reversed(rows)).coalesce(1)
    place = lambda df: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(df, shards=5).collect()}
    assert place(a) == place(b)


def test_toxic_words_of_copies_count_once(spark):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in ("na", "ro", "li", "tu")]
    text = lambda n: " ".join(rng.choice(words, n))
    copied = text(30) + " uniquewordofcopies " + text(30)
    bad = [t[: len(t) // 2] + " grblsword " + t[len(t) // 2 :] + " grblsxyz" for t in (text(60) for _ in range(60))]
    rows = [(k, text(60), 0) for k in range(200)] + [(1000 + k, t, 1) for k, t in enumerate(bad)] + [(2000 + k, copied, 1) for k in range(40)]
    sample = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, y int")
    terms = toxicity.outstanding(toxicity.surroundings(sample))
    assert terms and all(" grblsword".strip().startswith(t[:5]) or t.startswith("grbls") for t in terms)
    model = toxicity.fit(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, y int"))
    scored = spark.createDataFrame([(1, text(50) + " grblsabc " + text(9)), (2, text(60)), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(scored, model).collect()}
    assert got[1] > 0.7 > got[2] and got[3] < 0.7


def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline as cp

    source = "the old mill pond stood still and the seven wizards walked around it in the pale light of a late moon ".split()
    rng = random.Random(3)
    passage = " ".join(rng.choice(source) for _ in range(70))
    rows = [(k, " ".join(rng.choice(source) for _ in range(120)), "en", "s") for k in range(20)]
    rows += [(30, rows[3][1], "en", "s"), (31, rows[4][1] + " end", "en", "s"), (32, " ".join(rng.choice(source) for _ in range(60)) + " " + passage, "en", "t"), (33, passage + " " + " ".join(rng.choice(source) for _ in range(60)), "en", "t"), (34, None, "en", "s"), (None, "a row that has no id is kept like any other one of the table", "en", "s"), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    docs = docs.select(*cp.COLUMNS)
    stages = dict(cp.STAGES)
    near = stages["near_duplicates"](spark, docs, SF)
    want = components_by_hand([(r[0], r[1]) for r in rows])
    assert sorted(r["doc_id"] for r in near.filter("doc_id IS NOT NULL").collect()) == sorted({c for _, _, c in want if c is not None})
    assert near.columns == list(cp.COLUMNS) and near.filter("doc_id IS NULL").count() == 1
    cut = stages["repeats"](spark, near.filter("doc_id IS NOT NULL"), SF)
    assert cut.columns == list(cp.COLUMNS)
    plain = brute_removed([(r["doc_id"], r["text"]) for r in near.filter("doc_id IS NOT NULL").collect()])
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {i: t.decode("utf-8", "ignore") for i, t in plain.items()}
    lib = Tokenizer.from_file(bpe.default_path())
    lib.no_truncation()
    lib.no_padding()
    packed = stages["packing"](spark, cut, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {r["doc_id"]: len(lib.encode(r["text"], add_special_tokens=False).ids) + 1 for r in cut.collect()}
    for name in ("toxicity", "language"):
        for df in (docs, docs.limit(0), docs.withColumn("score", F.lit(1)).withColumn("rejected", F.lit("x"))):
            out = stages[name](spark, df, SF)
            assert out.columns == list(cp.COLUMNS) and out.count() <= df.count()


def test_grams_and_places_of_the_language_model_without_sorting_or_searching_hashes(monkeypatch):
    rng = np.random.default_rng(3)
    # Few symbols (one small integer a gram), more (a long one), and more than a long one holds: hashes.
    for letters in (30, 3000, 70000):
        codes = np.concatenate([rng.integers(1000, 1000 + letters, 4000), rng.integers(1000, 1003, 500)] + [np.arange(1000, 71000)] * (letters > 65536)).astype(np.uint32)
        where = np.flatnonzero(rng.random(len(codes) - 3) < 0.8)
        want = Counter(tuple(codes[i : i + 4].tolist()) for i in where.tolist())
        with monkeypatch.context() as m:
            if letters < 65536:
                m.setattr(language, "hashes", None)
            rows, n = language.grams(codes, where, 4)
        assert dict(zip(map(tuple, rows.tolist()), n.tolist(), strict=True)) == want and len(rows) == len(want)
    crowded = np.arange(50, dtype=np.uint64) * np.uint64(3) + np.uint64(7)
    for keys in (np.zeros(0, np.uint64), np.unique(rng.integers(0, 2**64 - 1, 5000, np.uint64)), np.unique(np.concatenate([crowded, np.array([2**64 - 1], np.uint64)]))):
        h = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 2**64 - 1, 500, np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        places = language.Places(keys)
        with monkeypatch.context() as m:
            m.setattr(language.np, "searchsorted", None)
            pos, hit = places.of(h)
        assert hit.tolist() == np.isin(h, keys).tolist() and (keys[pos[hit]] == h[hit]).all()


def test_a_model_of_one_language_gives_its_column():
    rng = np.random.default_rng(5)
    model = language.Model(["a", "b"], 3)
    text = "some words that are known and others"
    codes = language.symbols(text)
    for k in (1, 2, 3):
        keys = np.unique(language.hashes(codes, k))[::k]
        contexts = np.unique(language.hashes(codes, k - 1))[::2] if k > 1 else np.zeros(0, np.uint64)
        for name, rows in (("logs", keys), ("backoff", contexts)):
            getattr(model, name).append(rng.normal(size=(len(rows), 2)).astype(np.float32))
        model.keys.append(keys)
        model.contexts.append(contexts)
    model.unseen = np.array([-9, -8], np.float32)
    texts = [text, "", "unknown letters: ßþ", text[5:20]]
    both, n = model.entropies(texts)
    for i in (0, 1):
        one, m = model.only(i).entropies(texts)
        assert one.shape == (4, 1) and np.allclose(one[:, 0], both[:, i], rtol=1e-12) and (n == m).all()
