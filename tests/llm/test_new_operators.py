"""Divergence, mixing and centroids against SQL and plain versions, and their edge cases."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from llm import centroids, divergence, mixing
from llm.queries import ORACLES, QUERIES
from tests.oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_divergence", "op12_mixing", "op13_centroids"])
def test_query_equals_its_sql(spark, name):
    assert difference(spark, SF, QUERIES[name], ORACLES[name]) == ""


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text or "").split(" ")


def audited(rows):
    """The plain rule over rows of (lang, source, text)."""
    rows = [(a or "", b or "", [w for w in words(t) if w]) for a, b, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        docs = Counter(w for r in mine for w in set(r[2]))
        kept = {w for w, n in docs.items() if n >= divergence.LEAST}
        counts = {s: Counter(w for r in mine if r[1] == s for w in r[2] if w in kept) for s in {r[1] for r in mine}}
        whole = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted((-sum(apart(p[s][w], p[o][w]) for w in kept), o.encode()) for o in counts if o != s)
            terms = sorted((-apart(p[s][w], q[w]), w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w])[:10]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(ranked)]
    return sorted(out)


def made(n=400):
    rng = np.random.default_rng(3)
    vocabulary = ["a", "B", "é", "漢字", "tree-house", "x_y", "É", *[f"w{k}x" for k in range(40)], *[chr(97 + k) * 3 for k in range(26)]]
    rows = []
    for _ in range(n):
        text = " ".join(rng.choice(vocabulary, rng.integers(0, 30), p=None))
        rows.append((rng.choice(["en", "de", None]), rng.choice(["s1", "S1", "ß", None, *[f"s{k}" for k in range(12)]]), None if rng.random() < 0.05 else text))
    return [(None if a is None else str(a), None if b is None else str(b), t) for a, b, t in rows]


@pytest.mark.parametrize(("terms", "groups"), [(65_536, 8), (7, 2), (1, 1), (3, 5)])
def test_divergence_equals_the_plain_rule(spark, monkeypatch, terms, groups):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "GROUPS", groups)
    rows = made() + [("xx", "lone", "only one"), ("yy", "a", ""), ("yy", "b", None)]
    df = spark.createDataFrame([(a, b, t, "clash", 1) for a, b, t in rows], "lang string, source string, text string, term string, n int")
    got = sorted(tuple(r) for r in divergence.audit(df).collect())
    assert got == audited(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact():
    for total, kept in ((10**15, 10**6), (9, 1), (9 * 10**15, 3)):
        counts = np.array([0, 1, total // 3, total], np.int64)
        assert divergence.shares(counts, total, kept).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * kept) for c in counts]


def test_long_texts_are_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 5)
    text = b"aaaa bbbb cc dddddddddddd e"
    assert b" ".join(p.strip() for p in divergence.pieces(text)).split() == text.split() and len(divergence.pieces(text)) > 2


def filled(sizes):
    """Shares by weight, the excess dealt out again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= 2 * sizes[s]
        free -= over
    return out


def documents(spark, seed=1, n=900):
    rng = np.random.default_rng(seed)
    rows = [(k, " \t".join(["w"] * int(rng.integers(0, 60))), ["a", "B", None, "é", "z"][int(rng.choice(5, p=[0.6, 0.1, 0.1, 0.1, 0.1]))]) for k in range(n)]
    rows += [(None, "no id", "a"), (None, None, "a"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (7, "other text", "B"), (9999, "w " * 5000, "z"), (1, None, "empty")]
    return rows, spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, source string, size string, key double")


@pytest.mark.parametrize("per_range", [20_000, 10])
def test_mixing(spark, monkeypatch, per_range):
    monkeypatch.setattr(mixing, "ROWS", per_range)
    rows, df = documents(spark)
    quality = spark.createDataFrame([(k, float(k % 2)) for k in range(0, 900, 3)] + [(3, 0.0), (None, 1.0)], "doc_id long, quality double")
    got = mixing.mix(df, quality).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7), quality).collect()))
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sizes = {s: sum(len((t or "").split()) for _, t, o in rows if o == s) for s in {r[2] for r in rows}}
    for s, target in filled(sizes).items():
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert all(math.isclose(r["target"], target) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= 5
        epochs = int(target // sizes[s]) if sizes[s] else 0
        assert all(r["taken"] in (epochs * r["size"], (epochs + 1) * r["size"]) for r in mine)
    assert mixing.mix(df.limit(0)).count() == 0


def test_better_documents_come_first(spark):
    rows = [(k, "one two three four", "abc"[k % 3]) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    good = lambda k: k // 3 % 2 == 0
    quality = spark.createDataFrame([(k, float(good(k))) for k in range(6000)], "doc_id long, quality double")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df, quality).collect() if r["source"] == "b"}
    # Source b gives five sixths of its words: weights 2 and 0.5 take nearly all good ones and two thirds of the others.
    share = lambda which: sum(t > 0 for k, t in taken.items() if good(k) == which) / 1000
    assert share(True) > 0.95 and 0.6 < share(False) < 0.72


def lloyd(rows, k, rounds):
    kept = sorted(((i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows), key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    near = lambda v, cs: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))
    cs = [v for _, v in kept[:k]]
    for _ in range(rounds):
        of = [near(v, cs)[1] for _, v in kept]
        cs = [[sum(col) // len(col) for col in zip(*m, strict=True)] if (m := [v for (_, v), o in zip(kept, of, strict=True) if o == n]) else c for n, c in enumerate(cs)]
    found = [(i, *reversed(near(v, cs))) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in found)


@pytest.mark.parametrize(("scale", "k"), [(1.0, 8), (0.01, 8), (30.0, 3), (1e-9, 4), (20_000.0, 5), (1.0, 500)])
def test_clusters_equal_the_plain_rule(spark, scale, k):
    rng = np.random.default_rng(int(k))
    good = [(int(i), (rng.normal(size=4) * scale * rng.choice([1, 1, 5])).tolist()) for i in range(120)]
    good += [good[3], good[3], (None, good[9][1]), (500, [0.0] * 4)]
    bad = [(600, None), (601, [1.0] * 3), (602, [1.0, None, 1.0, 1.0]), (603, [1.0, math.nan, 1.0, 1.0]), (604, [1.0, math.inf, 1.0, 1.0]), (605, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + bad], "vec_id long, embedding array<double>, cluster int")
    got = sorted((str(r["vec_id"]), *r[1:]) for r in centroids.cluster(df, k=k, rounds=4, dim=4).collect())
    assert got == lloyd(good, k, 4)


def test_huge_components_and_empty_tables(spark):
    rows = [(k, [10.0 ** (k % 30) * (-1) ** k, 1.0]) for k in range(60)] + [(99, [1e300, -1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in centroids.cluster(df, k=3, rounds=2, dim=2).collect()}
    want = {int(i): (c, d) for i, c, d, *_ in lloyd(rows, 3, 2)}
    assert {i: (r["cluster"], r["distance"]) for i, r in got.items()} == {i: (c, min(d, 2**63 - 1)) for i, (c, d) in want.items()}
    assert centroids.cluster(df.limit(0), dim=2).count() == 0


def test_the_annulus_leaves_centroids_out(monkeypatch):
    """Centroids far from a vector's norm are never compared."""
    rng = np.random.default_rng(1)
    cs = np.array([[10 * 4**k, 0] for k in range(8)], np.int64)
    x = (cs[rng.integers(0, 8, 500)] + rng.integers(-3, 4, (500, 2))).astype(np.int64)
    seen = []
    whole = centroids.squared
    monkeypatch.setattr(centroids, "squared", lambda a, c: seen.append(len(a)) or whole(a, c))
    guess = np.array([((v - cs) ** 2).sum(1).argmin() for v in x])
    number, _ = centroids.nearest(x, cs, guess)
    assert (number == guess).all() and sum(seen) < 2 * len(x)
