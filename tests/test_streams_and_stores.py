"""Limits on streams, translation by phrases, uploads committed as a whole, ordered exports."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from hazardlens.functions import translation, vocabularies
from hazardlens.sources import store, uploads
from hazardlens.streaming import limits

T0 = datetime.datetime(2024, 1, 1)


def replay(rows, seconds, most, most_sensitive):
    """The plain rule: all requests in their order."""
    kept, out = {}, {}
    for client, request, ts, sensitive in sorted(rows, key=lambda r: (r[2], r[1])):
        recent = [(t, s) for t, s in kept.get(client, []) if t > ts - datetime.timedelta(seconds=seconds)]
        ok = len(recent) < most and not (sensitive and sum(s for _, s in recent) >= most_sensitive)
        kept[client] = [*recent, (ts, sensitive)] if ok else recent
        out[request] = ok
    return out


def made(n, clients, spread, seed=1):
    rng = random.Random(seed)
    return [(f"c{rng.randrange(clients)}", f"{k:05}", T0 + datetime.timedelta(seconds=rng.randrange(spread), microseconds=rng.choice([0, 0, 250_000])), rng.random() < 0.3) for k in range(n)]


@pytest.mark.parametrize(("seconds", "most", "secret"), [(60, 5, 2), (7, 2, 1), (600, 40, 3)])
def test_admitted_equals_replay(spark, seconds, most, secret):
    rows = made(1500, 5, 3000)
    df = spark.createDataFrame(rows, "client string, request string, ts timestamp, sensitive boolean")
    got = {r["request"]: r["admitted"] for r in limits.admitted(df, seconds, most, secret).collect()}
    assert got == replay(rows, seconds, most, secret)
    assert limits.admitted(df.limit(0)).count() == 0


def test_stream_equals_replay(spark, tmp_path):
    rows = sorted(made(600, 3, 900), key=lambda r: (r[2], r[1]))
    kind = "client string, request string, ts timestamp, sensitive boolean"
    for k in range(0, 600, 150):
        spark.createDataFrame(rows[k : k + 150], kind).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = limits.admitted_stream(source, 60, 5, 2).writeStream.format("memory").queryName("admitted").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["request"]: r["admitted"] for r in spark.table("admitted").collect()}
    assert got == replay(rows, 60, 5, 2)


def test_phrases_longest_first():
    words = {"ab": "1", "abc": "2", "bcd": "3", "x": "", "cd": "4"}

    def plain(t):
        for phrase, english in sorted(words.items(), key=lambda p: -len(p[0])):
            t = t.replace(phrase, english)
        return t

    rng = random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choice("abcdyz ") for _ in range(rng.randrange(30)))
        assert translation.replaced(t, translation.automaton(words)) == plain(t)


def test_vocabularies(spark):
    table = spark.createDataFrame([("hi", "a", "1"), ("hi", None, "2"), ("kn", "", "3"), ("kn", "b", "4"), ("kn", "b", "5")], "language string, phrase string, english string")
    assert translation.vocabulary(table) == {"hi": {"a": "1"}, "kn": {"b": "4"}}
    df = spark.createDataFrame([("ಹಾರ್ನೆಸ್ ಇಲ್ಲದೆ ಎತ್ತರದಲ್ಲಿ ಕೆಲಸ",), ("सुरक्षा उपकरण के बिना",), ("plain text",), (None,)], "report_text string")
    got = translation.processed(df, {"kn": vocabularies.KANNADA, "hi": vocabularies.HINDI}).select("report_text", "detected_language").collect()
    assert [tuple(r) for r in got] == [("without harness working at height", "kn"), ("without safety equipment", "hi"), ("plain text", "en"), (None, "unknown")]


def test_uploads_are_committed_whole(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([("1", "h1"), ("2", "h2")], "report_id string, content_hash string")
    assert store.stored(spark, at, rows.schema).count() == 0
    store.commit(rows, at, "f1", "a.csv")
    assert store.stored(spark, at, rows.schema).count() == 2
    monkeypatch.setattr(store, "_announce", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.commit(rows.withColumn("report_id", F.concat("report_id", F.lit("x"))), at, "f2", "b.csv")
    monkeypatch.undo()
    # The rows of the one that was killed are in the folder, but not in the store; nor is its file in the ledger.
    assert spark.read.parquet(f"{at}/data").count() == 4
    assert store.stored(spark, at, rows.schema).count() == 2
    assert [r["file_hash"] for r in store.ledger(spark, at).collect()] == ["f1"]
    store.commit(rows.limit(0), at, "f3", "c.csv")
    store.commit(rows.limit(1), at, "f1", "again.csv")
    assert sorted((r["file_hash"], r["filename"]) for r in store.ledger(spark, at).collect()) == [("f1", "a.csv"), ("f3", "c.csv")]
    assert store.stored(spark, at, rows.schema).count() == 3
    # An announcement that was cut off in writing does not count.
    with open(f"{tmp_path}/store/commits/zz.json", "w") as f:
        f.write('{"commit": "zz", "file_h')
    assert store.ledger(spark, at).count() == 2


def test_export_is_in_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(str(k), f'say "{k}"\n, x' if k % 3 else None, "A", rng.randrange(100), "LOW", "NO", T0 + datetime.timedelta(days=rng.randrange(9))) for k in range(500)]
    df = spark.createDataFrame(rows, "report_id string, description string, category string, risk_score int, risk_level string, sif_potential string, created_at timestamp").repartition(7)
    uploads.export_sorted(df, f"file://{tmp_path}/out", "risk_score", descending=True, parts=4)
    import csv
    import glob

    got = []
    files = sorted(glob.glob(f"{tmp_path}/out/part-*.csv"))
    for f in files:
        with open(f, newline="") as h:
            lines = list(csv.reader(h))
            assert lines[0] == list(uploads.EXPORTED)
            got += lines[1:]
    want = sorted(rows, key=lambda r: (-r[3], r[0]))
    assert [r[0] for r in got] == [r[0] for r in want] and [r[1] for r in got] == [r[1] or "" for r in want] and 1 < len(files) <= 4
