"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary passages.
Every window of a text, a word with the space before it, is compressed with each;
where the toxic dictionary saves more bytes than the ordinary one, the window
reads like toxic text. A document's savings are summed up and turned into a score
by a logistic curve fitted on labelled documents.

Labels belong to whole documents, and most of a toxic document is ordinary: a
dictionary trained on whole toxic texts holds the same words as one trained on
ordinary texts. So the toxic passages are those words of toxic documents whose
beginnings stand out from ordinary text. They are counted by different
surroundings (the word with both its neighbours), so that copies of a document
count once. Ordinary passages are stretches of ordinary documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Scratch, annotated, keeps, mapped, table

#: Bounds on labelled rows: documents of a class to learn passages from, documents that fit the curve, stretches of an ordinary document.
SAMPLE, FIT, STRETCHES = 5_000, 4_000, 10
THRESHOLD = 0.7
#: Bytes of the dictionaries, and the trainer's segment and key lengths.
TOXIC_BYTES, ORDINARY_BYTES, SEGMENT, KEY = 1024, 32_768, 16, 6
#: A beginning stands out in at least LEAST different surroundings, by RATIO times its share of ordinary ones and SIGMA standard errors.
LEAST, RATIO, SIGMA = 10, 4.0, 6.0
#: Lengths of word beginnings that are counted beside whole words.
PREFIXES = range(4, 13)
#: Windows whose savings a task remembers.
REMEMBERED = 100_000
_word = regex.compile(r"[\p{L}\p{M}\p{N}]+")


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray


_ready: dict[tuple[bytes, bytes], tuple] = {}
keeps(_ready.clear, "llm.toxicity")


def compressors(model: Model) -> tuple:
    """Compressors with the toxic and the ordinary dictionary, and the savings that they have told so far."""
    key = (model.toxic, model.ordinary)
    if key not in _ready:
        _ready.clear()
        how = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=14, chain_log=14, hash_log=14, search_log=6, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False)
        make = lambda d: zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(d))
        _ready[key] = (make(model.toxic), make(model.ordinary), {})
    return _ready[key]


def saved(model: Model, words: list[str]) -> np.ndarray:
    """Bytes that the toxic dictionary saves over the ordinary one, by word.

    A word is compressed four times over, one copy after the other. Its copies are
    matches with the first, so all frames hold a compressed block and a saving of
    a byte shows; alone, so short a window would be stored as it is.
    """
    toxic, ordinary, known = compressors(model)
    if len(known) > REMEMBERED:
        known.clear()
    out = np.empty(len(words))
    for k, w in enumerate(words):
        v = known.get(w)
        if v is None:
            window = (b" " + w.encode("utf-8", "replace")) * 4 + b" "
            v = known[w] = len(ordinary.compress(window)) - len(toxic.compress(window))
        out[k] = v
    return out


#: Savings at which windows are counted.
LEVELS = (1, 2, 3, 4, 5, 6)
FEATURES = len(LEVELS) + 5


def features(model: Model, text: str) -> list[float]:
    """Of the whole text: the greatest savings, windows by the bytes saved, size."""
    words = _word.findall(text.lower())
    if not words:
        return [0.0] * FEATURES
    gain = saved(model, words)
    best, n = np.sort(gain)[::-1][:6], len(gain)
    return [best[0] / 4, best[:3].sum() / 12, best.sum() / 20, *(np.log1p((gain >= v).sum()) for v in LEVELS), np.log(n) / 4, (gain >= 3).sum() / np.sqrt(n)]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        move = np.linalg.solve(h, g)
        w -= np.clip(move, -2, 2)
    return w


def surroundings(sample: DataFrame) -> DataFrame:
    """word, toxic, ordinary: in how many different surroundings toxic and ordinary documents hold it."""

    def make(block: pa.Table) -> dict | None:
        words, around, ys = [], [], []
        for text, y in zip(block.column("text").to_pylist(), block.column("y").to_pylist(), strict=True):
            found = _word.findall(text.lower())
            words += found
            around += [f"{a} {b}" for a, b in zip(["", *found], [*found[1:], ""], strict=False)]
            ys += [y] * len(found)
        return {"word": words, "around": around, "y": pa.array(ys, pa.int32())} if words else None

    rows = mapped(sample, make, "word string, around string, y int", most=1 << 20).select("word", F.xxhash64("word", "around").alias("place"), "y").distinct()
    return rows.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("ordinary"))


def outstanding(words: DataFrame) -> list[str]:
    """Words and word beginnings, each after a space, that stand out in toxic documents; of those that go on from another the stronger."""
    sizes = words.agg(F.sum("toxic").alias("n1"), F.sum("ordinary").alias("n0")).first()
    n1, n0 = sizes["n1"] or 0, sizes["n0"] or 0
    if not n1 or not n0:
        return []
    beginnings = F.transform(F.filter(F.array(*map(F.lit, PREFIXES)), lambda k: k < F.length("word")), lambda k: F.col("word").substr(F.lit(1), k))
    terms = words.select(F.explode(F.array_append(beginnings, F.col("word"))).alias("term"), "toxic", "ordinary").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("ordinary").alias("b"))
    pooled = (F.col("a") + F.col("b") + 1) / (n1 + n0)
    z = (F.col("a") / n1 - (F.col("b") + 0.5) / n0) / F.sqrt(pooled * (1 / n1 + 1 / n0))
    strong = terms.withColumn("z", z).filter((F.col("a") >= LEAST) & (F.col("z") > SIGMA) & (F.col("a") / n1 > RATIO * (F.col("b") + 0.5) / n0))
    ranked = [r["term"] for r in strong.orderBy(F.desc(F.col("z") * F.pow(F.length("term") + 1, 0.1)), "term").select("term").collect()]
    out: list[str] = []
    for t in ranked:
        if not any(t.startswith(o) or o.startswith(t) for o in out):
            out.append(t)
    return out


def passages(sample: DataFrame, terms: list[str]) -> DataFrame:
    """passage, y: of a toxic document its words that begin with one of the terms (all words without terms), of an ordinary one stretches from all over it."""
    begin = frozenset(terms)
    lengths = sorted({len(t) for t in terms})

    def make(block: pa.Table) -> dict | None:
        out, ys = [], []
        for text, y in zip(block.column("text").to_pylist(), block.column("y").to_pylist(), strict=True):
            words = _word.findall(text.lower())
            if y and begin:
                words = [w for w in words if any(w[:k] in begin for k in lengths)]
                parts = [words] if words else []
            else:
                step = max(20, len(words) // STRETCHES)
                parts = [words[k : k + 20] for k in range(0, len(words), step)]
            out += ["".join(f" {w}" for w in part) for part in parts]
            ys += [y] * len(parts)
        return {"passage": out, "y": pa.array(ys, pa.int32())} if out else None

    return mapped(sample, make, "passage string, y int", most=1 << 20).distinct()


def trained(texts: list[str], size: int) -> bytes:
    """A dictionary by the library's trainer; too few passages for it are the dictionary's raw content themselves."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    try:
        return zstandard.train_dictionary(size, raw, k=SEGMENT, d=KEY, level=19).as_bytes()
    except zstandard.ZstdError:
        return b"".join(raw)[-size:] or b" the"


def chosen(docs: DataFrame, marks: DataFrame, sample: int, rows: int) -> DataFrame:
    """doc_id, text, y, counted, fits: the documents to learn from, picked by a hash of their ids.

    `sample` of each class give passages, `rows` with the classes in their natural
    shares fit the curve. At most 2 * sample + rows ids are broadcast to the
    texts, which are not shuffled.
    """
    by = lambda salt: F.xxhash64("doc_id", F.lit(salt))
    pick = lambda y: marks.filter(F.col("y") == y).orderBy(by(1), "doc_id").limit(sample).select("doc_id", "y", F.lit(1).alias("counted"), F.lit(0).alias("fits"))
    fits = marks.orderBy(by(2), "doc_id").limit(rows).select("doc_id", "y", F.lit(0).alias("counted"), F.lit(1).alias("fits"))
    ids = pick(1).unionByName(pick(0)).unionByName(fits).groupBy("doc_id").agg(F.max("y").alias("y"), F.max("counted").alias("counted"), F.max("fits").alias("fits"))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")


def fit(docs: DataFrame, marks: DataFrame, sample: int = SAMPLE, rows: int = FIT) -> Model | None:
    """Model from texts (doc_id, text) and marks (doc_id, y in 0 and 1); None if a class has no document.

    Passages come from at most `sample` whole documents of a class, and at most
    `rows` documents fit the curve; both bounds hold at every size.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    some = scratch.save(chosen(docs, marks, sample, rows), "sample")
    counted = some.filter("counted = 1").select("text", "y")
    if counted.select("y").distinct().count() < 2:
        return None
    terms = outstanding(scratch.save(surroundings(counted), "words"))
    found = passages(counted, terms).orderBy(F.xxhash64("passage"), "passage").collect()
    of = lambda y: [r["passage"] for r in found if r["y"] == y]
    model = Model(trained(of(1), TOXIC_BYTES), trained(of(0), ORDINARY_BYTES), np.zeros(FEATURES + 1))
    x, y = features_of(some.filter("fits = 1").select("text", "y"), model)
    model.weights = logistic(x, y)
    return model


def features_of(df: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    def make(block: pa.Table) -> dict:
        return {"x": [features(model, t) for t in block.column("text").to_pylist()], "y": block.column("y").combine_chunks()}

    got = [r for r in mapped(df, make, "x array<double>, y int").collect() if any(r["x"])]
    return np.array([r["x"] for r in got]).reshape(-1, FEATURES), np.array([r["y"] for r in got], float)


def score(df: DataFrame, model: Model | None, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns `carry` and score (0 to 1) of every row, from the whole text.

    Null texts and those without words have no window and score 0; without a
    model every score is 0. Repeated rows give repeated results, an
    empty table none. Local to a row: nothing is shuffled.
    """

    def make(rows: list[str]) -> dict:
        s = np.zeros(len(rows))
        if model is not None:
            f = np.array([features(model, t) for t in rows]).reshape(-1, FEATURES)
            s = 1 / (1 + np.exp(-np.clip(np.hstack([f, np.ones((len(f), 1))]) @ model.weights, -30, 30)))
            s[~f.any(1)] = 0
        return {"score": s}

    return annotated(df, list(carry), make, "score double", text_col)


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 3 == 1, F.lit(False))


def marks(labels: DataFrame) -> DataFrame:
    """doc_id and y of the labelled documents outside the held-out third; of repeated labels the larger."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    return rows.filter(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, marks(table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
