"""Language identification by interpolated Kneser-Ney character models.

Every language gets an order-n model over letters and word gaps. Counts of the
highest order come from all training texts; lower orders are continuation
counts. For scoring, the n-grams of all languages lie in one sorted array of
64-bit hashes per order, beside a matrix with every language's log probability,
so one binary search serves all languages. The lowest cross-entropy per
character wins.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Scratch, annotated, mapped, table

ORDER = 4
#: How few distinct labelled texts of a language make its rejection threshold a pooled one.
FEW = 20
#: Parts of the training texts; each is scored by a model of the other. And how fine entropies are told apart for the thresholds.
FOLDS, STEP = 2, 1e-3
GAP = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The symbol of every code point: itself if it is a letter, else a gap.
_symbol = np.array([c if chr(c).isalpha() else GAP for c in range(0x110000)], np.uint32)


def symbols(text: str) -> np.ndarray:
    """Code points in lower case, each run of anything but letters as one gap, a gap at both ends."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = _symbol[raw]
    letter = raw != GAP
    keep = np.ones(len(raw), bool)
    np.logical_or(letter[1:], letter[:-1], out=keep[1:])
    return raw[keep]


def hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` symbols that end at each position from order - 1 on."""
    n = len(codes) - order + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(order):
        h = (h + codes[k : k + n].astype(np.uint64) + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
    return h


def joined(parts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one array, each after order - 1 gaps, and where each begins."""
    pad = np.full(order - 2, GAP, np.uint32)
    flat = [x for p in parts for x in (pad, p)]
    lens = np.array([len(p) + order - 2 for p in parts], np.int64)
    return np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.cumsum(lens) - lens


def grams(codes: np.ndarray, where: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams (rows of `order` symbols) of codes that begin at the places `where`, and how often each does.

    Symbols are numbered, and the numbers of a gram packed into one integer where they fit into it, so that plain
    integers are sorted; with more symbols than that, hashes of the grams are.
    """
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    bits = max(int(len(alphabet) - 1).bit_length(), 1)
    if bits * order > 64:
        _, first, n = np.unique(hashes(codes, order)[where], return_index=True, return_counts=True)
        return codes[where[first][:, None] + np.arange(order)], n
    kind = np.uint32 if bits * order <= 32 else np.uint64
    number = np.zeros(len(seen), kind)
    number[alphabet] = np.arange(len(alphabet), dtype=kind)
    ids = number[codes]
    packed = ids[: len(codes) - order + 1].copy()
    for k in range(1, order):
        packed <<= kind(bits)
        packed |= ids[k : k + len(packed)]
    different, n = np.unique(packed[where], return_counts=True)
    shifts = np.arange(order - 1, -1, -1).astype(kind) * kind(bits)
    return alphabet[(different[:, None] >> shifts) & kind((1 << bits) - 1)].astype(np.uint32), n


def counted(df: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n over all rows of (text, lang): counts are added up per block before they are shuffled."""

    def make(block: pa.Table) -> dict | None:
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        by: dict[str, list] = defaultdict(list)
        for text, lang in zip(block.column("text").to_pylist(), block.column("lang").to_pylist(), strict=True):
            by[lang].append(symbols(text))
        for lang, parts in by.items():
            codes, starts = joined(parts, order)
            ok = np.ones(max(len(codes) - order + 1, 0), bool)
            for back in range(1, order):
                at = starts[1:] - back
                ok[at[(at >= 0) & (at < len(ok))]] = False
            where = np.nonzero(ok)[0]
            if len(where):
                different, n = grams(codes, where, order)
                # Letters and gaps only, so a symbol is a character.
                flat = different.astype("<u4").tobytes().decode("utf-32-le")
                out["lang"] += [lang] * len(n)
                out["gram"] += [flat[i : i + order] for i in range(0, len(flat), order)]
                out["n"] += n.tolist()
        return out if out["n"] else None

    rows = df.filter(F.col("lang").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), "lang")
    return mapped(rows, make, "lang string, gram string, n long", most=1 << 19).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Places:
    """Places of hashes in a sorted array of them: the highest bits of a hash say where to begin, and few steps remain."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        # Several bits to a hash, but for very many hashes.
        bits = max(min(self.n.bit_length() + 2, 20), self.n.bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys = np.append(keys, np.uint64(2**64 - 1))

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash a place and whether the hash is there."""
        pos = self.first[h >> self.shift]
        here = self.keys[pos]
        hit = here == h
        todo = np.flatnonzero(here < h)
        while len(todo):
            pos[todo] += 1
            here = self.keys[pos[todo]]
            hit[todo] = here == h[todo]
            todo = todo[here < h[todo]]
        hit &= pos < self.n
        return np.minimum(pos, max(self.n - 1, 0)), hit


@dataclass
class Model:
    """Sorted hash arrays per order; for order k, log probabilities (grams x languages); back-off weights by context."""

    langs: list[str]
    order: int
    keys: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None
    limit: np.ndarray | None = None
    #: Made where a model is used, not sent.
    places: dict[tuple[str, int], Places] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"places": {}}

    def only(self, i: int) -> Model:
        """The model of the language i alone, with the same grams."""
        column = lambda parts: [np.ascontiguousarray(x[:, [i]]) for x in parts]
        return Model(self.langs[i : i + 1], self.order, self.keys, column(self.logs), self.contexts, column(self.backoff), self.unseen[[i]], None if self.limit is None else self.limit[[i]], self.places)

    def find(self, name: str, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes of length k among the keys or contexts, and which of them are there."""
        if (name, k) not in self.places:
            self.places[name, k] = Places(getattr(self, name)[k - 1])
        return self.places[name, k].of(h)

    def at(self, codes: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol from order - 1 on, in every language."""
        n = len(codes) - self.order + 1
        out, todo = np.zeros((max(n, 0), len(self.langs)), np.float32), np.arange(max(n, 0))
        for k in range(self.order, 0, -1):
            if len(todo) == len(out):
                h = hashes(codes[self.order - k :], k)
            else:
                # Only the grams that are still looked for.
                h = hashes(codes[(todo + self.order - k)[:, None] + np.arange(k)].ravel(), k)[::k]
            pos, hit = self.find("keys", k, h)
            if len(todo) == len(out) and len(self.logs[k - 1]):
                out += np.where(hit[:, None], self.logs[k - 1][pos], np.float32(0))
            else:
                out[todo[hit]] += self.logs[k - 1][pos[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            if k > 1:
                pos, hit = self.find("contexts", k, hashes(codes[(todo + self.order - k)[:, None] + np.arange(k - 1)].ravel(), k - 1)[:: k - 1])
                out[todo[hit]] += self.backoff[k - 1][pos[hit]]
        out[todo] += self.unseen
        return out

    def entropies(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (texts x languages) and the number of symbols."""
        parts = [symbols(t) for t in texts_]
        codes, starts = joined(parts, self.order)
        lens = np.array([len(p) - 1 for p in parts], np.int64)
        logs = self.at(codes)
        sums = np.zeros((len(parts), len(self.langs)))
        some = np.nonzero(lens > 0)[0]
        if len(some):
            # A symbol of the text itself counts from its first letter to its last gap.
            edges = np.stack([starts[some], starts[some] + lens[some]], 1).ravel()
            padded = np.zeros((len(logs) + 1, logs.shape[1]))
            padded[:-1] = logs
            sums[some] = np.add.reduceat(padded, edges, axis=0)[::2]
        return -sums / np.maximum(lens, 1)[:, None], lens


def levels(counts: DataFrame, order: int, scratch: Scratch) -> dict[int, DataFrame]:
    """(lang, gram, n) by length: counts of the highest order, below it the number of different symbols before a gram."""
    out = {order: counts}
    for k in range(order - 1, 0, -1):
        lower = out[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        out[k] = scratch.save(lower, f"level{k}")
    return out


@dataclass
class Shape:
    """Of one length and language: sum of counts, different grams, and the discount from the grams counted once and twice."""

    total: int = 0
    kinds: int = 0
    discount: float = 0.75


def shapes(level: dict[int, DataFrame]) -> dict[tuple[int, str], Shape]:
    """By length and language; as many rows as there are of these reach the driver."""
    out = {}
    for k, rows in level.items():
        n = F.col("n")
        stats = rows.groupBy("lang").agg(F.sum(n).alias("total"), F.count("*").alias("kinds"), F.count_if(n == 1).alias("ones"), F.count_if(n == 2).alias("twos"))
        for r in stats.collect():
            both = r["ones"] and r["twos"]
            out[k, r["lang"]] = Shape(r["total"], r["kinds"], r["ones"] / (r["ones"] + 2 * r["twos"]) if both else 0.5 if k == 1 else 0.75)
    return out


def hashed(rows: DataFrame, k: int, values: list[Column]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the grams (length k) of rows and the natural logs of their values, one row of float32 per gram."""

    n = len(values)

    def make(block: pa.Table) -> dict:
        flat = np.frombuffer("".join(block.column("gram").to_pylist()).encode("utf-32-le"), np.uint32)
        logs = np.log(np.stack([np.asarray(block.column(f"v{i}")) for i in range(n)], 1)).astype(np.float32)
        return {"h": hashes(flat, k)[::k].view(np.int64), "logs": pa.array([x.tobytes() for x in logs], pa.binary())}

    got = mapped(rows.select("gram", *(v.alias(f"v{i}") for i, v in enumerate(values))), make, "h long, logs binary", size_of="gram", most=1 << 20).toArrow()
    h = np.asarray(got.column("h")).view(np.uint64)
    logs = np.frombuffer(b"".join(got.column("logs").to_pylist()), np.float32).reshape(-1, n)
    by = np.argsort(h)
    return h[by], logs[by]


def fit_counts(counts: DataFrame, scratch: Scratch, order: int = ORDER) -> Model | None:
    """Kneser-Ney models from counts of the highest order (lang, gram, n); None without a language.

    Lower counts, discounts, context masses and probabilities are group-bys and
    joins on grams over all counts. Of each gram its hash and one number per
    language reach the driver, and with the model every task: that grows with
    the different grams of the training texts.
    """
    level = levels(counts, order, scratch)
    shape = shapes(level)
    langs = sorted({lang for _, lang in shape})
    if not langs:
        return None
    each = [(i, lang, F.col("lang") == lang) for i, lang in enumerate(langs)]
    floor, model = [], Model(langs, order)
    for lang in langs:
        one = shape[1, lang]
        floor.append(one.discount * one.kinds / one.total / (one.kinds + 1))
    model.unseen = np.log(np.array(floor)).astype(np.float32)
    lower = None
    for k in range(1, order + 1):
        off = [shape[k, lang].discount for lang in langs]
        grams = level[k].groupBy("gram").agg(*(F.max(F.when(mine, F.col("n"))).alias(f"n{i}") for i, _, mine in each))
        if lower is None:
            probs = [F.coalesce(F.greatest(F.col(f"n{i}") - off[i], F.lit(0.0)) / shape[1, lang].total, F.lit(0.0)) + floor[i] for i, lang, _ in each]
            model.contexts.append(np.zeros(0, np.uint64))
            model.backoff.append(np.zeros((0, len(langs)), np.float32))
        else:
            masses = [f(F.when(mine, F.col("n"))).alias(f"{name}{i}") for i, _, mine in each for name, f in (("mass", F.sum), ("kinds", F.count))]
            before = level[k].groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(*masses)
            back = [F.coalesce(off[i] * F.col(f"kinds{i}") / F.col(f"mass{i}"), F.lit(1.0)) for i, _, _ in each]
            before = scratch.save(before.select("context", *(f"mass{i}" for i, _, _ in each), *(b.alias(f"back{i}") for i, b in enumerate(back))), f"contexts{k}")
            keys, logs = hashed(before.withColumnRenamed("context", "gram"), k - 1, [F.col(f"back{i}") for i, _, _ in each])
            model.contexts.append(keys)
            model.backoff.append(logs)
            grams = grams.withColumn("context", F.substring("gram", 1, k - 1)).withColumn("ending", F.substring("gram", 2, k - 1))
            grams = grams.join(before, "context").join(lower, "ending")
            probs = [F.coalesce(F.greatest(F.col(f"n{i}") - off[i], F.lit(0.0)) / F.col(f"mass{i}"), F.lit(0.0)) + F.col(f"back{i}") * F.col(f"low{i}") for i, _, _ in each]
        here = scratch.save(grams.select("gram", *(p.alias(f"p{i}") for i, p in enumerate(probs))), f"probabilities{k}")
        keys, logs = hashed(here, k, [F.col(f"p{i}") for i, _, _ in each])
        model.keys.append(keys)
        model.logs.append(logs)
        lower = here.select(F.col("gram").alias("ending"), *(F.col(f"p{i}").alias(f"low{i}") for i, _, _ in each))
    return model


def fit(train: DataFrame, order: int = ORDER, calibrate: int = FEW) -> Model | None:
    """Model from the rows (text, lang) with a language; None if there are none.

    Counts, discounts and probabilities cover every row. The rejection thresholds rest on every distinct
    text with a letter, and on entropies of texts that a model hasn't seen: texts fall by hash into two
    parts, and each part is scored by a model of the other. A language with fewer than `calibrate`
    texts to score gets a pooled threshold.
    """
    scratch = Scratch(train.sparkSession, "language")
    rows = train.filter(F.col("lang").isNotNull()).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "lang").withColumn("key", F.xxhash64("text"))
    fold = F.pmod(F.xxhash64("key"), F.lit(FOLDS))
    # Counted once, by part and language.
    parts = scratch.save(counted(rows.select("text", F.concat(fold.cast("string"), "lang").alias("lang")), order), "parts")
    parts = parts.select(F.substring("lang", 1, 1).cast("int").alias("fold"), F.expr("substring(lang, 2)").alias("lang"), "gram", "n")
    found = []
    for k in range(FOLDS):
        apart = Scratch(train.sparkSession, f"language-without-{k}")
        model = fit_counts(apart.save(parts.filter(F.col("fold") != k).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts"), apart, order)
        if model is not None:
            found += own_entropies(rows.filter((fold == k) & F.col("text").rlike(r"\p{L}") & F.col("lang").isin(model.langs)), model)
    model = fit_counts(scratch.save(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts"), scratch, order)
    if model is not None:
        of = {lang: [(h, n) for own, h, n in found if own == lang] for lang in model.langs}
        model.limit = limits([np.array(of[lang], float).reshape(-1, 2) for lang in model.langs], calibrate)
    return model


def own_entropies(rows: DataFrame, model: Model) -> list[tuple[str, float, int]]:
    """Language, cross-entropy in it (in steps of STEP) and number of the distinct texts of rows (lang, key, text); as many rows as there are steps reach the driver."""

    alone: dict[int, Model] = {}

    def make(block: pa.Table) -> dict:
        texts, own = block.column("text").to_pylist(), np.array([model.langs.index(x) for x in block.column("lang").to_pylist()], np.int64)
        h = np.zeros(len(own))
        for i in np.unique(own).tolist():
            mine = np.flatnonzero(own == i)
            if i not in alone:
                alone[i] = model.only(i)
            h[mine] = alone[i].entropies([texts[j] for j in mine])[0][:, 0]
        return {"own": own, "key": block.column("key").combine_chunks(), "step": np.rint(h / STEP).astype(np.int64)}

    each = mapped(rows.select("text", "lang", "key"), make, "own long, key long, step long", most=1 << 18).distinct()
    return [(model.langs[r["own"]], r["step"] * STEP, r["n"]) for r in each.groupBy("own", "step").agg(F.count("*").alias("n")).collect()]


def median(x: np.ndarray, n: np.ndarray) -> float:
    """Median of the values x, each n times."""
    by = np.argsort(x)
    ends = np.cumsum(n[by]).astype(np.int64)
    return float(x[by][np.searchsorted(ends, [(ends[-1] - 1) // 2, ends[-1] // 2], side="right")].mean())


def limits(own: list[np.ndarray], few: int = FEW) -> np.ndarray:
    """The threshold of every language from its rows (entropy, number of texts): median and spread; with few texts the spread of all and the larger median."""
    spread = lambda x: 12 * max(median(np.abs(x[:, 0] - median(*x.T)), x[:, 1]), 0.05)
    every = np.concatenate(own)
    if not len(every):
        return np.full(len(own), np.inf)
    middle, wide = median(*every.T), spread(every)
    return np.array([median(*x.T) + spread(x) if x[:, 1].sum() >= few else max(middle, median(*x.T) if len(x) else middle) + wide for x in own])


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def identify(df: DataFrame, model: Model | None, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns `carry`, lang_pred, score, entropy and rejected of every row, from whole texts.

    A null text or one without letters is `und`, score 0 and rejected. The score
    is the posterior of the best language under equal priors. A text is rejected
    if its cross-entropy lies beyond the threshold fitted for its language, which
    grows for short texts. Without a model everything is `und`. Repeated rows
    give repeated results, an empty table none. Nothing is shuffled.
    """

    def make(rows: list[str]) -> dict:
        lang, score, entropy, rejected = ["und"] * len(rows), np.zeros(len(rows)), np.zeros(len(rows)), np.ones(len(rows), bool)
        some = [i for i, t in enumerate(rows) if has_letter(t)] if model else []
        if some:
            h, n = model.entropies([rows[i] for i in some])
            best = h.argmin(1)
            gap = (h - h.min(1)[:, None]) * n[:, None]
            score[some] = 1 / np.exp(-np.minimum(gap, 700)).sum(1)
            entropy[some] = h.min(1)
            slack = model.limit[best] * (1 + 4 / np.sqrt(np.maximum(n, 1)))
            rejected[some] = h.min(1) > slack
            for i, b in zip(some, best, strict=True):
                lang[i] = model.langs[b]
        return {"lang_pred": lang, "score": score, "entropy": entropy, "rejected": rejected}

    return annotated(df, list(carry), make, "lang_pred string, score double, entropy double, rejected boolean", text_col, most=1 << 18)


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 4 == 2, F.lit(False))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()).select("text", "lang"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")
