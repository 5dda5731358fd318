"""BPE encoding and decoding with forced boundaries.

Two bytes that never stand side by side inside any vocabulary token can never
be merged into one token, so a cut between them is certain. A word is cut at
every such pair; the fragments are encoded on their own, remembered, and put
back together. The result equals the full merge procedure.
"""

from __future__ import annotations

import json
import struct
import sys
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import keeps, mapped, table, texts

#: Entries that a cache keeps before it starts anew: bounds a worker's memory.
CACHE = 500_000
END = "</w>"
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def byte_chars() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Encoder and decoder for a byte-level BPE file with word ends (lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chars = byte_chars()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = self.vocab
        #: Both ids in one number to the rank and the merged id in one number, so that the least is the next merge.
        self.merge = {ids[a] << 24 | ids[b]: rank << 24 | ids[a + b] for rank, (a, b) in enumerate(merges)}
        self.none = len(merges) << 24
        self.token = {i: t for t, i in [*ids.items(), *self.special.items()]}
        self.first = [ids.get(self.chars[b]) for b in range(256)]
        self.last = [ids.get(self.chars[b] + END) for b in range(256)]
        #: Whether the vocabulary lacks a byte.
        self.gaps = None in self.first or None in self.last
        byte_of = {c: b for b, c in self.chars.items()}
        self.inside = np.zeros((256, 256), bool)
        for t in ids:
            raw = [byte_of[c] for c in t.removesuffix(END)]
            for a, b in zip(raw, raw[1:], strict=False):
                self.inside[a, b] = True
        self.joins = [row.tobytes() for row in self.inside]
        #: Packed ids of fragments and of words.
        self.fragments: dict[bytes | tuple[bytes], bytes] = {}
        self.known: dict[str, bytes] = {}

    def fragment(self, raw: bytes, ends: bool) -> bytes:
        """Merge by rank, leftmost first, until no pair is left that merges; the ids packed."""
        ids = [self.first[b] for b in raw]
        if ends:
            ids[-1] = self.last[raw[-1]]
        if self.gaps:
            ids = [i for i in ids if i is not None]
        merge, none = self.merge, self.none
        best = [merge.get(a << 24 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while best and (low := min(best)) < none:
            k = best.index(low)
            ids[k : k + 2] = [low & 0xFFFFFF]
            del best[k]
            if k:
                best[k - 1] = merge.get(ids[k - 1] << 24 | ids[k], none)
            if k < len(best):
                best[k] = merge.get(ids[k] << 24 | ids[k + 1], none)
        return array("I", ids).tobytes() if LITTLE else struct.pack(f"<{len(ids)}I", *ids)

    def cuts(self, raw: bytes) -> list[int]:
        """Where a byte pair that no token holds forces a boundary."""
        joins = self.joins
        return [k for k, (a, b) in enumerate(zip(raw, raw[1:], strict=False), 1) if not joins[a][b]]

    def word(self, word: str) -> bytes:
        raw, out, at = word.encode("utf-8", "replace"), [], 0
        for to in [*self.cuts(raw), len(raw)]:
            # What ends a word is remembered under its text, as most words are one such fragment.
            key = raw[at:to] if to == len(raw) else (raw[at:to],)
            ids = self.fragments.get(key)
            if ids is None:
                if len(self.fragments) >= CACHE:
                    self.fragments.clear()
                ids = self.fragments[key] = self.fragment(raw[at:to], to == len(raw))
            out.append(ids)
            at = to
        return b"".join(out)

    def chunk(self, chunk: str) -> bytes:
        """Packed ids of a run without white space; words never reach across white space."""
        out: list[bytes] = []
        plain = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        # Letters, or letters and a mark, are what the pattern would find; most runs are that.
        if plain.isalpha():
            found = (plain,)
        elif plain[-1:] in (".", ",") and plain[:-1].isalpha():
            found = (plain[:-1], plain[-1])
        else:
            found = self.words.findall(plain)
        for w in found:
            ids = self.known.get(w)
            if ids is None:
                if len(self.known) >= CACHE:
                    self.known.clear()
                ids = self.known[w] = self.word(w)
            out.append(ids)
        return b"".join(out)

    #: What str.split() takes for white space and the vocabulary's pattern doesn't.
    odd = regex.compile("[\x1c-\x1f]")
    space = regex.compile("[\t-\r \x85\xa0  -     　]+")

    def chunks(self, text: str) -> Iterable[str]:
        if self.odd.search(text):
            return [c for c in self.space.split(text) if c]
        return text.split()

    def parts(self, text: str) -> Iterable[tuple[str, bool]]:
        """The text cut at special tokens' strings: (part, is special)."""
        if self.split_special is None or "<" not in text:
            return [(text, False)]
        return [(p, p in self.special) for p in self.split_special.split(text) if p]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.parts(text):
            if special:
                out.append(self.special[part])
            else:
                for c in self.chunks(part):
                    out.extend(np.frombuffer(self.chunk(c), "<u4").tolist())
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """As a vocabulary without a decoder does: the tokens' strings with a space between."""
        return " ".join(self.token[i] for i in ids)


class Packed:
    """Whole texts to packed ids through a cache of runs, for the hot path."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe

        class Runs(dict):
            def __missing__(self, chunk):
                if len(self) >= CACHE:
                    self.clear()
                got = self[chunk] = bpe.chunk(chunk)
                return got

        self.runs = Runs()

    def pack(self, ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        get = self.runs.__getitem__
        if "<" not in text:
            return b"".join(map(get, self.bpe.chunks(text)))
        return b"".join(self.pack([self.bpe.special[p]]) if special else b"".join(map(get, self.bpe.chunks(p))) for p, special in self.bpe.parts(text))


_loaded: dict[str, tuple[WordBpe, Packed, np.ndarray]] = {}
keeps(_loaded.clear, "llm.bpe", "llm.packing")


def loaded(path: str) -> tuple[WordBpe, Packed, np.ndarray]:
    """The vocabulary in this worker, read once."""
    if path not in _loaded:
        bpe = WordBpe(path)
        names = np.array([bpe.token.get(i, "").encode() for i in range(max(bpe.token) + 1)], dtype=object)
        _loaded[path] = (bpe, Packed(bpe), names)
    return _loaded[path]


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded text of every row.

    Null and empty texts have no ids and decode to the empty text; repeated rows
    give repeated results; an empty table gives none; other columns are not read.
    The work is local to a row: there is no shuffle, and a lost executor's tasks
    are simply run again.
    """

    def make(block: pa.Table) -> dict:
        _, packed, names = loaded(path)
        ids = [packed.encode(t) for t in block.column("text").to_pylist()]
        decoded = [b" ".join(names[np.frombuffer(x, "<u4")]) for x in ids]
        return {"doc_id": block.column("doc_id").combine_chunks(), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.binary()).cast(pa.string())}

    kind = df.schema[id_col].dataType.simpleString()
    return mapped(texts(df, id_col, text_col), make, f"doc_id {kind}, ids binary, decoded string", most=1 << 20)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), default_path())
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
