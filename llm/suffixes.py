"""Exact removal of repeated passages by a hash-compared suffix sort.

A byte goes if a string of LENGTH bytes that covers it also starts earlier. The
strings (windows) of all documents can't be sorted as they are, so each window
names an anchor: the K bytes in it with the least hash, the leftmost of equals.
Equal windows have equal anchors at equal places. An anchor's context is all bytes
of its windows. Contexts first travel as digests: of equal ones (128 bits of
BLAKE2b) all but the first are repeats, and anchors with a single context settle.
Only the different contexts of an anchor travel as bytes, and around the anchor
their suffixes are sorted. A mergesort compares two suffixes by binary search over
prefix polynomial hashes for their longest common extension, and one byte after it
decides. Windows that are neighbours in that order with a common extension of
LENGTH bytes are the same; hash matches are verified on the bytes. The sort is done
twice: from the anchor to the right and, over reversed bytes, to the left, which
tells how far each suffix goes along with any other; only windows within both are
then sorted. Anchors with enough contexts to fill a task are dealt out: groups of
neighbouring windows go by the hash of the bytes that all of a group hold, and
those of them that are still too many go window by window.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Scratch, blocks, claim, mapped, table, whole_ids
from llm.fingerprint import mix, prefix_hashes, span_hashes

LENGTH, K = 100, 20
#: Different contexts of an anchor to which its suffixes are sorted in one task; beyond them its windows are dealt out to many sorts.
FREQUENT = 2_000
#: Of so many parts of a window's bytes, a group of windows that is dealt out may miss one.
PARTS = 6


class Anchors:
    """Anchors of a block of texts: place, first and last window, hash, and the text each is in."""

    def __init__(self, raw: list[bytes], length: int = LENGTH, k: int = K):
        self.length = length
        self.raw = raw
        lens = np.array([len(r) for r in raw], np.int64)
        self.ends = np.cumsum(lens)
        self.begins = self.ends - lens
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.prefix = prefix_hashes(self.data)
        empty = np.zeros(0, np.int64)
        self.at, self.first, self.last, self.doc, self.hash = empty, empty, empty, empty, np.zeros(0, np.uint64)
        n = len(self.data) - k + 1
        width = length - k + 1
        if n < width:
            return
        at = np.arange(n)
        grams = mix(span_hashes(self.prefix, at, at + k), 7)
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Windows that lie within one text.
        inside = np.zeros(len(anchor) + 1, np.int64)
        long = lens >= length
        np.add.at(inside, np.minimum(self.begins[long], len(anchor)), 1)
        np.add.at(inside, np.minimum(self.ends[long] - length + 1, len(anchor)), -1)
        start = np.nonzero(np.cumsum(inside[:-1]) > 0)[0]
        if not len(start):
            return
        anchor = anchor[start]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
        where = np.nonzero(new)[0]
        self.at, self.first = anchor[where], start[where]
        self.last = start[np.concatenate([where[1:] - 1, [len(start) - 1]])]
        self.hash = grams[self.at]
        self.doc = np.searchsorted(self.ends, self.first, side="right")


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes from a and from b are equal, in chunks of bounded memory."""
    out = np.ones(len(a), bool)
    for lo in range(0, len(a), 1 << 14):
        x, y, n = a[lo : lo + (1 << 14)], b[lo : lo + (1 << 14)], size[lo : lo + (1 << 14)]
        step = np.arange(int(n.max()) if len(n) else 0)
        here = step < n[:, None]
        i, j = (np.minimum(v[:, None] + step, len(data) - 1) for v in (x, y))
        out[lo : lo + (1 << 14)] = ((data[i] == data[j]) | ~here).all(1)
    return out


def extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common extension from a and b, at most `most`: binary search over prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), most.copy()
    while len(lo) and (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = span_hashes(prefix, a, a + mid) == span_hashes(prefix, b, b + mid)
        lo = np.where(same, mid, lo)
        hi = np.where(same, hi, mid - 1)
    return lo


def suffix_sort(data: np.ndarray, prefix: np.ndarray, cls: np.ndarray, pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (pos, compared over size bytes) within each class, and the common extension with the one before.

    A bottom-up mergesort over all classes at once: in each pass, every suffix
    finds its rank in the neighbouring run by binary search. Stable. Classes
    must come together in cls.
    """
    n = len(pos)
    order = np.arange(n)
    begin = np.searchsorted(cls, cls, side="left")
    count = np.searchsorted(cls, cls, side="right") - begin
    place = order - begin
    run = 1
    while n and run < count.max():
        number = place // run
        other = begin + (number ^ 1) * run
        room = np.minimum(begin + count - other, run)
        active = np.nonzero((room > 0) & (count > run))[0]
        me = order[active]
        right = (number[active] & 1) == 1
        lo, hi = np.zeros(len(active), np.int64), room[active].copy()
        todo = np.arange(len(active))
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            you = order[other[active[todo]] + mid]
            mine = me[todo]
            most = np.minimum(size[mine], size[you])
            ext = extension(prefix, pos[mine], pos[you], most)
            tie = ext == most
            a, b = (data[np.minimum(p + ext, len(data) - 1)] for p in (pos[you], pos[mine]))
            shorter = size[you] < size[mine]
            equal = tie & (size[you] == size[mine])
            before = np.where(equal, right[todo], np.where(tie, shorter, a < b))
            lo[todo] = np.where(before, mid + 1, lo[todo])
            hi[todo] = np.where(before, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        moved = order.copy()
        pair = begin[active] + (number[active] & ~1) * run
        moved[pair + place[active] % run + lo] = me
        order = moved
        run *= 2
    ext = np.zeros(n, np.int64)
    if n > 1:
        next_to = np.nonzero(cls[order[1:]] == cls[order[:-1]])[0] + 1
        a, b = order[next_to - 1], order[next_to]
        ext[next_to] = extension(prefix, pos[a], pos[b], np.minimum(size[a], size[b]))
    return order, ext


def repeats(data: np.ndarray, prefix: np.ndarray, cls: np.ndarray, pos: np.ndarray, size: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each suffix (pos, size) the index of the one of least rank in its class that begins with the same `length` bytes.

    Suffixes that do are neighbours in the order, with a common extension of that length.
    """
    by = np.argsort(cls, kind="stable")
    order, ext = suffix_sort(data, prefix, cls[by], pos[by], size[by])
    order = by[order]
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        hit = np.nonzero((cls[a] == cls[b]) & (ext[1:] >= length))[0]
        true = same_bytes(data, pos[a[hit]], pos[b[hit]], np.full(len(hit), length))
        same[hit[true] + 1] = True
        if not true.all():
            # A hash collision: these classes are sorted by their bytes.
            for c in np.unique(cls[b[hit[~true]]]):
                where = np.nonzero(cls[order] == c)[0]
                key = {i: data[pos[i] : pos[i] + length].tobytes() for i in order[where]}
                order[where] = sorted(order[where], key=lambda i: (key[i], i))
                same[where] = [k > where[0] and key[order[k]] == key[order[k - 1]] for k in where]
    group = np.cumsum(~same) - 1
    least = np.lexsort((rank[order], group))
    first = np.concatenate([[True], group[least][1:] != group[least][:-1]]) if len(order) else np.zeros(0, bool)
    head = order[least[first]] if len(order) else order
    out = np.empty(len(order), np.int64)
    out[order] = head[group] if len(order) else order
    return out


def ranks(doc: np.ndarray, start: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places in the order by document, start and, where texts share an id, row."""
    order = np.lexsort((row, start, doc))
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def furthest(data: np.ndarray, prefix: np.ndarray, cls: np.ndarray, pos: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How far each suffix goes along with any other of its class: with one of its neighbours in the order. Classes must come together."""
    order, ext = suffix_sort(data, prefix, cls, pos, size)
    out = np.empty(len(pos), np.int64)
    # Where a class begins the common extension with the one before is 0.
    out[order] = np.maximum(ext, np.append(ext[1:], 0))
    return out


def spans(part: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts: part, first, last."""
    order = np.lexsort((start, part))
    part, start = part[order], start[order]
    if not len(part):
        return part, start, start
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (start[1:] != start[:-1] + 1)])
    where = np.nonzero(new)[0]
    last = np.concatenate([where[1:] - 1, [len(start) - 1]])
    return part[where], start[where], start[last]


def raw_texts(block: pa.Table) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in block.column("text").to_pylist()]


def packed(first: np.ndarray, skip: np.ndarray, more: np.ndarray, copy: np.ndarray, length: int) -> np.ndarray:
    """One number for a context's first window, the anchor's place in it, its windows after the first, and whether it is known to be a copy. Ordered by the first window."""
    bits = length.bit_length()
    return ((first << bits | skip) << bits | more) << 1 | copy


def unpacked(place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bits = length.bit_length()
    least = (1 << bits) - 1
    return place >> 1 + 2 * bits, place >> 1 + bits & least, place >> 1 & least, (place & 1).astype(bool)


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """anchor, c1, c2 (digest of its context), doc, row and place (see packed).

    Of equal contexts in a block all but the first are copies; these go by their
    document, so that an anchor with very many rows doesn't meet in one task.
    """

    def make(block: pa.Table) -> dict | None:
        block = once(block)
        a = Anchors(raw_texts(block), length)
        if not len(a.at):
            return None
        doc, row = (np.asarray(block.column(c)).astype(np.int64)[a.doc] for c in ("doc", "row"))
        raw = a.data.tobytes()
        digest = b"".join([blake2b(raw[f:t], digest_size=16).digest() for f, t in zip(a.first.tolist(), (a.last + length).tolist(), strict=True)])
        c1, c2 = np.frombuffer(digest, np.int64).reshape(-1, 2).T
        anchor, first = a.hash.view(np.int64), a.first - a.begins[a.doc]
        order = np.lexsort((first, row, doc, c2, c1, anchor))
        copy = np.zeros(len(order), bool)
        x, y = order[1:], order[:-1]
        copy[x] = (anchor[x] == anchor[y]) & (c1[x] == c1[y]) & (c2[x] == c2[y])
        away = mix(doc.astype(np.uint64), 9).view(np.int64)
        return {"anchor": np.where(copy, away, anchor), "c1": np.where(copy, 0, c1), "c2": np.where(copy, 0, c2), "doc": doc, "row": row, "place": packed(first, a.at - a.first, a.last - a.first, copy, length)}

    return mapped(docs, make, "anchor long, c1 long, c2 long, doc long, row long, place long", most=1 << 19)


def once(block: pa.Table) -> pa.Table:
    """Repeated rows are one document."""
    one = np.unique(np.column_stack([np.asarray(block.column(c)).astype(np.int64) for c in ("doc", "row")]), axis=0, return_index=True)[1]
    return block.take(np.sort(one)) if len(one) < block.num_rows else block


CONTEXT = "key long, doc long, row long, first int, last int, skip int"


def told_apart(rows: DataFrame, length: int, frequent: int) -> DataFrame:
    """Contexts that equal an earlier one (kind 0), the different ones of anchors that have several (1), and of those with more than `frequent` (2); first and last are windows.

    Spark sorts the contexts of an anchor next to each other; a task holds the different ones of one anchor.
    """
    names = ("anchor", "c1", "c2", "doc", "row", "place")
    rows = rows.repartition("anchor").sortWithinPartitions(*names)

    def shown(kind, key, doc, row, place) -> pa.RecordBatch:
        first, skip, more, _ = unpacked(place, length)
        narrow = {c: x.astype(np.int32) for c, x in (("first", first), ("last", first + more), ("skip", skip))}
        return pa.RecordBatch.from_pydict({"key": key, "doc": doc, "row": row, **narrow, "kind": kind.astype(np.int32)})

    def run(batches):
        claim(__name__)
        held = [np.zeros(0, np.int64)] * len(names)

        def complete(heads):
            """Of anchors whose contexts have all passed."""
            new = np.append(True, heads[0][1:] != heads[0][:-1])
            which = np.cumsum(new) - 1
            kinds = np.bincount(which)[which]
            some = kinds > 1
            if some.any():
                yield shown(np.where(kinds > frequent, 2, 1)[some], *(heads[k][some] for k in (0, 3, 4, 5)))

        for block in gathered(batches, 1 << 16):
            now = [np.asarray(block.column(c)).astype(np.int64) for c in names]
            copy = unpacked(now[5], length)[3]
            now = [np.append(h, x[~copy]) for h, x in zip(held, now, strict=True)] + [x[copy] for x in now]
            (anchor, c1, c2, doc, row, place), known = now[:6], now[6:]
            same = np.zeros(len(anchor), bool)
            same[1:] = (anchor[1:] == anchor[:-1]) & (c1[1:] == c1[:-1]) & (c2[1:] == c2[:-1])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(anchor))))
            # A repeated row is the same document, so its contexts are no repeats.
            gone = same & ((doc != doc[head]) | (row != row[head]) | (place != place[head]))
            doc, row, place = (np.append(x[gone], known[k]) for k, x in ((3, doc), (4, row), (5, place)))
            if len(doc):
                none = np.zeros(len(doc), np.int64)
                yield shown(none, none, doc, row, place)
            heads = [x[~same] for x in now[:6]]
            if len(heads[0]):
                cut = int(np.searchsorted(heads[0], heads[0][-1], side="left"))
                yield from complete([x[:cut] for x in heads]) if cut else ()
                held = [x[cut:] for x in heads]
        if len(held[0]):
            yield from complete(held)

    return rows.mapInArrow(run, f"{CONTEXT}, kind int")


def gathered(batches, most: int):
    """Batches joined to tables of at least `most` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def contexts(joined: DataFrame, length: int) -> DataFrame:
    """The bytes of contexts, from texts with a list of these; often: of an anchor with too many for one task."""

    def make(block: pa.Table) -> dict | None:
        block = once(block)
        lists = block.column("contexts").combine_chunks()
        flat, owner = lists.flatten(), np.repeat(np.arange(block.num_rows), np.diff(np.asarray(lists.offsets)))
        raw = raw_texts(block)
        first, last = (np.asarray(flat.field(c)) for c in ("first", "last"))
        context = pa.array([raw[k][f : t + length] for k, f, t in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True)], pa.binary())
        whose = {c: block.column(c).combine_chunks().take(pa.array(owner)) for c in ("doc", "row")}
        return {"key": flat.field("key")} | whose | {c: flat.field(c) for c in ("first", "last", "skip", "often")} | {"context": context}

    return mapped(joined, make, f"{CONTEXT}, often boolean, context binary", most=1 << 20)


def dealt(rows: DataFrame, length: int, width: int) -> DataFrame:
    """Contexts cut into groups of up to `width` windows, whose key is the hash of the bytes that all windows of a group hold.

    Windows that are equal have their anchor at the same place. So where the groups
    are counted from the anchor, they fall into the same group, and hold the same
    bytes there; where these begin is the group's anchor.
    """

    def make(block: pa.Table) -> dict | None:
        key, doc, row, first, last, skip = (np.asarray(block.column(c)).astype(np.int64) for c in ("key", "doc", "row", "first", "last", "skip"))
        raw = b"".join(block.column("context").to_pylist())
        pos = np.cumsum(last - first + length) - (last - first + length)
        prefix = prefix_hashes(np.frombuffer(raw, np.uint8))
        low, high = (skip - (last - first)) // width, skip // width
        which = np.repeat(np.arange(len(key)), high - low + 1)
        group = np.arange(len(which)) - np.searchsorted(which, which) + low[which]
        core = skip[which] - group * width
        lo, hi = np.maximum(core - width + 1, 0), np.minimum(core, (last - first)[which])
        at = pos[which] + core
        code = mix(span_hashes(prefix, at, at + length - width + 1) + mix(key[which].view(np.uint64) + group.astype(np.uint64), 6), 5)
        begin, end = (pos[which] + x for x in (lo, hi + length))
        context = pa.array([raw[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
        narrow = {c: x.astype(np.int32) for c, x in (("first", first[which] + lo), ("last", first[which] + hi), ("skip", core - lo))}
        return {"key": code.view(np.int64), "doc": doc[which], "row": row[which], **narrow, "context": context}

    return mapped(rows, make, f"{CONTEXT}, context binary", size_of="context", most=1 << 18)


def solved(block: pa.Table, length: int) -> pa.RecordBatch | None:
    """Spans of repeated windows among the contexts of a block that holds all different contexts of its anchors."""
    key, row, doc, first, last, skip = (np.asarray(block.column(c)).astype(np.int64) for c in ("key", "row", "doc", "first", "last", "skip"))
    data = np.frombuffer(b"".join(block.column("context").to_pylist()), np.uint8)
    wide = last - first + length
    pos = np.cumsum(wide) - wide
    prefix = prefix_hashes(data)
    _, group = np.unique(key, return_inverse=True)
    out = []
    left = np.nonzero(np.bincount(group)[group] > 1)[0]
    left = left[np.argsort(group[left], kind="stable")]
    if len(left):
        # From its anchor on, a context goes along with others for so many bytes to the right, and so many to the left:
        # only windows within both can be repeated.
        anchor, back = pos[left] + skip[left], np.ascontiguousarray(data[::-1])
        right = furthest(data, prefix, group[left], anchor, wide[left] - skip[left])
        before = furthest(back, prefix_hashes(back), group[left], len(data) - anchor, skip[left])
        lo = np.maximum(skip[left] - before, 0)
        hi = np.minimum(skip[left] - length + right, wide[left] - length)
        left, lo, hi = (x[lo <= hi] for x in (left, lo, hi))
        for part in split(group[left], hi - lo + 1, 1 << 19):
            count = (hi - lo)[part] + 1
            which = np.repeat(left[part], count)
            off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[part], count)
            # The windows of an anchor can only equal others with the anchor at the same place.
            cls = group[which] * (length + 1) + skip[which] - off
            head = repeats(data, prefix, cls, pos[which] + off, wide[which] - off, ranks(doc[which], first[which] + off, row[which]), length)
            again = (doc[which][head] != doc[which]) | (row[which][head] != row[which]) | ((first[which] + off)[head] != first[which] + off)
            out.append(spans(which[again], (first[which] + off)[again]))
    if not out:
        return None
    k, f, t = (np.concatenate(x) for x in zip(*out, strict=True))
    return span_rows(doc[k], row[k], f, t) if len(k) else None


def span_rows(doc: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc": doc, "row": row, "first": first.astype(np.int32), "last": last.astype(np.int32)})


def merged(block: pa.Table) -> tuple[pa.RecordBatch | None, pa.Table]:
    """Of a block sorted by key and code: the spans of contexts that equal the one before, and the others.

    A repeated row is the same document, so its contexts are no repeats.
    """
    key, code, skip, doc, row, first, last = (np.asarray(block.column(c)).astype(np.int64) for c in ("key", "code", "skip", "doc", "row", "first", "last"))
    raw = block.column("context").to_pylist()
    data, wide = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
    pos = np.cumsum(wide) - wide
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (code[1:] == code[:-1]) & (skip[1:] == skip[:-1]) & (wide[1:] == wide[:-1])
    hit = np.nonzero(same)[0]
    same[hit] = same_bytes(data, pos[hit - 1], pos[hit], wide[hit])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
    gone = same & ((doc != doc[head]) | (row != row[head]) | (first != first[head]))
    out = span_rows(doc[gone], row[gone], first[gone], last[gone]) if gone.any() else None
    return out, block.filter(pa.array(~same))


def sorted_repeats(rows: DataFrame, length: int) -> DataFrame:
    """Spans (doc, row, first, last) of repeated windows among contexts of the same anchor.

    Spark sorts equal contexts next to each other, so that all but the first are
    settled as they pass; a task holds the different contexts of an anchor.
    """
    rows = rows.withColumn("code", F.xxhash64("context")).repartition("key").sortWithinPartitions("key", "code", "doc", "first", "row")

    def run(batches):
        claim(__name__)
        held = None
        for block in blocks(batches, "context", 1 << 20):
            # The last anchor's contexts may go on in the next block, and so may the last context.
            if held is not None:
                block = pa.concat_tables([held, block])
            gone, block = merged(block.combine_chunks())
            if gone is not None:
                yield gone
            key = np.asarray(block.column("key"))
            cut = int(np.searchsorted(key, key[-1], side="left"))
            held = block.slice(cut)
            if cut and (out := solved(block.slice(0, cut).combine_chunks(), length)) is not None:
                yield out
        if held is not None and (out := solved(held.combine_chunks(), length)) is not None:
            yield out

    return rows.mapInArrow(run, "doc long, row long, first int, last int")


def split(group: np.ndarray, weight: np.ndarray, most: int):
    """Index ranges of about `most` weight that keep groups together; groups need not be sorted."""
    order = np.argsort(group, kind="stable")
    heavy = np.cumsum(weight[order])
    at = 0
    while at < len(order):
        to = int(np.searchsorted(heavy, (heavy[at - 1] if at else 0) + most, side="right"))
        to = max(to, at + 1)
        if to < len(order):
            back = int(np.searchsorted(group[order], group[order[to]], side="left"))
            to = back if back > at else int(np.searchsorted(group[order], group[order[at]], side="right"))
        yield order[at:to]
        at = to


def removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, frequent: int = FREQUENT, carry: tuple[str, ...] = (), readable: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs: first byte, bytes), the remaining bytes and the columns `carry` of every row.

    With `readable` the remaining bytes come as `text` in place of `kept`; what is left of a character that was cut apart is dropped.

    Ids are whole numbers. Null texts count as empty. Identical rows are one
    document and don't repeat each other; other texts with the same id follow one
    another in a fixed order. Rows without an id come last. Texts
    shorter than `length` lose nothing. An empty table gives none.
    """
    whole_ids(df, id_col)
    scratch = Scratch(df.sparkSession, "suffixes")
    # Carried columns have names of their own in here, whatever they are called.
    names, carry = carry, tuple(f"_carried{k}" for k in range(len(carry)))
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)))
    docs = docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)))
    # Only where ids come again, rows with the same one are told apart by a hash.
    single = docs.groupBy("doc").count().filter("count > 1").isEmpty()
    keyed = docs.withColumn("row", F.lit(0).cast("long") if single else F.xxhash64("doc_id", "text"))
    long = keyed.filter(F.octet_length("text") >= length).select("text", "doc", "row")
    found = scratch.save(told_apart(anchor_rows(long, length), length, frequent), "found", partition_by="kind")
    lists = found.filter("kind > 0").groupBy("doc", "row").agg(F.collect_list(F.struct("key", "first", "last", "skip", (F.col("kind") == 2).alias("often"))).alias("contexts"))
    parts = scratch.save(contexts(long.join(lists, ["doc", "row"]), length), "contexts")
    width = max(1, length // PARTS)
    groups = scratch.save(dealt(parts.filter("often"), length, width), "groups")
    crowded = scratch.save(groups.groupBy("key").count().filter(F.col("count") > frequent).select("key"), "crowded")
    rows = parts.filter("not often").drop("often").unionByName(groups.join(crowded, "key", "left_anti")).unionByName(dealt(groups.join(crowded, "key", "left_semi"), length, 1))
    out = scratch.save(sorted_repeats(rows, length), "spans")
    scratch.drop("contexts", "groups", "crowded")
    out = out.unionByName(found.filter("kind = 0").select("doc", "row", "first", "last"))
    lists = out.groupBy("doc", "row").agg(F.collect_list(F.struct("first", "last")).alias("cover"))

    def shown(kept: list[bytes]) -> dict:
        return {"text": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())} if readable else {"kept": pa.array(kept, pa.binary())}

    def cut(block: pa.Table) -> dict:
        raw = raw_texts(block)
        kept, runs = [], []
        for text, cover in zip(raw, block.column("cover").to_pylist(), strict=True):
            if not cover:
                kept.append(text)
                runs.append([])
                continue
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, [c["first"] for c in cover], 1)
            np.add.at(edge, [c["last"] + length for c in cover], -1)
            gone = np.cumsum(edge)[:-1] > 0
            turn = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            lo, hi = np.nonzero(turn == 1)[0], np.nonzero(turn == -1)[0]
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            runs.append([{"first": int(a), "bytes": int(b - a)} for a, b in zip(lo, hi, strict=True)])
        kind = pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())]))
        return {c: block.column(c).combine_chunks() for c in carry} | {"doc_id": block.column("doc_id").combine_chunks(), "n_bytes": pa.array([len(r) for r in raw], pa.int64()), "spans": pa.array(runs, kind)} | shown(kept)

    name = df.schema[id_col].dataType.simpleString()
    kinds = "".join(f"{c} {df.schema[n].dataType.simpleString()}, " for n, c in zip(names, carry, strict=True))
    out = mapped(keyed.join(lists, ["doc", "row"], "left").select("doc_id", "text", "cover", *carry), cut, kinds + f"doc_id {name}, n_bytes long, spans array<struct<first: bigint, bytes: bigint>>, " + ("text string" if readable else "kept binary"), most=1 << 20)
    return out.withColumnsRenamed(dict(zip(carry, names, strict=True)))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["bytes"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


__all__ = ["op2_suffixes", "removed", "suffix_sort"]
