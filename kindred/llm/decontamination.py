"""Finding benchmark passages by the q-gram lemma, verified by banded alignment.

Texts are compared with A-Z lower-cased and white space runs as one space. An item of m bytes may differ by
k = floor(m * edit_rate) edits. A region that holds it keeps at least T = m + 1 - q - k q of the item's q-grams, on
diagonals that spread over at most k: shared q-grams are counted in overlapping diagonal bands, bands that reach T are
kept, and a banded alignment of the item in that region decides. q is the longest that leaves T at ROOM or more (8 to 16
bytes), so nothing within the budget is missed; an edit rate that leaves T no room is refused. Items shorter than ``min_bytes`` are searched for exactly, as whole words.

The items are a stated query set: they are read to the driver in blocks of ``block_bytes`` and each block is searched in
one pass over all documents. Where there are several, each pass is written to the shared folder and its block let go, so
neither the driver nor a worker holds more than one.

Null and empty texts and items have no match; without documents or items there is none. A very long text is searched
whole, in overlapping parts. Repeated rows are searched alike; repeated items each match, and so do several places of one item.
Documents are passed over row by row, so ids may repeat or be null; all their columns are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_U = np.uint64
_FILTER = 1 << 20
#: Edits that a passage may have, as a share of the item's bytes.
EDIT_RATE = 0.08
#: Shared q-grams that a match must have at least, where the item is long enough; fewer make the filter weak.
ROOM = 8


def normalise(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, original place of each byte): lower case, one space for each run of white space, none outside."""
    space = C._SPACE[d]
    start, end, row = C.words(d, o)
    keep = ~space
    follows = np.r_[row[1:] == row[:-1], np.zeros(1 if len(row) else 0, bool)][: len(row)]
    keep[end[follows]] = True  # the first white space between two words of a row
    place = np.flatnonzero(keep)
    out = C.LOWER[d[place]].copy()
    out[space[place]] = 32
    return out, np.searchsorted(place, o), place


@dataclass
class GramIndex:
    """q-grams of the items that use this q: sorted hashes with (item, place) postings, and a filter in front."""

    q: int
    items: list[int]
    hashes: np.ndarray
    first: np.ndarray
    count: np.ndarray
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray

    @staticmethod
    def grams(d: np.ndarray, q: int) -> np.ndarray:
        if len(d) < q:
            return np.zeros(0, _U)
        padded = np.r_[d, np.zeros(8, np.uint8)].tobytes()
        word = np.ndarray((len(d) + 1,), "<u8", padded, strides=(1,))
        n = len(d) - q + 1
        h = word[:n] * C.ODD[50]
        if q > 8:
            h ^= h >> _U(31)
            h += (word[8 : 8 + n] & _U((1 << 8 * (q - 8)) - 1)) * C.ODD[51]
        return C.mix(h)

    @classmethod
    def build(cls, q: int, items: list[int], texts: list[np.ndarray]) -> GramIndex:
        h = [cls.grams(texts[i], q) for i in items]
        item = np.repeat(np.array(items, np.int64), [len(x) for x in h])
        at = np.concatenate([np.arange(len(x)) for x in h])
        h = np.concatenate(h)
        by = np.argsort(h, kind="stable")
        h, item, at = h[by], item[by], at[by]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        seen = np.zeros(_FILTER, bool)
        seen[(h & _U(_FILTER - 1)).astype(np.int64)] = True
        return cls(q, items, h[first], first, np.diff(np.r_[first, len(h)]), item, at, seen)

    def hits(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the item, place in the text) of each shared q-gram."""
        h = self.grams(d, self.q)
        j = np.flatnonzero(self.seen[(h & _U(_FILTER - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, h[j]), len(self.hashes) - 1)
        ok = self.hashes[k] == h[j]
        j, k = j[ok], k[ok]
        n = self.count[k]
        p = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.item[p], self.at[p], np.repeat(j, n)


class ShortIndex:
    """Items that are searched for exactly, as whole words, by the hash of their bytes."""

    def __init__(self, items: list[int], texts: list[np.ndarray]):
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(texts[i]) for i in items}):
            own = [i for i in items if len(texts[i]) == size]
            h = np.array([C.between(C.running(C.BYTE[texts[i]]), np.array([0]), np.array([size]))[0] for i in own], _U)
            order = np.argsort(h, kind="stable")
            self.by[size] = h[order], np.array(own)[order]

    def find(self, d: np.ndarray, o: np.ndarray, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, start, end) in normalised bytes."""
        start, end, row = C.words(d, o)
        sums = C.running(C.BYTE[d])
        last = np.zeros(len(d) + 1, bool)
        last[end] = True
        for size, (hashes, items) in self.by.items():
            on = start + size <= o[row + 1]
            s, r = start[on], row[on]
            on = last[s + size]
            s, r = s[on], r[on]
            h = C.between(sums, s, s + size)
            lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            for f in np.flatnonzero(hi > lo):
                for i in items[lo[f] : hi[f]]:
                    if np.array_equal(d[s[f] : s[f] + size], texts[i]):
                        yield int(r[f]), int(i), int(s[f]), int(s[f]) + size


class Searcher:
    def __init__(self, items: list[tuple[int, str]], edit_rate: float, min_bytes: int):
        self.ids = [i for i, _ in items]
        self.texts, self.budget, short = [], [], []
        by_q: dict[int, list[int]] = {}
        for n, (_, t) in enumerate(items):
            x = np.frombuffer((t or "").encode(), np.uint8)
            x = normalise(x, np.array([0, len(x)]))[0]
            k = int(len(x) * edit_rate)
            self.texts.append(x)
            self.budget.append(k)
            if len(x) >= min_bytes:
                q = min(16, max(8, (len(x) + 1 - ROOM) // (k + 1)))
                if len(x) + 1 - q - k * q < 1:
                    raise ValueError(f"an item of {len(x)} bytes with {k} edits is beyond the q-gram filter")
                by_q.setdefault(q, []).append(n)
            elif len(x):
                short.append(n)
        self.indexes = [GramIndex.build(q, own, self.texts) for q, own in sorted(by_q.items())]
        self.short = ShortIndex(short, self.texts)
        self.size = np.array([len(x) for x in self.texts] or [0])
        self.k = np.array(self.budget or [0])
        self.shift = np.array([max(1, int(k).bit_length()) for k in self.k])
        self.longest = int(self.size.max(initial=0))

    def find(self, d: np.ndarray, o: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of each match; start and end are byte offsets in the row."""
        norm, offs, place = normalise(d, o)
        found: dict[tuple, int] = {}
        for r, i, s, e in self.short.find(norm, offs, self.texts) if self.short.by else ():
            found[r, i, int(place[s] - o[r]), int(place[e - 1] + 1 - o[r])] = 0
        for index in self.indexes:
            item, at, j = index.hits(norm)
            if not len(j):
                continue
            row = np.searchsorted(offs, j, side="right") - 1
            inside = j + index.q <= offs[row + 1]
            item, at, j, row = item[inside], at[inside], j[inside], row[inside]
            band = (j - at) >> self.shift[item]
            row, item, band, at = np.r_[row, row], np.r_[item, item], np.r_[band, band - 1], np.r_[at, at]
            by = np.lexsort((band, item, row))
            row, item, band, at = row[by], item[by], band[by], at[by]
            if not len(row):
                continue
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
            count = np.diff(np.r_[first, len(row)])
            i = item[first]
            least = self.size[i] + 1 - index.q - self.k[i] * index.q
            for n in np.flatnonzero(count >= least):
                f = first[n]
                if len(np.unique(at[f : f + count[n]])) < least[n]:  # places of the item, which a text may repeat
                    continue
                r, i, b = int(row[f]), int(item[f]), int(band[f])
                lo = max(int(offs[r]), (b << self.shift[i]) - self.budget[i])
                hi = min(int(offs[r + 1]), (b << self.shift[i]) + (2 << self.shift[i]) + int(self.size[i]) + self.budget[i])
                hit = self.verify(norm[lo:hi], i)
                if hit:
                    s, e, edits = hit
                    found[r, i, int(place[lo + s] - o[r]), int(place[lo + e - 1] + 1 - o[r])] = edits
        return [(r, i, s, e, n) for (r, i, s, e), n in found.items()]

    def verify(self, region: np.ndarray, i: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the item's best occurrence in the region, if within its budget."""
        item, k = self.texts[i], self.budget[i]
        at = region.tobytes().find(item.tobytes())
        if at >= 0:
            return at, at + len(item), 0
        end, edits = banded_alignment(item, region, None)
        if edits > k:
            return None
        back, _ = banded_alignment(item[::-1], region[:end][::-1], k)
        return end - back, end, edits


def banded_alignment(item: np.ndarray, text: np.ndarray, spread: int | None) -> tuple[int, int]:
    """(end in the text, edits) of the item's best alignment, over the diagonals the text's length leaves.

    It may start anywhere, or, with ``spread``, at the text's start and within so many diagonals of it.
    """
    m, n = len(item), len(text)
    lo, hi = (-spread, spread) if spread is not None else (-(m - min(m, n)) - 0, max(0, n - m))
    pad = m // 8 + 1 if spread is None else 0
    lo, hi = lo - pad, hi + pad
    diag = np.arange(lo, hi + 1)
    big = m + n + 1
    d = np.where((diag >= 0) & (diag <= n), 0 if spread is None else diag, big)
    step = np.arange(len(diag))
    for r in range(1, m + 1):
        j = diag + r  # column after this item byte
        same = np.zeros(len(diag), bool)
        ok = (j >= 1) & (j <= n)
        same[ok] = text[j[ok] - 1] == item[r - 1]
        new = d + ~same
        new[:-1] = np.minimum(new[:-1], d[1:] + 1)
        new[~((j >= 0) & (j <= n))] = big
        new = np.minimum(np.minimum.accumulate(new - step) + step, big)
        new[~((j >= 0) & (j <= n))] = big
        d = new
    best = int(d.argmin())
    return int(diag[best] + m), int(d[best])


def _parts(d: np.ndarray, o: np.ndarray, overlap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, _, x, y in C.chunks(d, o):
        if len(x) <= 2 * C.CHUNK:
            yield i, 0, x, y
        else:
            for at in range(0, len(x), C.CHUNK):
                z = x[at : at + C.CHUNK + overlap]
                yield i, at, z, np.array([0, len(z)])


def _matches(searcher: Searcher, b: pa.RecordBatch, text: str) -> list[tuple[int, int, int, int, int]]:
    data, offs = C.flat(b.column(text))
    out = []
    for i, at, d, o in _parts(data, offs, 4 * searcher.longest + 4096):
        out += [(i + r, searcher.ids[k], at + s, at + e, n) for r, k, s, e, n in searcher.find(d, o)]
    return sorted(set(out))


def blocks(bench: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The query set in blocks, streamed to the driver one partition at a time."""
    held, size = [], 0
    for r in bench.select(F.col(f"`{item_id}`").cast("long").alias("i"), C.text_col(text).alias("t")).where("t <> ''").toLocalIterator():
        held.append((r.i, r.t))
        size += len(r.t)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _with_last(items: Iterator) -> Iterator[tuple[object, bool]]:
    held = next(items, None)
    while held is not None:
        after = next(items, None)
        yield held, after is None
        held = after


def _check(edit_rate: float, min_bytes: int) -> None:
    if not (0 <= edit_rate <= 0.1 and min_bytes >= 24):
        raise ValueError("edit_rate lies between 0 and 0.1, and min_bytes is 24 or more: beyond that the q-gram filter has no room")


def find_leaks(docs: DataFrame, bench: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", edit_rate: float = EDIT_RATE, min_bytes: int = 32, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, start, end, edits) of each benchmark passage; start and end are byte offsets in the text."""
    _check(edit_rate, min_bytes)
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), C.text_col(text).alias("_text")).where(F.octet_length("_text") > 0)
    out = None
    for items, last in _with_last(blocks(bench, item_id, item_text, block_bytes)):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def rows(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(held.value, edit_rate, min_bytes)
            for b in batches:
                m = _matches(searcher, b, "_text")
                if m:
                    r, i, s, e, n = zip(*m, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(r)), pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(n, pa.int32())], names=["_id", "item_id", "start", "end", "edits"])

        part = src.mapInArrow(C.released(rows), "_id long, item_id long, start long, end long, edits int")
        if not last:
            part = C.stash(part)
            held.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = src.sparkSession.createDataFrame([], "_id long, item_id long, start long, end long, edits int")
    return out.withColumnRenamed("_id", doc_id)


def drop_leaks(docs: DataFrame, bench: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", edit_rate: float = EDIT_RATE, min_bytes: int = 32, block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; all columns stay."""
    _check(edit_rate, min_bytes)
    schema = docs.schema
    for items, last in _with_last(blocks(bench, item_id, item_text, block_bytes)):
        held = docs.sparkSession.sparkContext.broadcast(items)
        src, (tmp,) = C.with_helpers(docs, (), _text=C.text_col(text))

        def rows(batches: Iterator[pa.RecordBatch], held=held, tmp=tmp) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(held.value, edit_rate, min_bytes)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[m[0] for m in _matches(searcher, b, tmp)]] = False
                yield b.filter(pa.array(clean)).drop_columns([tmp])

        docs = src.mapInArrow(C.released(rows), schema)
        if not last:
            docs = C.stash(docs)
            held.unpersist()
    return docs
