"""Ranked lexical search by a hierarchical max tree over ranges of documents.

Documents are read once for a block of items: a map task keeps of each text its length and how often the items' terms
occur in it. Runs of some thousand such documents, ordered by length, are shards; within a shard every term has a tree of
maxima: what it adds to a document's score, at most, in each range of documents, then in each range of ranges. An item's
search starts at the root and always opens the node with the highest sum of its terms' maxima; at a leaf documents are
scored exactly. It ends when the highest bound is below the last place's score: nodes of an equal bound are still opened,
since they may hold a smaller id. A task goes through its shards with the places it has filled so far, so that later
shards start with a high last place, and the tasks' places are ranked together at the end.

All of it is exact: bounds only decide what need not be scored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Terms, over all items, that one reading of the documents looks for; more items are searched in blocks. 16 bytes each are sent to the tasks.
BLOCK = 1 << 20
#: Documents of a shard, postings at which it ends early, documents of a leaf, and children of a node.
SHARD, POSTINGS, LEAF, FAN = 1 << 14, 1 << 22, 16, 8

#: Bytes outside terms: all ASCII but letters and digits. As a pattern over characters:
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAPS = np.ones(256, bool)
_GAPS[128:] = False
_GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

_COUNTED = "id long, n long, t binary, f binary"
_FOUND = "item long, id long, score long"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = 50, b: int = 50, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``most`` documents of highest score above 0, from rank 1.

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. N counts the
    documents with a term, L their terms, n a document's terms, df the documents with a term, tf how often a document has
    it. A term's weight is w = floor(1000 ln((2 N + 2) / (2 df + 1))); with m = 100 - b + (b n N) // L the score is the sum of
    w ((10**9 tf) // (1000 tf + k m)) over the item's distinct terms, all in 64-bit integers. Equal scores go by ascending
    id, a null id last. Terms are told apart by 64-bit hashes.

    A null or empty text has no terms: such an item has no rows, such a document is never found. Rows that repeat an
    id are documents, or items, of their own. Texts may be of any length; an empty table gives no rows. Other columns are
    not looked at.
    """
    spark = docs.sparkSession
    lower = F.translate(F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    asked = C.stash(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id}`").alias("item_id"), F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("terms")).where(F.size("terms") > 0))
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK)
    parts = [_block(spark, docs, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i), doc_id, text, most, b, k) for i in range(blocks)]
    found = spark.createDataFrame([], _FOUND)
    for p in parts:
        found = found.unionByName(p) if p is not None else found
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def _block(spark, docs: DataFrame, asked: DataFrame, doc_id: str, text: str, most: int, b: int, k: int) -> DataFrame | None:
    """(item, id, score): the places that each task fills for the items of one block, about BLOCK terms or one item."""
    rows = asked.select("item", "terms").collect()
    if not rows:
        return None
    names = sorted({t for r in rows for t in r.terms})
    vocabulary, where = _vocabulary(names)
    place = dict(zip(names, where.tolist(), strict=True))
    own = {r.item: np.array(sorted(place[t] for t in r.terms), np.int64) for r in rows}
    words = spark.sparkContext.broadcast(vocabulary)
    counted = C.stash(docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(lambda batches: _counted(batches, words.value), _COUNTED))
    n, length = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = counted.select("t").mapInArrow(lambda batches: _documents(batches, len(names)), "t int, c long").groupBy("t").agg(F.sum("c").alias("c"))
    df = np.zeros(len(names), np.int64)
    for r in each.collect():  # as few as the block has terms
        df[r.t] = r.c
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    held = spark.sparkContext.broadcast((own, weight))
    return C.stash(counted.mapInArrow(lambda batches: _places(batches, *held.value, n=n, length=length, most=most, b=b, k=k), _FOUND))


def _vocabulary(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms, ascending, and the place of each term in them."""
    raw = [t.encode() for t in names]
    ends = np.cumsum([len(t) for t in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    h = C.word_hashes(data, ends - [len(t) for t in raw], ends)
    by = np.argsort(h)
    where = np.empty(len(h), np.int64)
    where[by] = np.arange(len(h))
    return h[by], where


# --------------------------------------------------------------------------- counts
def _counted(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, n, t, f): each document's number of terms, and the terms of the vocabulary it has (int32) and how often (int32)."""
    for batch in batches:
        data, offs = C.flat(batch.column(1))
        for i, j, part, at in C.chunks(data, offs):
            low = C.LOWER[part]
            start, end, row = C.words(low, at, _GAPS)
            n = np.bincount(row, minlength=j - i)
            h = C.word_hashes(low, start, end) if len(start) else np.zeros(0, np.uint64)
            t = np.searchsorted(vocabulary, h)
            t[t == len(vocabulary)] = 0
            hit = vocabulary[t] == h
            key, f = np.unique(row[hit] * len(vocabulary) + t[hit], return_counts=True)
            cut = 4 * np.searchsorted(key, np.arange(j - i + 1) * len(vocabulary))
            packed = [_packed(v, cut) for v in (key % len(vocabulary), f)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), *packed], names=["id", "n", "t", "f"])


def _packed(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(values.astype(np.int32).tobytes())])


def _unpacked(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = C.flat(col)
    return np.frombuffer(data.tobytes(), np.int32), offs // 4


def _documents(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(t, c): in how many of a task's documents each term is."""
    c = np.zeros(size, np.int64)
    for batch in batches:
        c += np.bincount(_unpacked(batch.column(0))[0], minlength=size)
    t = np.flatnonzero(c)
    yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(c[t])], names=["t", "c"])


# --------------------------------------------------------------------------- search
def _places(batches: Iterator[pa.RecordBatch], own: dict[int, np.ndarray], weight: np.ndarray, *, n: int, length: int, most: int, b: int, k: int) -> Iterator[pa.RecordBatch]:
    places = {item: Places(most) for item in own}

    def run(parts: list[tuple]) -> None:
        if not parts:
            return
        ids, null, size, t, f, d = (np.concatenate(c) for c in zip(*parts, strict=True))
        tree = MaxTree(t, d, f, 100 - b + (b * size * n) // max(length, 1), size, weight, k)
        for item, terms in own.items():
            tree.search(terms, places[item], ids, null)

    parts, docs, postings = [], 0, 0
    for batch in batches:
        for i in range(0, batch.num_rows, SHARD // 4):
            part = batch.slice(i, SHARD // 4)
            if docs + part.num_rows > SHARD or postings > POSTINGS:
                run(parts)
                parts, docs, postings = [], 0, 0
            ids = part.column(0)
            t, offs = _unpacked(part.column(2))
            row = np.repeat(np.arange(part.num_rows), np.diff(offs)) + docs
            parts.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column(1).to_numpy(), t.astype(np.int64), _unpacked(part.column(3))[0].astype(np.int64), row))
            docs, postings = docs + part.num_rows, postings + len(t)
    run(parts)
    for item, p in places.items():
        if len(p.score):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p.score), item)), pa.array(p.id, mask=p.null), pa.array(p.score)], names=["item", "id", "score"])


class Places:
    """The best documents so far, highest score first, then smallest id, null ids last."""

    def __init__(self, most: int):
        self.most = most
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a document must reach: 1, or the last place's score once all are filled."""
        return int(self.score[-1]) if len(self.score) == self.most else 1

    def offer(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        s, i, z = np.r_[self.score, score], np.r_[self.id, ids], np.r_[self.null, null]
        by = np.lexsort((i, z, -s))[: self.most]
        self.score, self.id, self.null = s[by], i[by], z[by]


class MaxTree:
    """For each term the maxima of what it adds to a score, over ranges of LEAF documents, then of FAN ranges, and so on.

    A level's entries are sorted by term and range, so that an entry's children stand together in the level below:
    ``first[l][e] : first[l][e + 1]``. Level 0 has an entry for each posting.
    """

    def __init__(self, t: np.ndarray, d: np.ndarray, f: np.ndarray, m: np.ndarray, size: np.ndarray, weight: np.ndarray, k: int):
        self.order = np.argsort(size, kind="stable")  # documents of like length have like scores: bounds are close
        rank = np.empty(len(size), np.int64)
        rank[self.order] = np.arange(len(size))
        add = weight[t] * ((1_000_000_000 * f) // (1000 * f + k * m[d]))
        by = np.lexsort((rank[d], t))
        by = by[add[by] > 0]
        t, node, most = t[by], rank[d[by]], add[by]
        self.node, self.most, self.first = [node], [most], [np.arange(len(t) + 1)]
        width, last = LEAF, max(len(size) - 1, 0)
        while True:
            node = node // width
            last //= width
            head = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (node[1:] != node[:-1])]) if len(t) else np.zeros(0, np.int64)
            self.first.append(np.r_[head, len(t)])
            most = np.maximum.reduceat(most, head) if len(head) else most[:0]
            t, node = t[head], node[head]
            self.node.append(node)
            self.most.append(most)
            width = FAN
            if last == 0:
                break
        self.terms = t  # one entry a term at the root

    def search(self, terms: np.ndarray, places: Places, ids: np.ndarray, null: np.ndarray) -> None:
        if not len(self.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        at = at[self.terms[at] == terms]
        if not len(at):
            return
        top, seen = len(self.node) - 1, 0
        open_nodes = [(-int(self.most[top][at].sum()), seen, top, at)]
        while open_nodes and -open_nodes[0][0] >= places.least:
            _, _, level, entries = heapq.heappop(open_nodes)
            below = self._children(level, entries)
            node, most = self.node[level - 1][below], self.most[level - 1][below]
            base = int(node.min())
            bound = _added(node - base, most)
            good = np.flatnonzero(bound >= places.least)
            if level == 1:
                if len(good):
                    doc = self.order[good + base]
                    places.offer(bound[good], ids[doc], null[doc])
                continue
            by = np.argsort(node, kind="stable")
            cut = np.searchsorted(node[by], np.r_[good + base, good + base + 1])
            for g, lo, hi in zip(good.tolist(), cut[: len(good)].tolist(), cut[len(good) :].tolist(), strict=True):
                seen += 1
                heapq.heappush(open_nodes, (-int(bound[g]), seen, level - 1, below[by[lo:hi]]))

    def _children(self, level: int, entries: np.ndarray) -> np.ndarray:
        lo, hi = self.first[level][entries], self.first[level][entries + 1]
        size = hi - lo
        return np.repeat(hi - np.cumsum(size), size) + np.arange(int(size.sum()))


def _added(place: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by place, exactly."""
    if float(values.sum(dtype=float)) < 2.0**53:
        return np.bincount(place, values).astype(np.int64)
    out = np.zeros(int(place.max()) + 1, np.int64)
    np.add.at(out, place, values)
    return out
