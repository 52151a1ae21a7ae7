"""Exact removal of repeated byte strings, by deep-shallow sorting of anchored suffixes.

Every ``length``-byte string that also starts earlier (smaller id, or same document and earlier start) marks its bytes
for removal. Sorting all suffixes of the corpus together would move each byte ``length`` times, so suffixes are first
dealt into buckets by content:

1. *Anchors.* A string's anchor is the leftmost smallest k-gram hash inside it. It depends on the string's content
   alone, so equal strings share an anchor at equal distance and meet in one bucket. Neighbouring strings mostly share
   their anchor, so one row (an "extent") stands for some 40 strings: the corpus moves as 5 numbers per 40 bytes.
2. *Equal extents.* In a bucket all but the first of the extents with equal content are marked whole. Each map task does
   this to its own rows before the shuffle, so a passage in a third of all documents is a few rows per task.
3. *Deep-shallow sort.* Buckets in which different extents remain get their bytes, and their suffixes are sorted:
   multikey quicksort (eight bytes to a key) down to a shallow depth, then blind tries order each remaining group of
   long common prefixes. Runs whose common prefix reaches ``length`` are equal strings; all but the first are marked.
   Buckets with very many different extents are split by the content hash of the strings themselves.
4. *Cut.* Marks meet their document again by id.

Rows with equal id and text count as the same document (none repeats the other). A null text is empty, a null id sorts
before all others, and an empty table gives an empty result. Very long texts are cut
into parts that overlap. Input columns that have the name of an output are replaced and all others returned. Content is
compared by 64-bit hashes of whole extents where a bucket has one distinct extent, and byte by byte where it has more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

_U = np.uint64
K_GRAM = 24
SHALLOW = 48
TRIE = 10
#: Different extents of one bucket that a single task sorts; more are split by content.
BUCKET = 2_000
#: Extents that a task cuts or sorts at a time, but for a larger bucket; each has some 40 suffixes.
AT_ONCE = 5_000
_LOW = (1 << 20) - 1
_ANCHOR = "kh long, sh long, _id long, _th long, loc long, mark boolean"


# --------------------------------------------------------------------------- anchors
def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the K_GRAM bytes from each position."""
    n = len(data) - K_GRAM + 1
    word = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    h = word[:n] * C.ODD[20]
    h ^= h >> _U(29)
    h += word[8 : 8 + n] * C.ODD[21]
    h *= C.ODD[23]
    h ^= h >> _U(32)
    h += word[16 : 16 + n] * C.ODD[22]
    return C.mix(h)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by block prefix and suffix minima."""
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = x
    blocks = pad.reshape(-1, w)
    pre = np.minimum.accumulate(blocks, axis=1).ravel()
    suf = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def extents(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first start in the row, number of starts, anchor distance, k-gram hash, content hash) of each extent.

    ``data`` holds at most 2**20 bytes; a start is a place from which ``length`` bytes lie within one row.
    """
    if len(data) < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(_U), z.astype(_U)
    g = _grams(data)
    key = (g & ~_U(_LOW)) | np.arange(len(g), dtype=np.uint64)
    low = _sliding_min(key, length - K_GRAM + 1)
    at = (low & _U(_LOW)).astype(np.int32)
    ok = np.zeros(len(at) + 1, np.int32)
    size = np.diff(offs)
    long = size >= length
    np.add.at(ok, offs[:-1][long], 1)
    np.add.at(ok, offs[1:][long] - length + 1, -1)
    ok = np.cumsum(ok[:-1]).astype(bool)
    new = ok.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
    cut = offs[:-1][long]
    new[cut] = True
    end = ok.copy()
    end[:-1] &= new[1:] | ~ok[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(end)
    anchor = at[first].astype(np.int64)
    n = last - first + 1
    s = C.running(g)
    sh = C.between(s, first, last + length - K_GRAM + 1)
    sh ^= ((n << 10) | (anchor - first)).astype(np.uint64) * C.ODD[24]
    row = np.searchsorted(offs, first, side="right") - 1
    return row, first - offs[row], n, anchor - first, g[anchor], C.mix(sh)


def _pieces(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks for :func:`extents`: (first row, start within it, bytes, offsets); very long rows in overlapping parts."""
    part = 1 << 19
    for i, _, d, o in C.chunks(data, offs):
        if len(d) <= 1 << 20:
            yield i, 0, d, o
        else:
            for at in range(0, len(d) - length + 1, part):
                x = d[at : at + part + length - 1]
                yield i, at, x, np.array([0, len(x)])


def _anchor_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for b in batches:
            data, offs = C.flat(b.column("_text"))
            ids, th = b.column("_id").to_numpy(zero_copy_only=False), b.column("_th").to_numpy(zero_copy_only=False)
            for i, at, d, o in _pieces(data, offs, length):
                row, lo, m, delta, kh, sh = extents(d, o, length)
                if len(row):
                    loc = ((lo + at) << 16) | (m << 8) | delta
                    held.append((kh.view(np.int64), sh.view(np.int64), ids[i + row], th[i + row], loc))
                    n += len(row)
            if n >= 300_000:
                yield _combined(held, length)
                held, n = [], 0
        if held:
            yield _combined(held, length)

    return rows


def _combined(held: list[tuple[np.ndarray, ...]], length: int) -> pa.RecordBatch:
    """Extents of one task; those whose content occurs earlier in the task become marks at once."""
    kh, sh, ids, th, loc = (np.concatenate(x) for x in zip(*held, strict=True))
    by = np.lexsort((loc, th, ids, sh, kh))
    kh, sh, ids, th, loc = (x[by] for x in (kh, sh, ids, th, loc))
    again = np.zeros(len(kh), bool)
    again[1:] = (kh[1:] == kh[:-1]) & (sh[1:] == sh[:-1])
    same = np.zeros(len(kh), bool)  # rows of one document twice in the table do not repeat each other
    same[1:] = again[1:] & (ids[1:] == ids[:-1]) & (th[1:] == th[:-1]) & (loc[1:] == loc[:-1])
    again &= ~_twins(again, same)
    m_id, m_th, m_lo, m_hi = _merged(ids[again], th[again], loc[again] >> 16, (loc[again] >> 16) + ((loc[again] >> 8) & 255) + length - 1)
    keep = ~again & ~same
    salt = C.mix((m_id.astype(_U) * C.ODD[30]) ^ (m_lo.astype(_U) * C.ODD[31])).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.r_[kh[keep], salt]), pa.array(np.r_[sh[keep], m_hi]), pa.array(np.r_[ids[keep], m_id]), pa.array(np.r_[th[keep], m_th]), pa.array(np.r_[loc[keep], m_lo]), pa.array(np.r_[np.zeros(keep.sum(), bool), np.ones(len(m_id), bool)])],
        names=["kh", "sh", "_id", "_th", "loc", "mark"],
    )


def _twins(again: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Rows equal in all fields to a row that is itself the first of its content."""
    first = ~again
    twin = same.copy()
    for i in np.flatnonzero(same):  # few: only where a table repeats whole rows
        twin[i] = first[i - 1] or twin[i - 1]
    return twin


def _merged(ids: np.ndarray, th: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching spans of each document made one."""
    if not len(ids):
        return ids, th, lo, hi
    by = np.lexsort((hi, lo, th, ids))
    ids, th, lo, hi = ids[by], th[by], lo[by], hi[by]
    doc = np.cumsum(np.r_[True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1])])
    reach = np.maximum.accumulate(hi + doc * (np.int64(1) << 40)) - doc * (np.int64(1) << 40)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])]
    at = np.flatnonzero(new)
    return ids[at], th[at], lo[at], reach[np.r_[at[1:] - 1, len(ids) - 1]]


# --------------------------------------------------------------------------- bytes of contested extents
def _cut_rows(length: int, bucket: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = C.flat(b.column("_text"))
            lists = b.column("reps")
            ends = lists.offsets.to_numpy()
            flat = lists.flatten()
            kh, loc, m = (flat.field(x).to_numpy() for x in ("kh", "loc", "m"))
            ends = ends - ends[0]
            ids, th = b.column("_id").to_numpy(), b.column("_th").to_numpy()
            doc = np.repeat(np.arange(len(ids)), np.diff(ends))
            for i in range(0, len(kh), AT_ONCE):
                j = min(len(kh), i + AT_ONCE)
                yield _cut(data, offs, ids, th, doc[i:j], kh[i:j], loc[i:j], m[i:j], length, bucket)

    return rows


def _cut(data, offs, ids, th, doc, kh, loc, m, length, bucket) -> pa.RecordBatch:
    lo, n = loc >> 16, (loc >> 8) & 255
    start = offs[doc] + lo
    size = n + length - 1
    split = -(-m // bucket)
    pick = np.flatnonzero(split == 1)
    sub, part = np.zeros(len(pick), np.int64), [None] * len(pick)
    hot = np.flatnonzero(split > 1)
    if len(hot):
        more, subs = [], []
        for r in hot:
            x = data[start[r] : start[r] + size[r]]
            s = C.running(_grams(x))
            at = np.arange(n[r])
            h = C.mix(C.between(s, at, at + length - K_GRAM + 1)) % _U(split[r])
            for v in np.unique(h):
                more.append(r)
                subs.append(int(v))
                part.append(np.flatnonzero(h == v).astype(np.uint8).tobytes())
        pick, sub = np.r_[pick, more].astype(np.int64), np.r_[sub, subs].astype(np.int64)
    where = _ranges(start[pick], size[pick])
    ends = np.r_[0, np.cumsum(size[pick])].astype(np.int32)
    text = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[where].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(kh[pick]), pa.array(sub), pa.array(ids[doc[pick]]), pa.array(th[doc[pick]]), pa.array(loc[pick]), text, pa.array(part, pa.binary())], names=["kh", "sub", "_id", "_th", "loc", "bytes", "part"])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., for each start and size, concatenated."""
    if not len(start):
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(start - (ends - size), size)


# --------------------------------------------------------------------------- deep-shallow sort
def deep_shallow_classes(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """A class number for each suffix, equal where the first ``length`` bytes are equal and the groups are.

    Multikey quicksort on eight-byte keys splits the groups down to SHALLOW bytes; groups of up to TRIE suffixes that
    are still together go into blind tries, larger ones are sorted on. A suffix alone in its group has class -1.
    """
    word = np.ndarray((max(0, len(data) - 7),), ">u8", data.tobytes(), strides=(1,))
    depths = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    out = np.full(len(start), -1, np.int64)
    by = np.argsort(group, kind="stable")
    by, g = _shared(by, group[by])
    serial = 0
    for d in depths:
        if d >= SHALLOW and len(by):
            at = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
            size = np.diff(at)
            for m in range(2, TRIE + 1):
                of = at[:-1][size == m]
                if len(of):
                    members = by[of[:, None] + np.arange(m)]
                    order, lcp = blind_tries(data, word, start[members], d, depths, length)
                    members = np.take_along_axis(members, order, 1)
                    kind = np.cumsum(np.c_[np.ones(len(of), np.int64), lcp < length].ravel())
                    out[members.ravel()] = serial + kind
                    serial += int(kind[-1])
            rest = np.repeat(size > TRIE, size)
            by, g = by[rest], g[rest]
        if not len(by):
            break
        w = word[start[by] + d].astype(np.uint64)
        o = np.lexsort((w, g))
        by, g, w = by[o], g[o], w[o]
        by, g = _shared(by, np.cumsum(np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])]))
    if len(by):
        out[by] = serial + g
    return out


def _shared(by: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without those alone in their group."""
    if not len(g):
        return by, g
    new = np.r_[True, g[1:] != g[:-1], True]
    keep = ~(new[1:] & new[:-1])
    return by[keep], g[keep]


def blind_tries(data, word, starts, depth, depths, length) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes of each row of ``starts`` (equal up to ``depth``) with one blind trie per row.

    A trie is kept as its leaves in order plus the depth at which neighbours branch. To insert, the blind search looks
    only at branching bytes; one comparison with the leaf found gives the true depth, and with it the place. All rows
    advance together. Returns (order, common prefix of neighbours, at most ``length``).
    """
    rows, m = starts.shape
    every = np.arange(rows)
    order = np.zeros((rows, 1), np.int64)
    lcp = np.zeros((rows, 0), np.int64)
    last = len(data) - 1
    for r in range(1, m):
        s = starts[:, r]
        leaf = np.zeros(rows, np.int64)
        skip = np.full(rows, length + 1)
        for i in range(1, r):
            d = lcp[:, i - 1]
            seen = d < skip
            branch = np.minimum(d, length - 1)
            up = data[np.minimum(s + branch, last)] >= data[np.minimum(starts[every, order[:, i]] + branch, last)]
            up |= d >= length
            leaf = np.where(seen & up, i, leaf)
            skip = np.where(seen, np.where(up, length + 1, d), skip)
        other = starts[every, order[every, leaf]]
        true = np.full(rows, length)
        open_ = np.ones(rows, bool)
        for d in depths:
            if d + 8 <= depth:
                continue
            x = word[s + d].astype(np.uint64) ^ word[other + d].astype(np.uint64)
            hit = open_ & (x != 0)
            if hit.any():
                lead = 63 - np.floor(np.log2(np.maximum(x[hit], _U(1)).astype(np.float64))).astype(np.int64)
                lead = np.where((x[hit] >> (_U(63) - np.clip(lead, 0, 63).astype(_U))) == 0, lead + 1, lead)
                true[hit] = d + lead // 8
                open_ &= ~hit
        at = np.minimum(true, length - 1)
        after = (true >= length) | (data[s + at] > data[other + at])
        place = np.where(after, leaf + 1, leaf)
        wide = np.c_[np.full(rows, -1), lcp, np.full(rows, -1)]  # wide[:, i] stands before leaf i
        for _ in range(r):
            on = after & (wide[every, np.minimum(place, r)] > true)
            place = np.where(on, place + 1, place)
            off = ~after & (wide[every, place] > true)
            place = np.where(off, place - 1, place)
            if not (on.any() or off.any()):
                break
        idx = np.arange(r + 1)
        src = np.clip(idx - (idx > place[:, None]), 0, r - 1)
        order = np.where(idx == place[:, None], r, np.take_along_axis(order, src, 1))
        # boundaries: those below the place stay, the new leaf has `true` on the side it was compared with
        before = wide[every, place]
        left, right = np.where(after, true, before), np.where(after, before, true)
        new = np.empty((rows, r + 2), np.int64)
        j = np.arange(r + 2)
        new[:] = np.take_along_axis(wide, np.clip(j - (j > place[:, None]), 0, r), 1)
        new[every, place] = left
        new[every, place + 1] = right
        lcp = new[:, 1:-1]
    return order, lcp


def _sort_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.complete_groups(batches, ["kh", "sub"], AT_ONCE):
            at = C.heads(t, ["kh", "sub"])
            bucket = np.repeat(np.arange(len(at) - 1), np.diff(at))
            data, offs = C.flat(t.column("bytes"))
            loc = t.column("loc").to_numpy()
            ids, th = t.column("_id").to_numpy(), t.column("_th").to_numpy()
            n, delta = (loc >> 8) & 255, loc & 255
            part = t.column("part").combine_chunks()
            if part.null_count < len(part):
                own = [np.arange(k) if p is None else np.frombuffer(p, np.uint8).astype(np.int64) for k, p in zip(n, part.to_pylist(), strict=True)]
                rel, count = np.concatenate(own), np.array([len(x) for x in own])
            else:
                rel, count = _ranges(np.zeros(len(n), np.int64), n), n
            row = np.repeat(np.arange(len(n)), count)
            group = bucket[row] * 256 + delta[row] - rel
            cls = deep_shallow_classes(data, offs[row] + rel, group, length)
            on = np.flatnonzero(cls >= 0)
            if not len(on):
                continue
            r = row[on]
            p = (loc[r] >> 16) + rel[on]
            by = np.lexsort((p, th[r], ids[r], cls[on]))
            c = cls[on][by]
            again = by[np.r_[False, c[1:] == c[:-1]]]
            m = _merged(ids[r][again], th[r][again], p[again], p[again] + length)
            if len(m[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in m], names=["_id", "_th", "lo", "hi"])

    return rows


# --------------------------------------------------------------------------- result
def _result_rows(schema: pa.Schema, kept: str | None, text: str, found: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = C.flat(b.column(text))
            lists = b.column(found).to_pylist()
            n_removed, n_spans, sha, texts, spans = [], [], [], [], []
            for i, pairs in enumerate(lists):
                x = data[offs[i] : offs[i + 1]]
                run = _union(pairs)
                keep, at = [], 0
                for lo, hi in run:
                    keep.append(x[at:lo].tobytes())
                    at = hi
                keep = b"".join([*keep, x[at:].tobytes()])
                n_removed.append(len(x) - len(keep))
                n_spans.append(len(run))
                sha.append(hashlib.sha256(keep).hexdigest())
                spans.append([{"start": lo, "end": hi} for lo, hi in run])
                if kept:
                    texts.append(keep)
            made = {"n_bytes": pa.array(np.diff(offs)), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "removed": pa.array(spans, schema.field("removed").type)}
            if kept:
                made["kept"] = pa.array(texts, pa.binary()) if kept == "bytes" else pa.array([t.decode("utf-8", "ignore") for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b.column(f.name).cast(f.type) for f in schema], schema=schema)

    return rows


def _union(pairs: list | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((p["lo"], p["hi"]) for p in pairs or []):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 100, bucket: int = BUCKET) -> DataFrame:
    """(_id, _th, lo, hi): byte spans to remove, not yet merged across buckets. Materialised."""
    if not K_GRAM < length <= 255:
        raise ValueError(f"length must lie between {K_GRAM + 1} and 255")
    key = C.row_key(doc_id, text)
    low = F.coalesce(key[0], F.lit(-(2**63))).alias("_id")
    src = docs.select(low, key[1], C.text_col(text).alias("_text"))
    rows = src.where(F.octet_length("_text") >= length).mapInArrow(C.released(_anchor_rows(length)), _ANCHOR)
    order = Window.partitionBy("kh", "sh").orderBy("_id", "_th", "loc")
    whole = Window.partitionBy("kh")
    marked = (
        rows.repartition("kh")
        .withColumn("before", F.lag(F.struct("_id", "_th", "loc")).over(order))
        .withColumn("first", F.col("before").isNull())
        .withColumn("m", F.sum(F.when(F.col("first") & ~F.col("mark"), 1).otherwise(0)).over(whole))
        .where(F.col("mark") | ~F.col("first") | (F.col("m") > 1))
        .where(~F.coalesce(F.col("before") == F.struct("_id", "_th", "loc"), F.lit(False)))
    )
    lo = F.when(F.col("mark"), F.col("loc")).otherwise(F.shiftright("loc", 16))
    hi = F.when(F.col("mark"), F.col("sh")).otherwise(lo + F.shiftright("loc", 8).bitwiseAND(255) + (length - 1))
    done = F.col("mark") | ~F.col("first")
    seen = C.stash(marked.select("_id", "_th", "kh", "loc", F.col("m").cast("int").alias("m"), done.alias("done"), lo.alias("lo"), hi.alias("hi")))
    reps = seen.where(~F.col("done")).groupBy("_id", "_th").agg(F.collect_list(F.struct("kh", "loc", "m")).alias("reps"))
    cut = (
        src.join(reps, ["_id", "_th"])
        .select("_id", "_th", "_text", "reps")
        .mapInArrow(C.released(_cut_rows(length, bucket)), "kh long, sub long, _id long, _th long, loc long, bytes binary, part binary")
    )
    deep = cut.repartition("kh", "sub").sortWithinPartitions("kh", "sub").mapInArrow(C.released(_sort_rows(length)), "_id long, _th long, lo long, hi long")
    out = C.stash(seen.where("done").select("_id", "_th", "lo", "hi").unionByName(deep))
    C.unstash(seen)
    return out


def suffix_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 100, kept: str | None = "bytes", bucket: int = BUCKET) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256, removed (byte spans) and kept.

    kept: "bytes" for the bytes left, "text" for the whole characters among them, None for no such column.

    See the module's text for the method and for nulls, repeated rows and clashing names.
    """
    spans = repeated_spans(docs, doc_id=doc_id, text=text, length=length, bucket=bucket)
    per_doc = spans.groupBy("_id", "_th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans_"))
    new = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>" + {None: "", "bytes": ", kept binary", "text": ", kept string"}[kept]
    key = C.row_key(doc_id, text)
    made = [x.split()[0] for x in new.split(", ")]
    keyed, (i, h, whole) = C.with_helpers(docs, made, _id=F.coalesce(key[0], F.lit(-(2**63))), _th=key[1], _text=C.text_col(text))
    i_, h_, found = C.apart([*keyed.columns, *made], "_id_of", "_th_of", "spans_")
    per_doc = per_doc.select(F.col("_id").alias(i_), F.col("_th").alias(h_), F.col("spans_").alias(found))
    joined = keyed.join(per_doc, (F.col(i) == F.col(i_)) & (F.col(h) == F.col(h_)), "left")
    base = keyed.drop(i, h, whole)
    schema, arrow = C.widened(base, new)
    return joined.select(*[F.col(f"`{c}`") for c in base.columns], whole, found).mapInArrow(C.released(_result_rows(arrow, kept, whole, found)), schema)
