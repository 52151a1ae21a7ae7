"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has a language model of its words, A-Z lower-cased, without outer punctuation: a byte given
the bytes of the word before it, up to CONTEXT of them, and the word's end given its last bytes. A whole word is thus as
likely as the product of its bytes, and what words have in common is learnt from their beginnings. Where a script has no spaces
between words, a run of GRAM characters begins at every character. With n_c the class's counts, D their discount, t the
number of different bytes after a context u:

    p_c(x | u) = (max(n_c(ux) - D_c, 0) + (STRENGTH + D_c t_c(u)) p(x | u)) / (n_c(u) + STRENGTH)

The backoff p(x | u) is shared: it is made of the counts of both classes, discounted, and backs off in turn to
Kneser-Ney's continuation count, the number of different contexts in which x has followed the last byte of u. A rare
expression that one class happened to show once has nearly the shared probability in either class, and a context that only one class
has shown has just that, so neither is evidence.

A toxic text is mostly ordinary language: its words are ordinary ones but for a share RATE that the toxic model draws.
The evidence of a document is the length-normalised difference of the two log-likelihoods, that is the mean over its words of
log(1 - RATE + RATE p_toxic(w) / p_ordinary(w)). A two-parameter logistic curve of its logarithm, fitted to a part of
the labelled rows that the counts leave out, turns it into a probability.

Counts cover all labelled training rows whole and are summed by Spark; discounts and continuation counts are exact. The
ratios grow with the vocabulary of the labelled rows. They reach the workers in blocks of at most ``block`` entries of 12 bytes; one
pass over the documents is made per block, and between passes the words' partial sums are written to the shared folder, so
neither the driver nor a worker holds more than one block.

Null or empty text, and text without words, have the evidence 0. A very long text is read whole, by one task. Rows
without a label are scored but not learnt from; a document with several labels counts with the largest. Without labels of both
classes all score 0. Repeated rows, and texts with the same words, get equal scores; empty tables give empty results; input columns that have the name of an output are
replaced and all others returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

_U = np.uint64
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]{}*#$%&|<>-_/\\~`^+="]] = True
_END = 32  #: the byte that stands for a word's end and, before its first byte, for its beginning; words hold no space
CONTEXT, STRENGTH, RATE, LAPSE = 12, 1.0, 0.001, 0.02
#: Characters in a run where a script has no spaces.
GRAM = 3
_BINS, _LOW, _HIGH = 1000, math.log(RATE), 4.0  #: of the evidence's logarithm


def _spaceless(low: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which characters, given by their first bytes, are Thai, Lao, Burmese, Khmer, kana or Han."""
    a = low[first].astype(np.int32)
    b = low[np.minimum(first + 1, len(low) - 1)].astype(np.int32)
    south = ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xE1) & ((b == 0x80) | (b == 0x81) | (b == 0x82) | (b == 0x9E) | (b == 0x9F)))
    kana = (a == 0xE3) & (b >= 0x81)  # 0xE3 0x80 is punctuation
    han = ((a >= 0xE4) & (a <= 0xE9)) | ((a == 0xEF) & ((b == 0xA4) | (b == 0xA5) | (b == 0xA6) | (b == 0xA7) | (b == 0xA8) | (b == 0xA9) | (b == 0xAB)))
    return south | kana | han | ((a == 0xF0) & (b >= 0xA0) & (b <= 0xB3))


def words(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word, up to six punctuation bytes at each end left off."""
    start, end, row = C.words(low, offs)
    for _ in range(6 if len(start) else 0):
        start = start + (_EDGE[low[np.minimum(start, len(low) - 1)]] & (start < end))
        end = end - (_EDGE[low[end - 1]] & (start < end))
    some = start < end
    start, end, row = start[some], end[some], row[some]
    if len(start) and (low >= 0xE0).any():
        lead = (low & 0xC0) != 0x80
        lead[start] = True
        start, end, row = _split(low, np.flatnonzero(lead), start, end, row)
    return start, end, row


def _split(low, first, start, end, row) -> tuple[np.ndarray, ...]:
    """Words cut where a script has no spaces."""
    own = np.searchsorted(start, first, side="right") - 1
    first = first[(own >= 0) & (first < end[own])]
    own = np.searchsorted(start, first, side="right") - 1
    bare = _spaceless(low, first)
    new = bare.copy()
    new[1:] |= bare[:-1]
    new |= first == start[own]
    head = np.flatnonzero(new)
    word, gram = own[head], bare[head]
    upto = np.minimum(np.r_[first[head[1:]], len(low)], end[word])
    after = np.r_[first, np.full(GRAM, len(low))][head + GRAM]
    upto = np.where(gram, np.minimum(after, end[word]), upto)
    return first[head], upto, row[word]


def distinct(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one occurrence of each different word, which of these every word is)."""
    h = C.word_hashes(low, start, end)
    by = np.argsort(h, kind="stable")
    new = np.r_[True, h[by][1:] != h[by][:-1]][: len(by)]
    which = np.empty(len(h), np.int64)
    which[by] = np.cumsum(new) - 1
    return by[new], which


def events(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, last byte of the context and byte after it) of every byte of the words and of their ends."""
    size = end - start + 1
    word = np.repeat(np.arange(len(size)), size)
    j = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    at = start[word] + j
    after = np.where(at == end[word], _END, low[np.minimum(at, len(low) - 1)]).astype(np.int32)
    before = np.where(j == 0, _END, low[at - 1]).astype(np.int32)
    context = C.between(C.running(C.BYTE[low]), at - np.minimum(j, CONTEXT), at)
    context ^= np.minimum(j, CONTEXT + 1).astype(_U) * C.ODD[59]
    return word, C.mix(context), before << 8 | after


def keys(context: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return context ^ ((pair & 255).astype(_U) << _U(56))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, context and pair: counts in ordinary and toxic rows."""
    held, size = [], 0
    for b in batches:
        data, offs = C.flat(b.column("_text"))
        toxic = b.column("_toxic").to_numpy()
        for i, _, d, o in C.chunks(data, offs, 2 * C.CHUNK):
            low = C.LOWER[d]
            start, end, row = words(low, o)
            if not len(start):
                continue
            first, which = distinct(low, start, end)
            n = np.bincount(which)
            n1 = np.bincount(which, toxic[i + row]).astype(np.int64)
            word, context, pair = events(low, start[first], end[first])
            held.append(_merged(context, pair, (n - n1)[word], n1[word]))
            size += len(held[-1][0])
        if size > 1_500_000:
            held = [_merged(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            size = len(held[0][0])
            if size > 1_000_000:
                yield _batch(held[0])
                held, size = [], 0
    if held:
        yield _batch(_merged(*(np.concatenate(x) for x in zip(*held, strict=True))))


def _merged(context, pair, n0, n1) -> tuple[np.ndarray, ...]:
    h = keys(context, pair)
    by = np.argsort(h)
    at = np.flatnonzero(np.r_[True, h[by][1:] != h[by][:-1]])
    return context[by[at]], pair[by[at]], np.add.reduceat(n0[by], at), np.add.reduceat(n1[by], at)


def _batch(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2]), pa.array(x[3])], names=["context", "pair", "n0", "n1"])


def count_events(train: DataFrame) -> DataFrame:
    """Per context and pair: n0, n1, and over the context their totals all0, all1 and the numbers of different bytes kinds0, kinds1, kinds.

    Rows are dealt by context once, which serves the sums and the window; a context has at most 257 bytes after it.
    """
    counts = train.mapInArrow(_counts, "context long, pair int, n0 long, n1 long").repartition("context")
    own = Window.partitionBy("context")
    seen = lambda c: F.sum((F.col(c) > 0).cast("long")).over(own)
    sums = counts.groupBy("context", "pair").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return sums.select("*", F.sum("n0").over(own).alias("all0"), F.sum("n1").over(own).alias("all1"), seen("n0").alias("kinds0"), seen("n1").alias("kinds1"), F.count("*").over(own).alias("kinds"))


def discounts(counts: DataFrame) -> list[float]:
    """Kneser-Ney's discount of the ordinary, the toxic and all counts, from the events seen once and twice."""
    n = {"0": F.col("n0"), "1": F.col("n1"), "": F.col("n0") + F.col("n1")}
    r = counts.agg(*[F.sum((c == k).cast("long")).alias(f"s{key}_{k}") for key, c in n.items() for k in (1, 2)]).first()
    return [(r[f"s{k}_1"] / (r[f"s{k}_1"] + 2 * r[f"s{k}_2"])) if r[f"s{k}_1"] else 0.5 for k in n]


def continuations(counts: DataFrame) -> DataFrame:
    """Per pair (65,536 at most), the share of its first byte's different (context, next byte) that go on with its second."""
    pairs = counts.groupBy("pair").agg(F.count("*").alias("cont"))
    return pairs.select("pair", (F.col("cont") / F.sum("cont").over(Window.partitionBy(F.shiftright("pair", 8)))).alias("free"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(key, ratio) of the events whose context both classes have seen: log p_toxic - log p_ordinary."""
    d0, d1, d = discounts(counts)
    n = F.col("n0") + F.col("n1")
    shared = (n - d + d * F.col("kinds") * F.col("free")) / (F.col("all0") + F.col("all1"))
    p = lambda c, off: (F.greatest(F.col(f"n{c}") - off, F.lit(0.0)) + (STRENGTH + off * F.col(f"kinds{c}")) * shared) / (F.col(f"all{c}") + STRENGTH)
    key = F.col("context").bitwiseXOR(F.shiftleft(F.col("pair").bitwiseAND(F.lit(255)).cast("long"), 56))
    both = counts.where((F.col("all0") > 0) & (F.col("all1") > 0))
    return both.join(F.broadcast(continuations(counts)), "pair").select(key.alias("key"), F.log(p("1", d1) / p("0", d0)).cast("float").alias("ratio"))


def word_ratios(low, start, end, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The sum of each word's ratios that ``model`` (keys ascending, ratios) has."""
    keys_, ratios = model
    if not len(keys_) or not len(start):
        return np.zeros(len(start), np.float32)
    first, which = distinct(low, start, end)
    word, context, pair = events(low, start[first], end[first])
    k = keys(context, pair).view(np.int64)
    by = np.argsort(k)
    at = np.minimum(np.searchsorted(keys_, k[by]), len(keys_) - 1)
    hit = keys_[at] == k[by]
    return np.bincount(word[by[hit]], ratios[at[hit]], len(first)).astype(np.float32)[which]


def evidence_of(ratio: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The mean over each row's words of log(1 - RATE + RATE exp(ratio))."""
    return np.bincount(row, np.log1p(RATE * np.expm1(np.minimum(ratio.astype(np.float64), 60.0))), rows) / np.maximum(np.bincount(row, minlength=rows), 1)


def _pass(block, schema: pa.Schema, text: str, part: str, out: str):
    """Adds a block's ratios to the words' partial sums; the last pass (its schema has ``out``) gives the evidence."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = C.flat(b.column(text))
            sums, ahead = C.flat(b.column(part)) if part in b.schema.names else (None, None)
            made = []
            for i, j, d, o in C.chunks(data, offs, 2 * C.CHUNK):
                low = C.LOWER[d]
                start, end, row = words(low, o)
                ratio = word_ratios(low, start, end, block.value)
                if sums is not None:
                    ratio = ratio + np.frombuffer(sums[ahead[i] : ahead[j]].tobytes(), np.float32)
                if out in schema.names:
                    made.append(evidence_of(ratio, row, j - i))
                else:
                    cut = np.searchsorted(row, np.arange(j - i + 1))
                    made += [ratio[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)]
            new = pa.array(np.concatenate(made) if made else np.zeros(0)) if out in schema.names else pa.array(made, pa.binary())
            yield pa.RecordBatch.from_arrays([new if f.name in (out, part) else b.column(f.name).cast(f.type) for f in schema], schema=schema)

    return rows


def add_evidence(src: DataFrame, ratios: DataFrame, blocks: int, text: str, out: str) -> DataFrame:
    """``src`` with the evidence of its texts in place of them; one pass per block of the ratios."""
    part = C.apart([*src.columns, out], "_sums")[0]
    kept = src.drop(text)
    for k in range(blocks):
        t = ratios.where(F.pmod("key", F.lit(blocks)) == k).toArrow()
        key, ratio = t.column("key").to_numpy(), t.column("ratio").to_numpy()
        by = np.argsort(key)
        block = src.sparkSession.sparkContext.broadcast((key[by], ratio[by]))
        last = k == blocks - 1
        schema, arrow = C.widened(kept if last else src.select(*kept.columns, text), f"`{out}` double" if last else f"`{part}` binary")
        src = src.mapInArrow(_pass(block, arrow, text, part, out), schema)
        if not last:
            src = C.stash(src)
            block.unpersist()
    return src


def fit_curve(x: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve with a weak prior on the slope, where LAPSE of the labels are wrong.

    Each round takes the expected true labels and makes a damped Newton step towards them.
    """
    a, b = 1.0, 0.0
    n = zeros + ones
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        true = ones * p * (1 - LAPSE) / (p * (1 - LAPSE) + (1 - p) * LAPSE) + zeros * p * LAPSE / (p * LAPSE + (1 - p) * (1 - LAPSE))
        w = n * p * (1 - p) + 1e-9
        ga, gb = ((p * n - true) * x).sum() + 1e-2 * a, (p * n - true).sum() + 1e-4 * b
        haa, hab, hbb = (w * x * x).sum() + 1e-2, (w * x).sum(), w.sum() + 1e-4
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2 / (abs(da) + abs(db) + 1e-12))
        a, b = a - step * da, b - step * db
        if abs(da) < 1e-7 and abs(db) < 1e-7:
            break
    return float(a), float(b)


def _log_evidence(evidence: str) -> Column:
    return F.log(F.greatest(F.col(f"`{evidence}`"), F.lit(0.0)) + RATE)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", count_folds: tuple[int, ...] = (1, 2, 3), curve_folds: tuple[int, ...] = (4,), block: int = 8_000_000, outs: tuple[str, str, str] = ("score", "predicted", "evidence")
) -> DataFrame:
    """``docs`` with a toxicity score, its decision at 0.5 and the evidence. Folds are crc32(id) mod 5."""
    marked = labels.groupBy(F.col(f"`{doc_id}`").cast("long").alias("_id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("_toxic")).where("_toxic IN (0, 1)")
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), C.fold5(doc_id).alias("_fold"), C.text_col(text).alias("_text"))
    train = lambda folds: src.where(F.col("_fold").isin(*folds)).join(marked.hint("merge"), "_id").select("_text", "_toxic")
    counts = C.stash(count_events(train(count_folds)))
    ratios = C.stash(log_ratios(counts))
    C.unstash(counts)
    size = ratios.count()
    blocks = max(1, -(-size // block))
    curve = None
    for folds in (curve_folds, (*count_folds, *curve_folds)) if size else ():
        cell = ((_log_evidence("x") - _LOW) * (_BINS / (_HIGH - _LOW))).cast("int")
        seen = add_evidence(train(folds), ratios, blocks, "_text", "x").groupBy(cell.alias("cell"), "_toxic").count().collect()
        zeros, ones = np.zeros(_BINS), np.zeros(_BINS)
        for s in seen:
            (ones if s["_toxic"] else zeros)[min(s["cell"], _BINS - 1)] += s["count"]
        if zeros.sum() and ones.sum():
            curve = fit_curve((np.arange(_BINS) + 0.5) * ((_HIGH - _LOW) / _BINS) + _LOW, zeros, ones)
            break
    base, (tmp,) = C.with_helpers(docs, outs, _text=C.text_col(text))
    found = add_evidence(base, ratios, blocks, tmp, outs[2])
    if curve is None:
        score = F.lit(0.0)
    else:
        score = 1 / (1 + F.exp(-(curve[0] * _log_evidence(outs[2]) + curve[1])))
    return found.withColumns({outs[0]: score, outs[1]: (score >= 0.5).cast("int")})
