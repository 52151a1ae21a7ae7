"""Quality rules with risk-controlled thresholds.

Fixed base rules (very few words, too much repetition) come first. The learned rules are cutoffs on statistics of the
text, per stratum (a class of document length): a document fails if any of its statistics reaches its cutoff.

The labelled rows are split by a hash of their id. One third chooses: it gives each stratum a ladder of rules, each of which
rejects what the one before it does and more; on rung t the cutoff of a statistic is the lowest that at most LADDER[t]
of the good documents reach, and a larger share of the bad ones. The other two thirds are a holdout that certifies: rung after
rung, the exact (Clopper-Pearson) upper confidence bound of the rate of good documents that the whole rung rejects must
stay under ``risk``. Testing stops at the first rung that fails, and the last that passed is used. As the order of the tests was
fixed before the holdout was seen, each is made at the full level of its stratum, which is ``delta`` divided by the number
of strata (Bonferroni). A stratum whose holdout is too small certifies nothing and rejects nothing.

Labels come to the driver only as counts per stratum, statistic and bin, or per stratum and rung (at most 5 x 4 x 101 x 2
numbers). Null text has no words, so it fails the base rules; a very long text is read whole, by one task. Rows without a
label are judged but not learnt from; a document with several labels counts with the largest; without labels, or in an
empty table, the base rules alone decide. Statistics that tie with a cutoff fail. Repeated rows get equal results; input
columns that have the name of an output are replaced and all others returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
BINS = 100
STATISTICS = ("symbols", "duplicate_lines", "repeated_words", "short_words")
_EDGES = np.array([50, 200, 800, 3200])
#: Share of a stratum's good documents that a statistic's cutoff may reject among the choosing rows, by rung.
LADDER = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01)


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row."""
    rows = len(offs) - 1
    start, end, row = C.words(data, offs)
    lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points start where no continuation byte is
    chars = np.bincount(row, lead[end] - lead[start], rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
    sym = np.r_[0, np.cumsum(_SYMBOL[data])]
    out = {"n_words": np.bincount(row, minlength=rows).astype(np.int64), "word_chars": chars, "n_symbols": (sym[offs[1:]] - sym[offs[:-1]]).astype(np.int64)}
    out["n_dup_lines"] = _duplicate_lines(data, offs, start)
    out["n_repeat_words"] = _repeated_words(data, start, end, row, rows)
    return out


def _duplicate_lines(data, offs, word_start) -> np.ndarray:
    rows = len(offs) - 1
    if not len(data):
        return np.zeros(rows, np.int64)
    cut = np.flatnonzero(data == 10)
    begin = np.unique(np.r_[offs[:-1], cut + 1])
    begin = begin[begin < len(data)]
    row = np.searchsorted(offs, begin, side="right") - 1
    stop = np.minimum(np.r_[begin[1:], len(data)], offs[row + 1])
    ends_in_break = (stop > begin) & (data[stop - 1] == 10)
    stop = stop - ends_in_break
    worded = np.searchsorted(word_start, stop) > np.searchsorted(word_start, begin)
    begin, stop, row = begin[worded], stop[worded], row[worded]
    h = C.word_hashes(data, begin, stop)
    by = np.lexsort((h, row))
    again = (h[by][1:] == h[by][:-1]) & (row[by][1:] == row[by][:-1])
    return np.bincount(row[by][1:][again], minlength=rows).astype(np.int64)


def _repeated_words(data, start, end, row, rows, k: int = 5) -> np.ndarray:
    n = len(start) - k + 1
    if n < 1:
        return np.zeros(rows, np.int64)
    w = C.word_hashes(data, start, end)
    h = w[:n] * C.ODD[0]
    for j in range(1, k):
        h += w[j : n + j] * C.ODD[j]
    C.mix(h)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    by = at[np.lexsort((h[at], row[at]))]
    same = (h[by][1:] == h[by][:-1]) & (row[by][1:] == row[by][:-1])
    twice = by[np.r_[same, False] | np.r_[False, same]] if len(by) else by
    cover = np.zeros(len(start) + 1, np.int32)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + k, -1)
    return np.bincount(row, np.cumsum(cover[:-1]) > 0, rows).astype(np.int64)


def statistics(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each in 0..BINS, higher is worse."""
    words = np.maximum(m["n_words"], 1)
    part = {
        "symbols": m["n_symbols"] / np.maximum(m["word_chars"], 1),
        "duplicate_lines": m["n_dup_lines"] / (m["n_dup_lines"] + 3),
        "repeated_words": m["n_repeat_words"] / words,
        "short_words": np.clip(1 - (m["word_chars"] / words) / 12, 0, 1),
    }
    return {k: np.minimum(np.floor(np.clip(part[k], 0, 1) * BINS), BINS).astype(np.int32) for k in STATISTICS}


def stratum(n_words: np.ndarray) -> np.ndarray:
    return np.searchsorted(_EDGES, n_words, side="right").astype(np.int32)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _base_failed(m) -> np.ndarray:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = C.flat(b.column("_text"))
        good = b.column("_good").to_numpy()
        held = []
        for i, j, d, o in C.chunks(data, offs):
            m = measure(d, o)
            on = ~_base_failed(m)
            s, level = stratum(m["n_words"])[on], statistics(m)
            held += [pd.DataFrame({"stratum": s, "stat": np.int32(k), "bin": level[x][on], "good": good[i:j][on]}) for k, x in enumerate(STATISTICS)]
        if held:
            t = pd.concat(held).groupby(["stratum", "stat", "bin", "good"]).size().reset_index(name="n")
            yield pa.RecordBatch.from_pandas(t.astype({"n": "int64"}), schema=pa.schema([("stratum", pa.int32()), ("stat", pa.int32()), ("bin", pa.int32()), ("good", pa.int32()), ("n", pa.int64())]), preserve_index=False)


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * f


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact upper confidence bound of a rate, k of n seen: the p at which P(X <= k) = I_(1-p)(n - k, k + 1) falls to ``level``."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if beta_tail(1 - mid, n - k, k + 1) > level:
            lo = mid
        else:
            hi = mid
    return hi


def ladder(counts: dict[tuple[int, int, int, int], int]) -> np.ndarray:
    """Cutoffs (reject from this bin on) by stratum, rung and statistic, from counts by (stratum, statistic, bin, good)."""
    table = np.full((len(_EDGES) + 1, len(LADDER), len(STATISTICS)), BINS + 1)
    for s in range(len(table)):
        for x in range(len(STATISTICS)):
            good, bad = (np.array([counts.get((s, x, b, g), 0) for b in range(BINS + 1)]) for g in (1, 0))
            lost, caught = (np.cumsum(v[::-1])[::-1] for v in (good, bad))
            tells = caught * good.sum() > lost * bad.sum()
            for t, share in enumerate(LADDER):
                able = np.flatnonzero(tells & (lost <= share * good.sum()) & (np.arange(BINS + 1) > 0))
                if len(able):
                    table[s, t, x] = able[0]
    return table


def rungs(m: dict[str, np.ndarray], table: np.ndarray) -> np.ndarray:
    """Per row the first rung that rejects it, len(LADDER) if none does."""
    level = statistics(m)
    hit = np.any(np.stack([level[x] for x in STATISTICS], 1)[:, None] >= table[stratum(m["n_words"])], 2)
    return np.where(hit.any(1), hit.argmax(1), len(LADDER)).astype(np.int32)


def certify(counts: dict[tuple[int, int, int], int], risk: float, delta: float) -> list[int]:
    """The last certified rung of each stratum, -1 for none, from holdout counts by (stratum, rung, good)."""
    out = []
    for s in range(len(_EDGES) + 1):
        good = [counts.get((s, t, 1), 0) for t in range(len(LADDER) + 1)]
        last = -1
        while last + 1 < len(LADDER) and upper_bound(sum(good[: last + 2]), sum(good), delta / (len(_EDGES) + 1)) <= risk:
            last += 1
        out.append(last)
    return out


def _rung_counts(table: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = C.flat(b.column("_text"))
            good = b.column("_good").to_numpy()
            held = []
            for i, j, d, o in C.chunks(data, offs):
                m = measure(d, o)
                on = ~_base_failed(m)
                held.append(pd.DataFrame({"stratum": stratum(m["n_words"])[on], "rung": rungs(m, table)[on], "good": good[i:j][on]}))
            if held:
                t = pd.concat(held).groupby(["stratum", "rung", "good"]).size().reset_index(name="n")
                yield pa.RecordBatch.from_pandas(t.astype({"n": "int64"}), schema=pa.schema([("stratum", pa.int32()), ("rung", pa.int32()), ("good", pa.int32()), ("n", pa.int64())]), preserve_index=False)

    return rows


def _judge(limits: np.ndarray, schema: pa.Schema, text: str):
    """``limits`` has a cutoff per stratum and statistic."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = C.flat(b.column(text))
            parts = []
            for _, _, d, o in C.chunks(data, offs):
                m = measure(d, o)
                fails = rungs(m, limits[:, None]) == 0
                m["base_failed"] = _base_failed(m)
                m["kept"] = ~m["base_failed"] & ~fails
                parts.append(m)
            made = {k: pa.array(np.concatenate([p[k] for p in parts])) for k in parts[0]} if parts else {}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b.column(f.name).cast(f.type) for f in schema], schema=schema)

    return rows


def learn_limits(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, risk: float, delta: float) -> np.ndarray:
    """Certified cutoffs by stratum and statistic, BINS + 1 where there is none."""
    marked = labels.groupBy(F.col(f"`{doc_id}`").cast("long").alias("_id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("_good")).where("_good IN (0, 1)")
    chooses = F.pmod(F.xxhash64("_id"), F.lit(3)) == 0
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), C.text_col(text).alias("_text"))
    part = lambda on: src.where(on).join(marked.where(on).hint("merge"), "_id").select("_text", "_good")
    seen = part(chooses).mapInArrow(_histogram, "stratum int, stat int, bin int, good int, n long").groupBy("stratum", "stat", "bin", "good").agg(F.sum("n").alias("n")).collect()
    table = ladder({(r["stratum"], r["stat"], r["bin"], r["good"]): r["n"] for r in seen})
    held = part(~chooses).mapInArrow(_rung_counts(table), "stratum int, rung int, good int, n long").groupBy("stratum", "rung", "good").agg(F.sum("n").alias("n")).collect()
    last = certify({(r["stratum"], r["rung"], r["good"]): r["n"] for r in held}, risk, delta)
    return np.stack([table[s, t] if t >= 0 else np.full(len(STATISTICS), BINS + 1) for s, t in enumerate(last)])


def quality_rules(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """``docs`` with the base counts, base_failed and kept. With probability 1 - delta at most ``risk`` of each
    stratum's good documents fail the learned rules."""
    limits = learn_limits(docs, labels, doc_id=doc_id, text=text, label=label, risk=risk, delta=delta)
    src, (tmp,) = C.with_helpers(docs, [*_COUNTS, "base_failed", "kept"], _text=C.text_col(text))
    schema, arrow = C.widened(src.drop(tmp), ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean")
    return src.mapInArrow(_judge(limits, arrow, tmp), schema)
