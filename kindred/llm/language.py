"""Language identification by a small byte convolutional network, trained in numpy.

Bytes (A-Z lower-cased) are embedded, filters of several widths slide over fixed-length windows, each filter keeps its
maximum over the window, and a softmax layer names the language. Training reads a bounded sample of the labelled rows:
``crop`` characters from anywhere in the texts of at most ``per_language`` rows of each language, whatever the number of
languages. Prediction cuts every whole text into windows, runs them in batches and averages their probabilities by
length, so a very long text is read whole and a window at a time.

Null text and text without a letter give ``und`` with score 0. Rows with null language are not learnt from. Without
labelled rows everything is ``und``; empty tables give empty results. Of languages that tie, the alphabetically first is named.
Repeated rows get equal results; input columns that have the name of an output are replaced and all others returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
_E, _F = 8, 12


@dataclass
class ByteConvNet:
    """Weights: byte embedding, one matrix for all filter widths (short filters are zero-padded), output layer."""

    languages: list[str]
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @property
    def mask(self) -> np.ndarray:
        """Which weights a filter of its width may use."""
        width = np.repeat(WIDTHS, _F)
        return (np.arange(max(WIDTHS))[:, None] < width).repeat(_E, axis=0).astype(np.float32)

    def patches(self, x: np.ndarray) -> np.ndarray:
        """(windows * length, widest * embedding) from byte windows, padded with zero bytes on the right."""
        w = max(WIDTHS)
        e = self.embed[np.pad(x, ((0, 0), (0, w - 1)))]
        s = e.strides
        view = np.lib.stride_tricks.as_strided(e, (len(x), x.shape[1], w * _E), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view).reshape(-1, w * _E)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (self.patches(x) @ self.conv).reshape(len(x), x.shape[1], -1).max(1) + self.bias
        s = np.maximum(z, 0) @ self.out + self.out_bias
        p = np.exp(s - s.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def train(texts: list[bytes], labels: list[str], *, steps: int = 500, batch: int = 64, seed: int = 7) -> ByteConvNet:
    """Adam on cross-entropy over random crops, drawn evenly over the languages."""
    r = np.random.default_rng(seed)
    names = sorted(set(labels))
    width = max(WIDTHS) * _E
    n = len(WIDTHS) * _F
    net = ByteConvNet(names, r.normal(0, 0.5, (256, _E)).astype(np.float32), r.normal(0, width**-0.5, (width, n)).astype(np.float32), np.zeros(n, np.float32), r.normal(0, 0.1, (n, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    if len(names) < 2:
        return net
    mask = net.mask
    net.conv *= mask
    net.embed[0] = 0
    by = [[C.LOWER[np.frombuffer(t, np.uint8)] for t, y in zip(texts, labels, strict=True) if y == name and t] or [np.zeros(1, np.uint8)] for name in names]
    params = [net.embed, net.conv, net.bias, net.out, net.out_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = r.integers(len(names), size=batch)
        x = np.zeros((batch, WINDOW), np.uint8)
        for i, c in enumerate(y):
            t = by[c][r.integers(len(by[c]))]
            size = min(len(t), WINDOW, int(r.choice([12, 24, 48, 96, 160, 256, 256])))
            at = r.integers(len(t) - size + 1)
            x[i, :size] = t[at : at + size]
        p = net.patches(x)
        z = (p @ net.conv).reshape(batch, WINDOW, n)
        top = z.argmax(1)
        pooled = np.take_along_axis(z, top[:, None], 1)[:, 0] + net.bias
        hidden = np.maximum(pooled, 0)
        s = hidden @ net.out + net.out_bias
        q = np.exp(s - s.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(batch), y] -= 1
        q /= batch
        g_out, g_ob = hidden.T @ q, q.sum(0)
        g_hidden = (q @ net.out.T) * (pooled > 0)
        rows = (np.arange(batch)[:, None] * WINDOW + top).ravel()
        picked = p[rows].reshape(batch, n, width)
        g_conv = np.einsum("bnw,bn->wn", picked, g_hidden) * mask
        g_patch = (g_hidden[:, :, None] * net.conv.T[None]).reshape(-1, max(WIDTHS), _E)
        padded = np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))
        at = padded[np.arange(batch)[:, None, None], top[:, :, None] + np.arange(max(WIDTHS))].reshape(-1, max(WIDTHS))
        g_embed = np.zeros_like(net.embed)
        np.add.at(g_embed, at.ravel(), g_patch.reshape(-1, _E))
        g_embed[0] = 0
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in enumerate((g_embed, g_conv, g_hidden.sum(0), g_out, g_ob)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def sample(docs: DataFrame, *, doc_id: str, text: str, lang: str, learn: Column, per_language: int, crop: int) -> tuple[list[bytes], list[str]]:
    """At most ``per_language`` rows of each language, ``crop`` characters of each.

    One hash of a row decides whether it is drawn and another where its crop begins, so crops come from everywhere in
    the texts however small the share of rows that is drawn.
    """
    rows = docs.where(learn & F.col(f"`{lang}`").isNotNull() & C.text_col(text).rlike(r"\p{L}")).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{doc_id}`").cast("string").alias("id"), C.text_col(text).alias("t"))
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return [], []
    unit = lambda *of: F.pmod(F.xxhash64(*of), F.lit(1_000_003)) / F.lit(1_000_003.0)
    shares = F.create_map(*[F.lit(x) for c in counts for x in (c.lang, min(1.0, (1.5 * per_language + 10) / c["count"]))])
    at = F.lit(1) + (unit("t", F.lit("crop"), "id") * F.greatest(F.length("t") - crop, F.lit(0))).cast("int")
    drawn = rows.withColumn("draw", unit("id", "t")).where(F.col("draw") < shares[F.col("lang")])
    got = drawn.select(F.substring(F.col("t"), at, F.lit(crop)).alias("t"), "lang", "draw").orderBy("draw", "lang", "t").limit((2 * per_language + 20) * len(counts)).collect()
    texts, labels, used = [], [], dict.fromkeys((c.lang for c in counts), 0)
    for g in got:
        if used[g.lang] < per_language:
            used[g.lang] += 1
            texts.append(g.t.encode())
            labels.append(g.lang)
    return texts, labels


def _predict(model, schema: pa.Schema, outs: tuple[str, str], text: str, has_letter: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: ByteConvNet = model.value
        for b in batches:
            data, offs = C.flat(b.column(text))
            p = np.zeros((b.num_rows, max(1, len(net.languages))))
            for i, j, d, o in C.chunks(data, offs, 1 << 18):
                p[i:j] = window_means(net, d, o)
            letter = b.column(has_letter).to_numpy(zero_copy_only=False)
            best = p.argmax(1)
            known = letter & bool(net.languages)
            lang = [net.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            made = {outs[0]: pa.array(lang, pa.string()), outs[1]: pa.array(np.where(known, p[np.arange(len(p)), best], 0.0))}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b.column(f.name).cast(f.type) for f in schema], schema=schema)

    return rows


def window_means(net: ByteConvNet, d: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Mean probabilities of each row's windows, weighted by the bytes in them."""
    size = np.diff(o)
    count = np.maximum(1, -(-size // WINDOW))
    row = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = o[row] + k * WINDOW
    fill = np.minimum(o[row + 1] - start, WINDOW)
    padded = np.r_[C.LOWER[d], np.zeros(WINDOW, np.uint8)]
    sums = np.zeros((len(size), max(1, len(net.languages))))
    if not net.languages:
        return sums
    total = np.zeros(len(size))
    for at in range(0, len(row), 256):
        part = slice(at, at + 256)
        x = padded[start[part, None] + np.arange(WINDOW)]
        x[np.arange(WINDOW) >= fill[part, None]] = 0
        weight = np.maximum(fill[part], 1)
        np.add.at(sums, row[part], net.probabilities(x) * weight[:, None])
        np.add.at(total, row[part], weight)
    return sums / total[:, None]


def identify_language(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", learn: Column | None = None, per_language: int = 400, crop: int = 600, outs: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the predicted language and its probability; learns from rows where ``learn`` holds."""
    texts, labels = sample(docs, doc_id=doc_id, text=text, lang=lang, learn=F.lit(True) if learn is None else learn, per_language=per_language, crop=crop)
    model = docs.sparkSession.sparkContext.broadcast(train(texts, labels))
    src, (tmp, letter) = C.with_helpers(docs, outs, _text=C.text_col(text), _letter=C.text_col(text).rlike(r"\p{L}"))
    schema, arrow = C.widened(src.drop(tmp, letter), f"`{outs[0]}` string, `{outs[1]}` double")
    return src.mapInArrow(C.released(_predict(model, arrow, outs, tmp, letter)), schema)
