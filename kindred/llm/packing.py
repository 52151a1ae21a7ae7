"""Packing token sequences by the sum-of-squares rule.

A document is its token ids plus an end id. Longer ones than a sequence are cut into full pieces, the first of which may
be shorter. Pieces then go into sequences of ``size`` tokens: a piece goes where the sum, over residual gaps, of the
squared number of open sequences with that gap becomes smallest; a new one is opened when none has room. Pieces are dealt into groups of about GROUP by hash and
each group is packed on its own, longest first, so the work is parallel and a group wastes at most a few sequences; the
state is one count and one list of open sequences per gap.

Null text is empty and packs as the end id alone. Rows with equal ids are packed as separate documents. An empty table
gives an empty result. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

GROUP = 100_000
_PIECE = "_id long, piece int, start long, length long, ids_crc32 long"


def byte_bpe(json_path: str, ranks_path: str, pattern: str) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """A loader of an encoder with the ids of the tokenizer file at ``json_path``.

    ``ranks_path`` holds the same vocabulary as merge ranks, which tiktoken applies several times faster; texts with a
    special token's string go through the tokenizer file itself.
    """

    def load() -> Callable[[list[str]], list[list[int]]]:
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(json_path)
        special = [t.content for t in exact.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(texts: list[str]) -> list[list[int]]:
            return [exact.encode(t, add_special_tokens=False).ids if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts]

        return encode

    return load


def _pieces(load, end: int, size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for b in batches:
            ids, texts = b.column("_id"), b.column("_text")
            out: list[tuple] = []
            for i in range(b.num_rows):
                tokens = np.array([*encode([texts[i].as_py()])[0], end], "<u4")
                first = len(tokens) % size or size
                cuts = [0, *range(first, len(tokens) + 1, size)] if len(tokens) > size else [0, len(tokens)]
                name = ids[i].as_py()
                out += [(name, k, s, e - s, zlib.crc32(tokens[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PIECE.split(", ")])

    return rows


class SumOfSquares:
    """Open sequences by residual gap; :meth:`place` returns (sequence, offset) for a piece."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        size, n = self.size, self.count
        gaps = n[length:size]  # of sequences that have room
        # moving one sequence from gap g to g - length changes the sum by -2 n[g] + 1 + 2 n[g - length] + 1
        rise = 2 * n[: size - length] - 2 * gaps + 2
        rise[:1] = 1 - 2 * gaps[:1]  # a full sequence is closed and counts no more
        rise = np.where(gaps > 0, rise, np.iinfo(np.int64).max)
        g = int(rise.argmin()) + length if len(rise) else size
        if len(rise) and not n[g]:
            g = size  # none has room
        if g == size:
            name, self.made = self.made, self.made + 1
        else:
            name = self.open[g].pop()
            n[g] -= 1
        left = g - length
        if left:
            self.open[left].append(name)
            n[left] += 1
        return name, size - g


def _pack(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for b in batches:
            seq, off = [], []
            for g, n in zip(b.column("_group").to_pylist(), b.column("length").to_pylist(), strict=True):
                if g != group:
                    group, state = g, SumOfSquares(size)
                k, at = state.place(n)
                seq.append((g << 40) | k)
                off.append(at)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", "piece", "start", "length", "ids_crc32")), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows


def pack(docs: DataFrame, *, tokenizer, end: int = 2, size: int = 1024, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document."""
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), C.text_col(text).alias("_text"))
    pieces = C.stash(src.mapInArrow(C.released(_pieces(tokenizer, end, size)), _PIECE))
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(groups)))
    packed = dealt.repartition(groups, "_group").sortWithinPartitions("_group", F.desc("length"), "_id", "piece", "ids_crc32").mapInArrow(C.released(_pack(size)), _PIECE + ", sequence_id long, offset long")
    return packed.withColumnRenamed("_id", doc_id)
