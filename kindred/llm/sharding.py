"""Shards of near equal bytes by a k-d tree over the documents' metadata.

A node of the tree is cut at the weighted median of the dimension in which it is widest, as a part of the whole table's
width, and each half is cut again until every leaf holds the target bytes; uneven numbers of leaves are cut in
proportion. Equal texts are one group: it stands at the smallest of its rows' values in each dimension and is never cut,
unless it holds more than 1 / UNIT of a shard: its rows then stand for themselves, so that no group, however large, keeps
shards from being even.

Medians are found exactly and without a sort: a row's place in a dimension and a hash for ties make a 64-bit key, and the
median is narrowed digit by digit, each digit by one pass that adds up bytes per digit. Texts are read once; every later
pass reads rows of a few numbers. The driver holds the tree and the digits' sums alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, stash, text_col, unstash, widened, without

#: A group of equal texts with more than this part of a shard's bytes is dealt row by row.
UNIT = 256
#: Most sums of digits that one pass returns, as a power of 2.
DIGITS = 18
#: Rows that are numbered together.
NUMBERED = 1 << 20

OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def kd_shards(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, dims: Sequence[str] = (), columns: Sequence[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns or those named, with size, text_crc32, law, shard, slot and grown_shard.

    A row's size is its text's UTF-8 bytes and 1. ``shards`` is the number of shards, or follows from ``target_bytes``. The
    tree's dimensions are ``dims`` (numbers by value, all else by a hash of its text; null, NaN and infinite values stand
    first) and the logarithm of the size. The law that holds is ``bytes``: at each cut the halves differ from their share
    by less than the largest unit, a row or a group of equal texts of at most 1 / UNIT of a shard, so shards are near equal
    unless single rows are larger. Slots number a shard's rows from 0 without gaps. ``grown_shard`` is null: this law has
    no rule for one more shard.

    Null text counts as empty and equals it. Null and repeated ids and repeated rows are rows like others. Texts may be of
    any length. Input columns that have an output's name are replaced, all others returned. An empty table gives no rows.
    """
    if (shards is None) == (target_bytes is None) or (shards if target_bytes is None else target_bytes) < 1:
        raise ValueError("give a positive number of shards or of target bytes")
    kinds = dict(docs.dtypes)
    own = [c for c in without(docs, OUT).columns if columns is None or c in columns]
    n, crc, h, *place = apart([*own, *OUT], "_n", "_crc", "_h", *[f"_v{i}" for i in range(len(dims) + 1)])
    size = F.octet_length(text_col(text)).cast("long") + 1

    def value(c: str):
        number = kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
        v = F.col(f"`{c}`").cast("double") if number else F.crc32(F.col(f"`{c}`").cast("string")).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    values = [*map(value, dims), F.log2(size.cast("double"))]
    held = stash(docs.select(*[F.col(f"`{c}`") for c in own], size.alias("size"), F.crc32(text_col(text)).alias("text_crc32"), F.monotonically_increasing_id().alias(n), F.xxhash64(text_col(text)).alias(h), *[v.alias(p) for v, p in zip(values, place, strict=True)]))
    total, *ends = held.agg(F.sum("size"), *[f(p) for p in place for f in (F.min, F.max)]).first()
    leaves = shards or max(1, -(-(total or 0) // target_bytes))

    def quantised(p: str, lo: float | None, hi: float | None):
        if lo is None or lo == hi:
            return F.lit(0)
        return F.coalesce(F.floor((F.col(p) - lo) / (hi - lo) * (2**32 - 1)), F.lit(0))

    whole = held.withColumns({p: quantised(p, *ends[2 * i : 2 * i + 2]).cast("long") for i, p in enumerate(place)})
    key = [h, "text_crc32", "size"]
    bytes_, *least = apart(whole.columns, "_b", *[f"_g{i}" for i in range(len(place))])
    groups = whole.groupBy(*key).agg(F.sum("size").alias(bytes_), *[F.min(p).alias(g) for p, g in zip(place, least, strict=True)])
    large = F.col(bytes_) * UNIT * leaves > (total or 0)
    low32 = lambda *c: F.xxhash64(*c).bitwiseAND(F.lit(2**32 - 1))
    stands = {p: F.when(large, F.col(p)).otherwise(F.col(g)) for p, g in zip(place, least, strict=True)}
    met = whole.join(groups, key).withColumns({**stands, h: F.when(large, low32(h, n)).otherwise(low32(h))}).drop(bytes_, *least)
    points = stash(met)
    unstash(held)

    tree = _grow(points.select("size", h, *place), leaves)
    schema, arrow = widened(points, "shard int")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, tie = _numbers(b, place), _numbers(b, [h])[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaf(q, tie).astype(np.int32))], schema=arrow)

    bucket, before, nth = apart(schema.names, "_bucket", "_before", "_nth")
    dealt = stash(points.mapInArrow(assign, schema))
    unstash(points)
    buckets = max(64, -(-dealt.count() // (leaves * NUMBERED)))
    dealt = dealt.withColumn(bucket, F.pmod(F.xxhash64(n), F.lit(buckets)))
    count = dealt.groupBy("shard", bucket).agg(F.count("*").alias(nth))
    first = count.select("shard", bucket, F.coalesce(F.sum(nth).over(Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    numbered = dealt.withColumn(nth, F.row_number().over(Window.partitionBy("shard", bucket).orderBy(*[F.col(f"`{c}`") for c in own if c == doc_id], n)))
    out = numbered.join(first, ["shard", bucket])
    made = {"law": F.lit("bytes"), "slot": F.col(before) + F.col(nth) - 1, "grown_shard": F.lit(None).cast("int")}
    return out.select(*[F.col(f"`{c}`") for c in own], *[made[c].alias(c) if c in made else F.col(c) for c in OUT])


def write_shards(sharded: DataFrame, path: str) -> None:
    """Parquet in one folder a shard, rows in the order of their slots across its files."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


# --------------------------------------------------------------------------- the tree
def _numbers(b: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in names]) if b.num_rows else np.zeros((len(names), 0), np.int64)


class Tree:
    """Cuts by node: a row goes right where its key in the node's dimension is above the cut. Leaves have dimension -1."""

    def __init__(self, leaves: int):
        self.dim, self.cut, self.right, self.first, self.size = [-1], [0], [0], [0], [leaves]

    def split(self, node: int, dim: int, cut: int) -> None:
        """The children are the two nodes from ``right[node] - 1`` on; the first takes the smaller half of the leaves."""
        left = self.size[node] // 2
        self.dim[node], self.cut[node], self.right[node] = dim, cut, len(self.dim) + 1
        for first, size in ((self.first[node], left), (self.first[node] + left, self.size[node] - left)):
            for c, v in ((self.dim, -1), (self.cut, 0), (self.right, 0), (self.first, first), (self.size, size)):
                c.append(v)

    def node(self, q: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """The node each row has come to; q: a row of 32-bit places for each dimension."""
        dim, cut, right = np.array(self.dim), np.array(self.cut, np.uint64), np.array(self.right)
        at = np.zeros(q.shape[1], np.int64)
        while len(open_ := np.flatnonzero(dim[at] >= 0)):
            here = at[open_]
            at[open_] = right[here] - 1 + (_key(q[dim[here], open_], tie[open_]) > cut[here])
        return at

    def leaf(self, q: np.ndarray, tie: np.ndarray) -> np.ndarray:
        return np.array(self.first)[self.node(q, tie)]


def _key(place: np.ndarray, tie: np.ndarray) -> np.ndarray:
    return (place.astype(np.uint64) << np.uint64(32)) | tie.astype(np.uint64)


def _grow(points: DataFrame, leaves: int) -> Tree:
    """points: size, tie, then the dimensions. One level at a time; each pass adds up sums of fixed number."""
    tree, whole = Tree(leaves), []
    while True:
        level = [i for i in range(len(tree.dim)) if tree.dim[i] < 0 and tree.size[i] > 1]
        spans = {r.node: r for r in _widths(points, tree, level).collect()} if level else {}
        level = [i for i in level if i in spans]  # a node without rows stays whole
        if not level:
            return tree
        whole = whole or [max(1, b - a) for a, b in zip(spans[0].lo, spans[0].hi, strict=True)]
        wide = {i: int(np.argmax([(b - a) / w for a, b, w in zip(spans[i].lo, spans[i].hi, whole, strict=True)])) for i in level}
        cuts = _medians(points, tree, level, wide, {i: spans[i].bytes * (tree.size[i] // 2) / tree.size[i] for i in level})
        for i in level:
            tree.split(i, wide[i], cuts[i])


def _passed(points: DataFrame, tree: Tree, ddl: str, add: Callable) -> DataFrame:
    """``add`` called in each task with (sizes, places, ties, nodes) of each batch, and with None at the end for its rows."""
    names = points.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for b in batches:
            if b.num_rows:
                x = _numbers(b, names)
                add(state, x[0], x[2:], x[1], tree.node(x[2:], x[1]))
        columns = add(state, None, None, None, None)
        if columns is not None and len(columns[0]):
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ddl.split(", ")])

    return points.mapInArrow(rows, ddl)


def _widths(points: DataFrame, tree: Tree, level: list[int]) -> DataFrame:
    """(node, bytes, lo, hi): bytes and the ends of each dimension in each node of the level."""

    def add(state, size, q, tie, node):
        if size is None:
            return [pa.array([f(v) for v in c]) for f, c in zip((int, int, list, list), zip(*[(k, *v) for k, v in state.items()], strict=True), strict=True)] if state else None
        for i in np.intersect1d(node, level):
            of = node == i
            lo, hi, b = q[:, of].min(1).tolist(), q[:, of].max(1).tolist(), int(size[of].sum())
            if int(i) in state:
                c, l, g = state[int(i)]
                b, lo, hi = b + c, list(map(min, lo, l)), list(map(max, hi, g))
            state[int(i)] = (b, lo, hi)
        return None

    parts = _passed(points, tree, "node long, bytes long, lo array<long>, hi array<long>", add)
    ends = [f(F.col(c)[i]) for c, f in (("lo", F.min), ("hi", F.max)) for i in range(len(points.columns) - 2)]
    k = len(ends) // 2
    return parts.groupBy("node").agg(F.sum("bytes").alias("bytes"), F.array(*ends[:k]).alias("lo"), F.array(*ends[k:]).alias("hi"))


def _medians(points: DataFrame, tree: Tree, level: list[int], wide: dict[int, int], goal: dict[int, float]) -> dict[int, int]:
    """For each node the key up to which its rows' bytes come nearest to its goal."""
    bits = max(4, min(16, DIGITS - (len(level) - 1).bit_length()))
    index = np.full(len(tree.dim), -1, np.int64)
    index[level] = np.arange(len(level))
    dim = np.array([wide[i] for i in level])
    prefix, below = [0] * len(level), [0] * len(level)
    shift = 64
    while shift:
        step = min(bits, shift)
        shift -= step
        found = _digits(points, tree, index, dim, np.array(prefix, np.uint64), shift, step)
        for z, i in enumerate(level):
            digit, add = found.get(z, (np.zeros(1, np.int64), np.zeros(1, np.int64)))
            sums = below[z] + np.cumsum(add)
            at = min(int(np.searchsorted(sums, goal[i])), len(sums) - 1)
            before = int(sums[at] - add[at])
            if not shift and goal[i] - before < int(sums[at]) - goal[i] and prefix[z] + int(digit[at]):
                prefix[z] = (prefix[z] << step | int(digit[at])) - 1  # the key itself goes right
                continue
            prefix[z], below[z] = prefix[z] << step | int(digit[at]), before
    return dict(zip(level, prefix, strict=True))


def _digits(points: DataFrame, tree: Tree, index: np.ndarray, dim: np.ndarray, prefix: np.ndarray, shift: int, step: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By node of the level: digits that follow the prefix, ascending, and their bytes."""

    def add(state, size, q, tie, node):
        if size is None:
            if not state:
                return None
            at = np.flatnonzero(state["sum"])
            return [pa.array(at), pa.array(state["sum"][at])]
        z = index[node]
        of = np.flatnonzero(z >= 0)
        z = z[of]
        rest = _key(q[dim[z], of], tie[of]) >> np.uint64(shift)
        ok = (rest >> np.uint64(step)) == prefix[z]
        place = (z[ok] << step) | (rest[ok] & np.uint64((1 << step) - 1)).astype(np.int64)
        if "sum" not in state:
            state["sum"] = np.zeros(len(dim) << step, np.int64)
        np.add.at(state["sum"], place, size[of][ok])
        return None

    t = _passed(points, tree, "at long, bytes long", add).groupBy("at").agg(F.sum("bytes").alias("bytes")).toPandas().sort_values("at")
    at, total = t["at"].to_numpy(np.int64), t["bytes"].to_numpy(np.int64)
    return {int(z): (at[of] & ((1 << step) - 1), total[of]) for z in np.unique(at >> step) for of in [(at >> step) == z]}
