"""Hard negatives by a blocked matrix product of anchors and rows.

The scores are the product A R' of two matrices that Spark holds in blocks of rows and of dimensions. Every task multiplies
one block of anchors with one block of rows over one run of dimensions; the partial int64 tiles, a strip for each anchor,
are shuffled to their pair of blocks and added there, and a finished tile keeps only the best rows of each anchor and
window. Two products are made: rows of like labels give the positives, and these the windows of the second product, which
gives the negatives. Tiles are of fixed size at any number of rows; blocks are dealt by a hash of a row number, so neither a
common label nor a repeated id makes a block larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import stash, unstash

#: Rows of a block of anchors and of a block of rows, and dimensions of a run: a tile has ANCHORS x ROWS scores of 8 bytes.
ANCHORS, ROWS, DIMENSIONS = 256, 1024, 32
#: Labels are dealt to so many groups for the first product.
GROUPS = 16

_PARTIAL = "i int, j int, a long, k int, s binary, r binary, id binary, label binary, a_id long, a_label long, p array<struct<p:long,id:long,s:long>>"
_BEST = "a long, a_id long, p long, p_id long, p_score long, n long, id long, score long"


def mine_hard_negatives(
    rows: DataFrame, anchor: Column, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, dimensions: int = DIMENSIONS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row for which ``anchor`` holds.

    A component x counts as floor(scale * x) (beyond 2**62 as that), a score is the inner product of two rows, modulo
    2**64; components that one of two vectors lacks count as 0. An anchor's positives are the ``positives`` other rows of
    its label with the highest scores; for each the ``negatives`` highest rows of another label are returned whose score
    is from ``low`` to ``high`` percent of the positive's. Ties go by smaller id. All are returned where there are fewer,
    and nothing for an anchor without positives or a positive without negatives.

    Rows with a null id, label or vector, or a component that is null, NaN or infinite, take no part. An empty vector scores
    0. Rows that repeat an id are rows of their own, the anchor's own id included. An empty table gives no rows; other
    columns are not looked at.
    """
    dt = dict(rows.dtypes)[vector]
    x = F.col(f"`{vector}`")
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))
    known = rows.where(F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & sound)
    held = stash(
        known.select(
            F.monotonically_increasing_id().alias("n"), F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
            F.coalesce(anchor, F.lit(False)).alias("is_anchor"), x.cast("array<double>" if dt != "array<float>" else dt).alias("x"),
        )
    )
    group = F.pmod("label", F.lit(GROUPS)).cast("int")
    count = {r.g: (r.a, r.n) for r in held.groupBy(group.alias("g")).agg(F.sum(F.col("is_anchor").cast("long")).alias("a"), F.count("*").alias("n")).collect()}
    blocks = lambda n, most: max(1, -(-n // most))
    by_label = [(blocks(count.get(g, (0, 0))[0], ANCHORS), blocks(count.get(g, (0, 0))[1], ROWS)) for g in range(GROUPS)]
    over_all = [(blocks(sum(a for a, _ in count.values()), ANCHORS), blocks(sum(n for _, n in count.values()), ROWS))]

    order = [F.col("score").desc(), "id", "n"]
    best = _products(held, held.where("is_anchor").withColumn("p", F.lit(None).cast("array<struct<p:long,id:long,s:long>>")), group, by_label, dimensions, _Positives(positives), scale)
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(*order))).where(F.col("rank") <= positives)
    found = stash(first.groupBy("a").agg(F.collect_list(F.struct(F.col("n").alias("p"), "id", F.col("score").alias("s"))).alias("p")))

    anchors = held.where("is_anchor").join(found.withColumnRenamed("a", "n"), "n")
    best = _products(held, anchors, F.lit(0), over_all, dimensions, _Negatives(negatives, low, high), scale)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("a", "p").orderBy(*order))).where(F.col("rank") <= negatives)
    out = stash(ranked.select(F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score")))
    unstash(held)
    unstash(found)
    return out


# --------------------------------------------------------------------------- the product
def _products(rows: DataFrame, anchors: DataFrame, group: Column, blocks: list[tuple[int, int]], width: int, best: _Positives, scale: float) -> DataFrame:
    """What ``best`` keeps of each tile, tiles being made within each group of ``blocks`` (anchor blocks, row blocks)."""
    firsts = np.cumsum([0, *[a for a, _ in blocks]]).tolist(), np.cumsum([0, *[r for _, r in blocks]]).tolist()

    def of(values: list[int]) -> Column:
        return F.element_at(F.array([F.lit(int(v)) for v in values]), group + 1)

    def dealt(side: DataFrame, own: int) -> DataFrame:
        mine = (of(firsts[own][:-1]) + F.pmod(F.xxhash64("n"), of([b[own] for b in blocks]))).cast("int")
        start = of(firsts[1 - own][:-1])
        others = F.sequence(start, start + of([b[1 - own] for b in blocks]) - 1)
        names = ("i", "j") if own == 0 else ("j", "i")
        runs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("x") / width).cast("int") - 1))
        met = side.withColumn(names[0], mine).withColumn(names[1], F.explode(others)).withColumn("k", F.explode(runs))
        head = F.col("k") == 0  # what describes a row goes with its first run of dimensions
        described = [F.when(head, F.col(c)).alias(c) for c in ("id", "label")]
        return met.select("i", "j", "k", F.lit(own).alias("side"), "n", *described, F.slice("x", F.col("k") * width + 1, F.lit(width)).alias("x"), (F.when(head, F.col("p")) if own == 0 else F.lit(None).cast("array<struct<p:long,id:long,s:long>>")).alias("p"))

    partial, kept = to_arrow_schema(StructType.fromDDL(_PARTIAL)), to_arrow_schema(StructType.fromDDL(_BEST))

    def multiply(key: tuple, t: pa.Table) -> pa.Table:
        i, j, k = (v.as_py() for v in key)
        t = t.combine_chunks()
        side, n = t.column("side").to_numpy(), t.column("n").to_numpy()
        pick = [np.flatnonzero(side == s) for s in (0, 1)]
        pick = [p[np.argsort(n[p], kind="stable")] for p in pick]
        if not len(pick[0]) or not len(pick[1]):
            return partial.empty_table()
        q = _quantised(t.column("x"), width, scale)
        a, r = q[pick[0]], q[pick[1]]
        if float(np.abs(a).max(initial=0)) * float(np.abs(r).max(initial=0)) * max(1, a.shape[1]) < 2.0**53:
            s = (a.astype(float) @ r.astype(float).T).astype(np.int64)  # exact
        else:
            s = a @ r.T
        first = k == 0
        column = lambda c, at: t.column(c).take(pa.array(at)) if first else pa.nulls(len(at), t.column(c).type)
        head = {"i": i, "j": j, "a": -1, "k": k, "s": None, "r": n[pick[1]].tobytes(), "id": column("id", pick[1]).to_numpy().tobytes() if first else None, "label": column("label", pick[1]).to_numpy().tobytes() if first else None}
        m = len(pick[0])
        strips = pa.table(
            [pa.array([i] * m, pa.int32()), pa.array([j] * m, pa.int32()), pa.array(n[pick[0]]), pa.array([k] * m, pa.int32()), pa.array([z.tobytes() for z in s], pa.binary()),
             *[pa.nulls(m, pa.binary())] * 3, column("id", pick[0]), column("label", pick[0]), column("p", pick[0]).cast(partial.field("p").type)], schema=partial,
        )
        return pa.concat_tables([pa.Table.from_pylist([head], schema=partial), strips])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for b in batches:
            cols = [b.column(c) for c in range(b.num_columns)]
            i, j, a, k = (c.to_numpy() for c in cols[:4])
            for z in range(b.num_rows):
                if tile is None or tile.at != (i[z], j[z]):
                    if tile is not None:
                        yield from best.of(tile, kept)
                    tile = _Tile((i[z], j[z]))
                if a[z] < 0:
                    tile.head(k[z], *(None if c[z].as_py() is None else np.frombuffer(c[z].as_buffer(), np.int64) for c in cols[5:8]))
                else:
                    tile.add(a[z], k[z], np.frombuffer(cols[4][z].as_buffer(), np.int64), [c[z] for c in cols[8:]])
        if tile is not None:
            yield from best.of(tile, kept)

    met = dealt(anchors, 0).unionByName(dealt(rows.withColumn("p", F.lit(None)), 1))
    tiles = met.groupBy("i", "j", "k").applyInArrow(multiply, _PARTIAL)
    return tiles.repartition("i", "j").sortWithinPartitions("i", "j", "a", "k").mapInArrow(add, _BEST)


def _quantised(x: pa.ChunkedArray, width: int, scale: float) -> np.ndarray:
    """Lists of at most ``width`` numbers as rows of int64, the missing ones 0."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    size = np.diff(x.offsets.to_numpy())
    row = np.repeat(np.arange(len(x)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    v = np.floor(x.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(x), min(width, int(size.max(initial=0)))), np.int64)
    out[row, at] = np.clip(v, -(2.0**62), 2.0**62).astype(np.int64)
    return out


class _Tile:
    """Scores of one pair of blocks, as their strips come in: headers first, then anchor by anchor."""

    def __init__(self, at: tuple):
        self.at, self.runs, self.scores, self.anchors = at, {}, [], []
        self.n = self.id = self.label = np.zeros(0, np.int64)

    def head(self, k: int, n, ids, labels) -> None:
        if k == 0:
            self.n, self.id, self.label = n, ids, labels
        # rows with fewer dimensions are missing from later runs
        self.runs[k] = slice(None) if len(n) == len(self.n) else np.searchsorted(self.n, n)

    def add(self, a: int, k: int, strip: np.ndarray, described: list) -> None:
        if not self.anchors or self.anchors[-1][0] != a:
            self.anchors.append((a, *(v.as_py() for v in described)))
            self.scores.append(np.zeros(len(self.n), np.int64))
        self.scores[-1][self.runs[k]] += strip


class _Positives:
    """The highest rows of the anchor's own label."""

    def __init__(self, most: int):
        self.most = most

    def windows(self, tile: _Tile, a: tuple, score: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
        yield (None, None, None), np.flatnonzero((tile.label == a[2]) & (tile.n != a[0]))

    def of(self, tile: _Tile, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in schema]
        for a, score in zip(tile.anchors, tile.scores, strict=True):
            for p, at in self.windows(tile, a, score):
                if len(at) > self.most:
                    at = at[score[at] >= np.partition(score[at], -self.most)[-self.most]]
                at = at[np.lexsort((tile.n[at], tile.id[at], -score[at]))][: self.most]
                row = [np.full(len(at), v, object) for v in (a[0], a[1], *p)] + [tile.n[at], tile.id[at], score[at]]
                for c, v in zip(out, row, strict=True):
                    c.extend(v.tolist())
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


class _Negatives(_Positives):
    """The highest rows of other labels within each positive's window."""

    def __init__(self, most: int, low: int, high: int):
        super().__init__(most)
        self.low, self.high = low, high

    def windows(self, tile, a, score):
        other = tile.label != a[2]
        for p in a[3] or []:
            least, top = -(-self.low * p["s"] // 100), self.high * p["s"] // 100
            if least <= top:
                yield (p["p"], p["id"], p["s"]), np.flatnonzero(other & (score >= least) & (score <= top))
