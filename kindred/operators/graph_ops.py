"""Relational graph operators over node and edge tables, and node reorderings per graph."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def symmetrized(edges: DataFrame, *, loops_once: bool = True) -> DataFrame:
    """Each edge in both directions; a self-loop once, or twice where the adjacency matrix is A + A^T."""
    swap = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    back = edges.select([swap.get(c, F.col(c)) for c in edges.columns])
    return edges.union(back.where("src <> dst") if loops_once else back)


def adjacency_matrix(edges: DataFrame) -> DataFrame:
    """(gid, i, j, a): A + A^T of the weights; self-loops count double here, unlike in :func:`degree`."""
    return symmetrized(edges, loops_once=False).groupBy("gid", F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum("w").alias("a"))


def laplacian(edges: DataFrame) -> DataFrame:
    """(gid, i, j, l): the column sums of the adjacency matrix on the diagonal, less the matrix."""
    a = adjacency_matrix(edges)
    diag = a.groupBy("gid", F.col("j").alias("i")).agg(F.sum("a").alias("l")).select("gid", "i", F.col("i").alias("j"), "l")
    return diag.unionByName(a.select("gid", "i", "j", (-F.col("a")).alias("l"))).groupBy("gid", "i", "j").agg(F.sum("l").alias("l"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(gid, nid, d): summed weights at a node, a self-loop once; an isolated node has 1."""
    s = symmetrized(edges).groupBy("gid", F.col("src").alias("nid")).agg(F.sum("w").alias("d"))
    return nodes.select("gid", "nid").join(s, ["gid", "nid"], "left").select("gid", "nid", F.when(F.coalesce("d", F.lit(0.0)) == 0, 1.0).otherwise(F.col("d")).alias("d"))


def permute(nodes: DataFrame, edges: DataFrame, perm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rename nodes: perm(gid, nid, pos) puts node ``nid`` at place ``pos``."""
    n = nodes.join(perm, ["gid", "nid"]).withColumn("nid", F.col("pos").cast("int")).select(nodes.columns)
    e = edges
    for end in ("src", "dst"):
        e = e.join(perm.select("gid", F.col("nid").alias(end), F.col("pos").alias("_p")), ["gid", end]).withColumn(end, F.col("_p").cast("int")).drop("_p")
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    return n, e.withColumns({"src": lo, "dst": hi}).select(edges.columns)


def tile_count(edges: DataFrame, size: int = 8) -> DataFrame:
    """(gid, tiles): non-empty size x size tiles of the symmetric adjacency matrix."""
    s = symmetrized(edges)
    return s.groupBy("gid").agg(F.count_distinct(F.floor(F.col("src") / size), F.floor(F.col("dst") / size)).alias("tiles"))


def ring_lists(nodes: DataFrame, rings: DataFrame) -> DataFrame:
    """(gid, nid, ring_list): sorted sizes of the rings (gid, nid, size) through a node, or [0]."""
    r = rings.groupBy("gid", "nid").agg(F.sort_array(F.collect_list("size")).alias("ring_list"))
    return nodes.select("gid", "nid").join(r, ["gid", "nid"], "left").withColumn("ring_list", F.coalesce("ring_list", F.array(F.lit(0).cast("int"))))


def _lists(n: int, src: np.ndarray, dst: np.ndarray) -> list[set[int]]:
    out: list[set[int]] = [set() for _ in range(n)]
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def reverse_cuthill_mckee(n: int, src: np.ndarray, dst: np.ndarray) -> list[int]:
    """Breadth-first from a node of least degree, neighbours by degree, the whole reversed."""
    near = _lists(n, src, dst)
    left, order = set(range(n)), []
    while left:
        root = min(left, key=lambda i: (len(near[i]), i))
        left.discard(root)
        queue = deque([root])
        while queue:
            i = queue.popleft()
            order.append(i)
            for j in sorted(near[i] & left, key=lambda k: (len(near[k]), k)):
                left.discard(j)
                queue.append(j)
    return order[::-1]


def tiles(order: list[int], src: np.ndarray, dst: np.ndarray, size: int = 8) -> int:
    pos = np.empty(len(order), int)
    pos[order] = np.arange(len(order))
    a, b = pos[src] // size, pos[dst] // size
    return len(set(zip(np.r_[a, b].tolist(), np.r_[b, a].tolist(), strict=True)))


def partition_reorder(n: int, src: np.ndarray, dst: np.ndarray, size: int = 8) -> list[int]:
    """Fill tiles greedily with the nodes most connected to them; kept only if the tile count does not grow."""
    near = _lists(n, src, dst)
    left, order = set(range(n)), []
    while left:
        block = [min(left, key=lambda i: (len(near[i] & left), i))]
        left.discard(block[0])
        while left and len(block) < size:
            inside = set(block)
            best = max(left, key=lambda i: (len(near[i] & inside), -len(near[i] & left), -i))
            block.append(best)
            left.discard(best)
        order += block
    best = min((list(range(n)), reverse_cuthill_mckee(n, src, dst), order), key=lambda o: tiles(o, src, dst, size))
    return best


def reorder(nodes: DataFrame, edges: DataFrame, method: str = "rcm") -> DataFrame:
    """(gid, nid, pos): a new place for each node; method 'rcm' or 'pbr'. A row is a graph, so many share a call of Python."""
    step = {"rcm": reverse_cuthill_mckee, "pbr": partition_reorder}[method]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("_e")
            ends = lists.offsets.to_numpy()
            src, dst = (lists.values.field(x).to_numpy() for x in ("src", "dst"))
            sizes = b.column("_n").to_numpy()
            order = [step(n, src[i:j], dst[i:j]) for n, i, j in zip(sizes.tolist(), ends[:-1], ends[1:], strict=True)]
            of = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            nid = np.array([i for o in order for i in o], np.int32)
            yield pa.RecordBatch.from_arrays([b.column("gid").take(of), pa.array(nid), pa.array(place.astype(np.int32))], names=["gid", "nid", "pos"])

    kind = dict(nodes.dtypes)["gid"]
    ends = F.struct(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))
    parts = nodes.select("gid", F.lit(1).alias("_n"), F.lit(None).cast("struct<src:int,dst:int>").alias("_e"))
    parts = parts.unionByName(edges.select(F.col("gid").cast(kind).alias("gid"), F.lit(0).alias("_n"), ends.alias("_e")))
    graphs = parts.groupBy("gid").agg(F.sum("_n").alias("_n"), F.collect_list("_e").alias("_e"))
    return graphs.where("_n > 0").mapInArrow(rows, f"gid {kind}, nid int, pos int")


def transitions(sequences: DataFrame) -> DataFrame:
    """(gid, a, b, w) counts of consecutive symbols, from sequences(gid, pos, symbol)."""
    s = sequences.withColumn("b", F.lead("symbol").over(Window.partitionBy("gid").orderBy("pos"))).where("b IS NOT NULL")
    return s.groupBy("gid", F.col("symbol").alias("a"), "b").agg(F.count("*").alias("w"))
