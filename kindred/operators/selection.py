"""Greedy selection of points over any number of rows, without their matrix.

A partial Cholesky factorisation with pivots: what is left of a row's variance, and of its covariance with all rows, follows
from the row's similarities to the points chosen so far, which are few. A step is one pass over the rows that ends in one
row, the next pivot; rows and their factor columns stay where they are, and every SAVE steps the columns are written out so
that a pass does not repeat earlier ones. What reaches the driver is a chosen point a step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import checkpointed

#: Steps after which factor columns are written out.
SAVE = 24
#: Rows of a task of a pass, which does little for each of them.
ROWS = 1 << 14
#: Rows of a block of sums over pairs, and how many of them are compared with the other block at once.
BLOCK, CHUNK = 1 << 13, 256

#: Similarities of the rows of one table with the rows of another.
Similarity = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


class Gaussian:
    """exp(-|a - b|**2 / (2 s**2)) of the vectors in a column: products of matrices, exact to the rounding of the norms."""

    def __init__(self, s: float, column: str = "v"):
        self.s, self.column = s, column

    def __call__(self, a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        x, y = (np.stack(t[self.column].to_numpy()).astype(float) for t in (a, b))
        k = x @ y.T
        k *= 2.0
        k -= (x**2).sum(1)[:, None]
        k -= (y**2).sum(1)[None]
        np.minimum(k, 0.0, out=k)
        k /= 2 * self.s**2
        return np.exp(k, out=k)

    def variance(self, a: pd.DataFrame) -> np.ndarray:
        return np.ones(len(a))


@dataclass
class _Pivots:
    """The chosen points: their rows, factor rows, and the terms their columns are divided by and add to row sums."""

    rows: list[pd.DataFrame] = field(default_factory=list)
    factor: list[np.ndarray] = field(default_factory=list)
    root: list[float] = field(default_factory=list)
    share: list[float] = field(default_factory=list)
    ids: list = field(default_factory=list)
    value: list[float] = field(default_factory=list)


@dataclass
class Selection:
    """``ids`` in the order they were chosen; ``value``: the variance each had left; ``points`` with step and residual."""

    ids: list
    value: np.ndarray
    points: DataFrame
    #: (gid, f): each row's columns of the factor, F F' being the similarities as far as the chosen points explain them.
    factor: DataFrame

    @property
    def logdet(self) -> float:
        """Of the chosen points' matrix, where the determinant was the criterion."""
        return float(np.log(self.value).sum())


def select_by_determinant(points: DataFrame, similarity: Similarity, variance: Callable[[pd.DataFrame], np.ndarray], n: int, *, least: float = 1e-10) -> Selection:
    """The ``n`` points whose similarities have the greedily largest determinant: each step takes the point with most
    variance left, smallest id first, and ends early where none has more than ``least``.

    points has gid and what the functions need. Rows that repeat a gid can be chosen once. No rows give no choice.
    """
    return _greedy(points, similarity, variance, n, None, 0.0, least)


def select_by_variance(points: DataFrame, similarity: Similarity, variance: Callable[[pd.DataFrame], np.ndarray], n: int, *, alpha: float = 1e-6) -> Selection:
    """The ``n`` points that greedily take most covariance out of all rows: each step takes the point with the largest
    row sum of what is left and conditions on it, ``alpha`` being added to its variance.

    The row sums at the start are one pass over blocks of pairs; each later step is one pass over the rows.
    """
    return _greedy(points, similarity, variance, n, row_sums(points, similarity), alpha, -np.inf)


def row_sums(points: DataFrame, similarity: Similarity) -> DataFrame:
    """(gid, total): each point's similarities with all points added up, in blocks of bounded size."""
    return cross_sums(points, points.withColumn("_w", F.lit(1.0)), similarity, "_w")


def cross_sums(points: DataFrame, others: DataFrame, similarity: Similarity, weight: str) -> DataFrame:
    """(gid, total): the sum of each point's similarities with ``others``, times their column ``weight``, block by block."""
    n, m = (max(1, -(-t.count() // BLOCK)) for t in (points, others))
    own = lambda k: F.pmod(F.xxhash64("gid"), F.lit(k)).cast("int")
    all_ = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = points.withColumn("_i", own(n)).withColumn("_j", all_(m))
    right = others.select([F.col(f"`{c}`").alias(c) for c in others.columns]).withColumn("_j", own(m)).withColumn("_i", all_(n))

    def add(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"gid": [], "total": []})
        w = b[weight].to_numpy(float)
        return pd.DataFrame({"gid": a["gid"], "total": np.concatenate([similarity(a.iloc[i : i + CHUNK], b) @ w for i in range(0, len(a), CHUNK)])})

    dealt = [t.repartition(n * m, "_i", "_j").groupBy("_i", "_j") for t in (left, right)]
    parts = dealt[0].cogroup(dealt[1]).applyInPandas(add, f"gid {dict(points.dtypes)['gid']}, total double")
    return parts.groupBy("gid").agg(F.sum("total").alias("total"))


def _greedy(points: DataFrame, similarity: Similarity, variance, n: int, sums: DataFrame | None, alpha: float, least: float) -> Selection:
    by_sum = sums is not None
    state = points.join(sums, "gid").withColumnRenamed("total", "_s") if by_sum else points.withColumn("_s", F.lit(0.0))
    schema = state.withColumn("_f", F.lit(None).cast("array<double>")).withColumn("_d", F.lit(0.0)).schema

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(_f=[np.zeros(0)] * len(b), _d=variance(b))

    state = checkpointed(state.repartition(max(1, -(-points.count() // ROWS))).mapInPandas(start, schema))
    held, done = 0, _Pivots()

    def passed(batches, best_only: bool, first: int, p: _Pivots) -> Iterator[pd.DataFrame]:
        """Rows with the columns of pivots from ``first`` on; or of a task the best row alone."""
        best = None
        for b in batches:
            if not len(b):
                continue
            f = np.zeros((len(b), len(p.ids)))
            if first:
                f[:, :first] = np.stack(b["_f"].to_numpy())
            d, s = b["_d"].to_numpy(float).copy(), b["_s"].to_numpy(float).copy()
            if first < len(p.ids):
                k = similarity(b, pd.concat(p.rows[first:]))
                for j in range(first, len(p.ids)):
                    f[:, j] = (k[:, j - first] - f[:, :j] @ p.factor[j][:j]) / p.root[j]
                    d -= f[:, j] ** 2
                    s -= f[:, j] * p.share[j]
            out = b.assign(_f=list(f), _d=d, _s=s)
            if not best_only:
                yield out
                continue
            out = out[~b["gid"].isin(p.ids)]
            if len(out):
                top = out.sort_values(["_s" if by_sum else "_d", "gid"], ascending=[False, True]).iloc[[0]]
                best = top if best is None else pd.concat([best, top]).sort_values(["_s" if by_sum else "_d", "gid"], ascending=[False, True]).iloc[[0]]
        if best is not None:
            yield best

    score = F.col("_s" if by_sum else "_d")
    while len(done.ids) < n:
        now, first = _Pivots(*[list(v) for v in vars(done).values()]), held
        top = state.mapInPandas(lambda batches, now=now, first=first: passed(batches, True, first, now), schema).orderBy(score.desc(), "gid").limit(1).toPandas()
        if not len(top) or top["_d"].iloc[0] <= least:
            break
        row = top.iloc[0]
        root = float(np.sqrt(row["_d"] + alpha))
        done.ids.append(row["gid"].item() if hasattr(row["gid"], "item") else row["gid"])
        done.value.append(float(row["_d"]))
        done.rows.append(top.drop(columns=["_f", "_d", "_s"]))
        done.factor.append(np.asarray(row["_f"], float))
        done.root.append(root)
        done.share.append(float(row["_s"]) / root)
        if len(done.ids) - held >= SAVE:
            now = _Pivots(*[list(v) for v in vars(done).values()])
            state = checkpointed(state.mapInPandas(lambda batches, now=now, first=held: passed(batches, False, first, now), schema))
            held = len(done.ids)
    now, first = done, held
    left = state.mapInPandas(lambda batches: passed(batches, False, first, now), schema)
    order = F.array_position(F.array(*[F.lit(i) for i in done.ids]), F.col("gid")) if done.ids else F.lit(0)
    step = F.when(order > 0, order.cast("int"))
    return Selection(done.ids, np.array(done.value), left.select(*[F.col(f"`{c}`") for c in points.columns], step.alias("step"), F.col("_d").alias("residual")), left.select("gid", F.col("_f").alias("f")))
