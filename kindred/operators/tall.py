"""Low-rank matrices A = F F' and A = F F' + D by their tall factor, whose many rows stay in Spark.

The factor is reduced by a tree of QR decompositions: each task folds its rows into one small triangle, triangles are
folded again by group, and the last few meet on the driver. Singular values follow from the triangle without squaring their
spread; products with A's pseudoinverse are one sum over the rows and one pass that returns a value a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Triangles that the last fold takes.
LAST = 64


def triangle(rows: DataFrame, columns: int) -> np.ndarray:
    """R of F = Q R for the rows' column ``f``, (columns, columns); zeros where there are fewer rows than columns."""

    def fold(parts: list[np.ndarray]) -> np.ndarray:
        m = np.concatenate([np.zeros((columns, columns)), *parts])
        return np.linalg.qr(m, mode="r")

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for b in batches:
            if len(b):
                r = fold([x for x in (r, np.stack(b["f"].to_numpy()).astype(float)) if x is not None])
        if r is not None:
            yield pd.DataFrame({"r": [r.tobytes()]})

    def group(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [fold([np.frombuffer(v, float).reshape(columns, columns) for v in t["r"]]).tobytes()]})

    small = rows.select("f").mapInPandas(own, "r binary").withColumn("_g", F.pmod(F.xxhash64("r"), F.lit(LAST)))
    last = small.groupBy("_g").applyInPandas(lambda t: group(t), "r binary").collect()  # at most LAST triangles
    return fold([np.frombuffer(x.r, float).reshape(columns, columns) for x in last])


class TallFactor:
    """A = F F' for rows(gid, f: array of ``columns`` numbers) with unique gids; singular values below ``rcond`` times the
    largest count as 0. No rows give A without entries: log det 0."""

    def __init__(self, rows: DataFrame, columns: int, rcond: float = 1e-10):
        self.rows, self.columns = rows.select("gid", "f"), columns
        _, s, vt = np.linalg.svd(triangle(rows, columns))
        kept = s > rcond * s.max(initial=0.0)
        self.singular, self.basis = s[kept], vt[kept].T

    @property
    def logdet(self) -> float:
        """Over the kept part."""
        return float(2 * np.log(self.singular).sum())

    @property
    def cond(self) -> float:
        return float((self.singular[0] / self.singular[-1]) ** 2) if len(self.singular) else 0.0

    @property
    def trace(self) -> float:
        return float((self.singular**2).sum())

    def times(self, y: DataFrame) -> DataFrame:
        """(gid, z = A y) for y(gid, y); rows without a value count as 0."""
        return self._out(self._sum(y))

    def pinv_times(self, y: DataFrame) -> DataFrame:
        """(gid, z): the pseudoinverse of A times y."""
        v = self.basis / self.singular**2
        return self._out(v @ (v.T @ self._sum(y)))

    def shifted_solve(self, y: DataFrame, d: float) -> tuple[DataFrame, float]:
        """(gid, z) with (A + d) z = y, and log det of A + d, for d > 0 and every row of the factor."""
        if d <= 0:
            raise ValueError("the shift must be positive")
        inner = self.basis * (1 / (self.singular**2 + d)) @ (self.basis.T @ self._sum(y))
        low = self._out(inner).withColumnRenamed("z", "_z").join(y, "gid", "left")
        n = self.rows.count()
        logdet = float(np.log(self.singular**2 + d).sum() + (n - len(self.singular)) * np.log(d))
        return low.select("gid", ((F.coalesce("y", F.lit(0.0)) - F.col("_z")) / d).alias("z")), logdet

    def _sum(self, y: DataFrame) -> np.ndarray:
        """F' y: partial sums a task, added up by column."""

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = np.zeros(self_columns)
            for b in batches:
                if len(b):
                    s += np.stack(b["f"].to_numpy()).astype(float).T @ b["y"].to_numpy(float)
            yield pd.DataFrame({"k": np.arange(self_columns), "v": s})

        self_columns = self.columns
        known = self.rows.join(y.where("y IS NOT NULL"), "gid")
        got = known.mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(self.columns)
        for r in got:
            out[r.k] = r.v
        return out

    def _out(self, w: np.ndarray) -> DataFrame:
        weights = F.array(*[F.lit(float(v)) for v in w])
        z = F.aggregate(F.zip_with("f", weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
        return self.rows.select("gid", z.alias("z"))
