"""Gaussian processes over any number of training points, without their matrix and without a factor of full size.

K + alpha is only ever multiplied with vectors: points are packed into blocks, pairs of blocks are written once, and a
product is one pass over them that evaluates similarities, multiplies and adds up by block. Conjugate gradients run over
several right sides at once: the targets, whose solution gives the mean, and random probes, whose coefficients are the
Lanczos matrices that log det follows from (stochastic quadrature). A partial pivoted factor of few columns preconditions
them and gives the larger part of log det exactly. Vectors stay in Spark, block by block; a step sends the driver a few sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import checkpointed, forget, written
from .models import masked_targets
from .selection import Gaussian, cross_sums, select_by_determinant

#: Points of a block, and pairs of blocks that a task of a product holds.
BLOCK, PAIRS = 1024, 8
#: Sums that one aggregation without groups adds up.
COLUMNS = 512
#: Bytes of vectors up to which they are sent whole to each executor rather than shuffled to the pairs.
BROADCAST = 64 << 20

_STATE = "b int, ids array<{kind}>, y binary, f binary, x binary, r binary, p binary, q binary, sums array<double>"


class ExactGaussianProcess:
    """Mean, quadratic form and log determinant for a similarity of vectors plus ``alpha`` on the diagonal."""

    def __init__(self, similarity: Gaussian, alpha: float = 1e-2, *, rank: int = 40, probes: int = 8, tol: float = 1e-7, max_steps: int = 500, seed: int = 0):
        if alpha <= 0 or rank < 1 or probes < 0:
            raise ValueError("alpha and rank must be positive, probes not negative")
        self.similarity, self.alpha, self.rank, self.probes = similarity, alpha, rank, probes
        self.tol, self.max_steps, self.seed = tol, max_steps, seed

    def fit(self, points: DataFrame, y: DataFrame) -> ExactGaussianProcess:
        """points(gid, v: array) with unique gids, y(gid, y); points without a finite target are left out. Raises if the steps
        do not suffice or no target is known."""
        known = checkpointed(points.select("gid", "v").join(masked_targets(y), "gid"))
        n = known.count()
        if not n:
            raise ValueError("no known targets")
        few = select_by_determinant(known.select("gid", "v"), self.similarity, self.similarity.variance, min(self.rank, n), least=self.alpha * 1e-3)
        self.known, self.n = known, n
        blocks = checkpointed(self._packed(known.join(few.factor, "gid"), len(few.ids)))
        self._solve(blocks, self._pairs(blocks), len(few.ids))
        return self

    def predict(self, queries: DataFrame) -> DataFrame:
        """(gid, y) of queries(gid, v): their similarities with all training points, block by block."""
        train = self.known.select("gid", "v").join(self.weights, "gid")
        return cross_sums(queries.select("gid", "v"), train, self.similarity, "w").withColumnRenamed("total", "y")

    @property
    def objective(self) -> float:
        """y' K^-1 y + log det K, to be minimised."""
        return self.quadratic + self.logdet

    # ------------------------------------------------------------------ tables
    def _packed(self, known: DataFrame, rank: int) -> DataFrame:
        """One row a block: ids, vectors, targets, factor; the state at the start of the steps."""
        nb = max(1, -(-self.n // BLOCK))
        probes, alpha, seed = self.probes, self.alpha, self.seed
        common = np.random.default_rng([seed, 1 << 20]).standard_normal((rank, probes))

        def pack(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
            t = t.sort_values("gid")
            f = np.stack(t["f"].to_numpy()).astype(float).reshape(len(t), rank)
            noise = np.random.default_rng([seed, int(key[0])]).standard_normal((len(t), probes))
            rhs = np.column_stack([t["y"].to_numpy(float), f @ common + np.sqrt(alpha) * noise])  # probes vary as the preconditioner
            row = {"b": key[0], "ids": t["gid"].to_numpy(), "v": np.stack(t["v"].to_numpy()).astype(float).tobytes(), "f": f.tobytes(), "r": rhs.tobytes(), "y": t["y"].to_numpy(float).tobytes()}
            return pd.DataFrame([row])

        kind = dict(known.dtypes)["gid"]
        dealt = known.withColumn("b", F.pmod(F.xxhash64("gid"), F.lit(nb)).cast("int"))
        return dealt.groupBy("b").applyInPandas(pack, f"b int, ids array<{kind}>, v binary, f binary, r binary, y binary")

    def _pairs(self, blocks: DataFrame) -> DataFrame:
        """(i, j, vi, vj) for i <= j; few large rows to a partition, since a task holds them together."""
        a, b = (blocks.select(F.col("b").alias(i), F.col("v").alias(f"v{i}")) for i in "ij")
        nb = blocks.count()
        upper = a.withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(int(blocks.agg(F.max("b")).first()[0]))))).join(b, "j")
        return checkpointed(upper.repartition(max(1, -(-nb * (nb + 1) // 2 // PAIRS)), "i", "j"))

    # ------------------------------------------------------------------ the product
    def _times(self, pairs: DataFrame, vectors: DataFrame, columns: int) -> DataFrame:
        """(b, q): the rows of K times vectors(b, p), without alpha."""
        sent = F.broadcast if self.n * columns * 8 <= BROADCAST else lambda df: df
        met = pairs.join(sent(vectors.select(F.col("b").alias("i"), F.col("p").alias("pi"))), "i").join(sent(vectors.select(F.col("b").alias("j"), F.col("p").alias("pj"))), "j")
        similarity = self.similarity

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    pi, pj = (np.frombuffer(row[c], float).reshape(-1, columns) for c in ("pi", "pj"))
                    a, b = (pd.DataFrame({similarity.column: list(np.frombuffer(row[c], float).reshape(len(p), -1))}) for c, p in (("vi", pi), ("vj", pj)))
                    k = similarity(a, b)
                    for at, v in ((row["i"], k @ pj), (row["j"], k.T @ pi))[: 1 + (row["i"] != row["j"])]:
                        sums[at] = sums[at] + v if at in sums else v
            for at, v in sums.items():
                yield pa.RecordBatch.from_pydict({"b": pa.array([at], pa.int32()), "q": pa.array([v.tobytes()], pa.binary())})

        def add(t: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"b": [t["b"].iloc[0]], "q": [sum(np.frombuffer(v, float) for v in t["q"]).tobytes()]})

        return met.select("i", "j", "vi", "vj", "pi", "pj").mapInArrow(multiply, "b int, q binary").groupBy("b").applyInPandas(add, "b int, q binary")

    # ------------------------------------------------------------------ conjugate gradients
    def _solve(self, blocks: DataFrame, pairs: DataFrame, rank: int) -> None:
        c, alpha = 1 + self.probes, self.alpha
        kind = dict(blocks.dtypes)["ids"][6:-1]
        schema = _STATE.format(kind=kind)

        def start(m):
            r, f = m["r"], m["f"]
            return {"x": 0 * r, "p": 0 * r, "q": 0 * r}, [*(r * r).sum(0), *(f.T @ r).ravel(), *(f.T @ f).ravel()]

        state, sums = self._step(blocks.select("b", "ids", "y", "f", F.col("r").alias("x"), "r", F.col("r").alias("p"), F.col("r").alias("q")), schema, c, rank, start)
        rr, fr, gram = sums[:c], sums[c : c + rank * c].reshape(rank, c), sums[c + rank * c :].reshape(rank, rank)
        inner = alpha * np.eye(rank) + gram
        # the preconditioner F F' + alpha: its inverse on r is (r - F w) / alpha with w = inner^-1 F' r
        w = np.linalg.solve(inner, fr)
        rz = (rr - (fr * w).sum(0)) / alpha
        goal, first, beta, steps = self.tol * np.sqrt(rr), rz.copy(), np.zeros(c), []
        for _ in range(self.max_steps):

            def direct(m, w=w, beta=beta):
                return {"p": (m["r"] - m["f"] @ w) / alpha + beta * m["p"]}, []

            moved, _ = self._step(state, schema, c, rank, direct, gather=False)
            past, moved = state, written(moved)
            forget(past)
            q = self._times(pairs, moved.select("b", "p"), c)

            def curve(m):
                q = m["q"] + alpha * m["p"]
                return {"q": q}, (m["p"] * q).sum(0)

            state, pq = self._step(moved.drop("q", "sums").join(q, "b"), schema, c, rank, curve)
            forget(moved)
            going = pq > 0
            step = np.where(going, rz / np.where(going, pq, 1.0), 0.0)

            def move(m, step=step):
                r = m["r"] - step * m["q"]
                return {"x": m["x"] + step * m["p"], "r": r}, [*(r * r).sum(0), *(m["f"].T @ r).ravel()]

            past = state
            state, sums = self._step(past, schema, c, rank, move)
            forget(past)
            rr, fr = sums[:c], sums[c:].reshape(rank, c)
            w = np.linalg.solve(inner, fr)
            new = (rr - (fr * w).sum(0)) / alpha
            beta = np.where(rz > 0, new / np.where(rz > 0, rz, 1.0), 0.0)
            steps.append((step, beta))
            rz = new
            if (np.sqrt(np.maximum(rr, 0)) <= goal).all():
                break
        else:
            raise ArithmeticError("conjugate gradients did not converge")
        self.steps = len(steps)
        done = state

        def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t in batches:
                for _, row in t.iterrows():
                    yield pd.DataFrame({"gid": row["ids"], "w": np.frombuffer(row["x"], float).reshape(-1, c)[:, 0], "y": np.frombuffer(row["y"], float)})

        out = done.select("ids", "x", "y").mapInPandas(unpack, f"gid {kind}, w double, y double")
        self.quadratic = float(out.agg(F.sum(F.col("w") * F.col("y"))).first()[0])
        self.weights = out.select("gid", "w")
        size = np.linalg.slogdet(np.eye(rank) + gram / alpha)[1] + self.n * np.log(alpha)
        self.logdet = float(size + np.mean([first[k] * _log_of_lanczos([(a[k], b[k]) for a, b in steps]) for k in range(1, c)])) if self.probes else float("nan")

    def _step(self, state: DataFrame, schema: str, c: int, rank: int, change: Callable, gather: bool = True) -> tuple[DataFrame, np.ndarray]:
        """The state with the arrays that ``change`` returns, and the sums over all blocks of the numbers it returns."""
        names = [s.split()[0] for s in schema.split(", ")]

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t in batches:
                out = []
                for _, row in t.iterrows():
                    m = {k: np.frombuffer(row[k], float).reshape(len(row["ids"]), -1) for k in ("x", "r", "p", "q")}
                    m["f"] = np.frombuffer(row["f"], float).reshape(len(row["ids"]), rank)
                    arrays, sums = change(m)
                    out.append({**{k: row[k] for k in ("b", "ids", "y", "f", "x", "r", "p", "q")}, **{k: np.ascontiguousarray(v).tobytes() for k, v in arrays.items()}, "sums": np.asarray(sums, float)})
                yield pd.DataFrame(out, columns=names)

        state = state.select(*[k for k in names if k != "sums"]).mapInPandas(rows, schema)
        if not gather:
            return state, np.zeros(0)
        state = written(state)
        size = state.select(F.size("sums").alias("n")).limit(1).first().n
        if size <= COLUMNS:
            return state, np.array(list(state.agg(*[F.sum(F.col("sums")[k]) for k in range(size)]).first()), float)
        total = state.select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")
        return state, total["v"].to_numpy(float)


def _log_of_lanczos(steps: list[tuple[float, float]]) -> float:
    """e1' log(T) e1 of the Lanczos matrix that belongs to conjugate gradients with these steps and directions' factors."""
    steps = [s for s in steps if s[0] > 0]
    if not steps:
        return 0.0
    t = np.zeros((len(steps), len(steps)))
    for j, (a, b) in enumerate(steps):
        t[j, j] = 1 / a + (steps[j - 1][1] / steps[j - 1][0] if j else 0.0)
        if j + 1 < len(steps):
            t[j, j + 1] = t[j + 1, j] = np.sqrt(max(b, 0.0)) / a
    values, vectors = np.linalg.eigh(t)
    return float((vectors[0] ** 2 * np.log(np.maximum(values, 1e-300))).sum())
