"""Symbol sequences: n-gram tables, suffix contexts, random edits, and guided search over them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of an n-gram table that a rewriter holds, here and in each task.
GRAM_LIMIT = 2_000_000


def ngrams(seqs: DataFrame, n: int) -> DataFrame:
    """(context, symbol, cnt): occurrences of each symbol after each context of 0 to n symbols. seqs(id, s)."""
    s = seqs.select("s").where("length(s) > 0")
    at = s.select("s", F.explode(F.sequence(F.lit(1), F.length("s"))).alias("p"))
    both = at.select("s", "p", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("p") - 1))).alias("k"))
    return both.groupBy(F.expr("substring(s, p - k, k)").alias("context"), F.expr("substring(s, p, 1)").alias("symbol")).agg(F.count("*").alias("cnt"))


def frequencies(grams: DataFrame) -> DataFrame:
    """With freq: the share of each symbol in its context."""
    return grams.withColumn("freq", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("context")))


def match_context(grams: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(id, context): the longest suffix of at most n symbols that has continuations. queries(id, s)."""
    tails = queries.select("id", "s", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.length("s")))).alias("k"))
    tails = tails.select("id", F.expr("substring(s, length(s) - k + 1, k)").alias("context"), "k")
    return tails.join(grams.select("context").distinct(), "context").groupBy("id").agg(F.max_by("context", "k").alias("context"))


class SequenceRewriter:
    """Random insertions, changes and deletions; new symbols follow the n-gram frequencies of their context."""

    def __init__(self, grams: DataFrame, n: int = 1, b: int = 3, min_edits: int = 1, max_edits: int = 5, seed: int = 0):
        self.n, self.b, self.edits = n, b, (min_edits, max_edits)
        if (found := grams.count()) > GRAM_LIMIT:
            raise ValueError(f"{found} n-grams; the rewriter holds {GRAM_LIMIT}, take a smaller n")
        self.table: dict[str, tuple[list[str], np.ndarray]] = {}
        for r in frequencies(grams).groupBy("context").agg(F.sort_array(F.collect_list(F.struct("symbol", "freq"))).alias("t")).toLocalIterator():
            self.table[r.context] = ([x.symbol for x in r.t], np.array([x.freq for x in r.t]))
        self.rng = np.random.default_rng(seed)

    def draw(self, before: str) -> str:
        for k in range(min(self.n, len(before)), -1, -1):
            found = self.table.get(before[len(before) - k :])
            if found:
                return str(self.rng.choice(found[0], p=found[1] / found[1].sum()))
        return ""

    def __call__(self, s: str) -> list[str]:
        out: set[str] = set()
        for _ in range(8 * self.b):
            t = s
            for _ in range(int(self.rng.integers(self.edits[0], self.edits[1] + 1))):
                i = int(self.rng.integers(len(t) + 1))
                how = self.rng.integers(3)
                if how == 0:
                    t = t[:i] + self.draw(t[:i]) + t[i:]
                elif i < len(t):
                    t = t[:i] + (self.draw(t[:i]) if how == 1 else "") + t[i + 1 :]
            if t and t != s:
                out.add(t)
            if len(out) >= self.b:
                break
        return sorted(out)


def rewrites(rewriter: SequenceRewriter, seqs: DataFrame, seed: int = 0) -> DataFrame:
    """(id, s): the offspring of every sequence of seqs(id, s); a row's edits depend on its id and the seed alone."""
    salted = seqs.select("id", "s", F.xxhash64("id", F.lit(seed)).alias("_h"))

    def out(batches):
        for t in batches:
            rows = []
            for i, text, h in zip(t["id"], t["s"], t["_h"], strict=True):
                rewriter.rng = np.random.default_rng(int(h) & (2**63 - 1))
                rows += [(i, x) for x in rewriter(text or "")]
            yield pd.DataFrame(rows, columns=["id", "s"])

    return salted.mapInPandas(out, f"id {dict(seqs.dtypes)['id']}, s string")


class TreeSearch:
    """Monte Carlo tree search for a sequence whose predicted value meets a target.

    ``rewrite`` proposes children, ``predict`` gives mean and deviation for a list of sequences. A node with children has
    their precision-weighted mean and spread; a child is chosen by the density of the target under its values, no
    narrower than ``precision``, plus an exploration term. A sequence enters the tree once; nodes without new children
    keep their own values.
    """

    def __init__(self, rewrite: Callable[[str], list[str]], predict: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], exploration: float = 1.0, precision: float = 0.01):
        self.rewrite, self.predict, self.exploration, self.precision = rewrite, predict, exploration, precision

    def seek(self, start: str, target: float, steps: int = 500) -> list[tuple[str, float, float, float]]:
        """(sequence, mean, deviation, likelihood of the target), likeliest first; ties keep the order of discovery."""
        m, s = self.predict([start])
        nodes = [{"s": start, "up": None, "own": (m[0], s[0]), "m": m[0], "sd": s[0], "n": 1, "kids": []}]
        seen = {start}
        for _ in range(steps):
            i = 0
            nodes[i]["n"] += 1
            while nodes[i]["kids"]:
                i = max(nodes[i]["kids"], key=lambda k, i=i: self._score(nodes[k], nodes[i]["n"], target))
                nodes[i]["n"] += 1
            new = list(dict.fromkeys(x for x in self.rewrite(nodes[i]["s"]) if x not in seen))
            if new:
                means, devs = self.predict(new)
                for x, a, b in zip(new, means, devs, strict=True):
                    seen.add(x)
                    nodes[i]["kids"].append(len(nodes))
                    nodes.append({"s": x, "up": i, "own": (a, b), "m": a, "sd": b, "n": 1, "kids": []})
            up = i if new else nodes[i]["up"]
            while up is not None:
                p = nodes[up]
                m, sd = (np.array([nodes[k][c] for k in p["kids"]], float) for c in ("m", "sd"))
                w = np.maximum(sd, 1e-6) ** -2  # a child without spread still has a finite weight
                p["m"] = float(w @ m / w.sum())
                p["sd"] = float((w @ (m - p["m"]) ** 2 / w.sum()) ** 0.5)
                up = p["up"]
        found = [(x["s"], float(x["own"][0]), float(x["own"][1]), self._likelihood(x, target)) for x in nodes]
        return sorted(found, key=lambda x: -x[3])

    def _likelihood(self, node: dict, target: float) -> float:
        sd = max(node["sd"], self.precision)
        return math.exp(-0.5 * ((target - node["m"]) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))

    def _score(self, child: dict, visits: int, target: float) -> float:
        return self._likelihood(child, target) + self.exploration * math.sqrt(math.log(visits) / child["n"])


def flatten_tree(tree: DataFrame) -> DataFrame:
    """(id, level, path) of a tree(id, parent), roots at level 0."""
    tree.createOrReplaceTempView("_kindred_tree")
    return tree.sparkSession.sql("""
        WITH RECURSIVE t(id, level, path) AS (
          SELECT id, 0, CAST(id AS STRING) FROM _kindred_tree WHERE parent IS NULL
          UNION ALL
          SELECT c.id, t.level + 1, concat(t.path, '/', CAST(c.id AS STRING)) FROM _kindred_tree c JOIN t ON c.parent = t.id)
        SELECT id, level, path FROM t""")
