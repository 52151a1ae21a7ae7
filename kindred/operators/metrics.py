"""Normalisation and distances over pair tables (g1, g2, k), all as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expression import parse


def _with_diagonals(pairs: DataFrame, diag: DataFrame) -> DataFrame:
    d = lambda k: diag.select(F.col("gid").alias(f"g{k}"), F.col("k").alias(f"k{k}"))
    return pairs.join(d(1), "g1").join(d(2), "g2")


def mirrored(pairs: DataFrame) -> DataFrame:
    """A table with g1 <= g2 as the full symmetric one."""
    rest = [c for c in pairs.columns if c not in ("g1", "g2")]
    return pairs.unionByName(pairs.where("g1 <> g2").select(F.col("g2").alias("g1"), F.col("g1").alias("g2"), *rest))


def normalize(pairs: DataFrame, diag: DataFrame) -> DataFrame:
    """(g1, g2, k / sqrt(k1 k2))."""
    return _with_diagonals(pairs, diag).select("g1", "g2", (F.col("k") / F.sqrt(F.col("k1") * F.col("k2"))).alias("k"))


def normalize_gradient(pairs: DataFrame, diag: DataFrame) -> DataFrame:
    """As :func:`normalize` with dk arrays, by the quotient rule; a graph with itself has derivative 0."""
    d = lambda k: diag.select(F.col("gid").alias(f"g{k}"), F.col("k").alias(f"k{k}"), F.col("dk").alias(f"d{k}"))
    j = pairs.join(d(1), "g1").join(d(2), "g2").withColumn("_r", F.sqrt(F.col("k1") * F.col("k2"))).withColumn("_h", 0.5 * F.col("k") / F.col("_r"))
    own = F.transform(F.arrays_zip("d1", "d2"), lambda z: F.col("_h") * (z["d1"] / F.col("k1") + z["d2"] / F.col("k2")))
    j = j.withColumn("_g", F.zip_with(F.transform("dk", lambda z: z / F.col("_r")), own, lambda a, b: a - b))
    return j.select("g1", "g2", (F.col("k") / F.col("_r")).alias("k"), F.col("_g").alias("dk"))


def exponentiate(pairs: DataFrame, xi: float) -> DataFrame:
    return pairs.withColumn("k", F.pow("k", F.lit(float(xi))))


def kernel_distance(pairs: DataFrame, diag: DataFrame, *, compat: bool = False) -> DataFrame:
    """(g1, g2, d): sqrt((k1 + k2) / 2 - k), at least 0. ``compat`` uses the single-precision constant."""
    half = 0.4999997 if compat else 0.5
    return _with_diagonals(pairs, diag).select("g1", "g2", F.sqrt(F.greatest(F.lit(0.0), half * (F.col("k1") + F.col("k2")) - F.col("k"))).alias("d"))


def kernel_distance_gradient(pairs: DataFrame, diag: DataFrame, *, compat: bool = False) -> DataFrame:
    """(g1, g2, d, dd): as :func:`kernel_distance` with derivatives from the dk arrays of both tables.

    A distance of 0 has derivative 0; ``compat`` divides by d + 0.0001 everywhere instead.
    """
    d = lambda k: diag.select(F.col("gid").alias(f"g{k}"), F.col("k").alias(f"k{k}"), F.col("dk").alias(f"d{k}"))
    half = 0.4999997 if compat else 0.5
    j = pairs.join(d(1), "g1").join(d(2), "g2").withColumn("d", F.sqrt(F.greatest(F.lit(0.0), half * (F.col("k1") + F.col("k2")) - F.col("k"))))
    slope = 0.5 / (F.col("d") + 1e-4) if compat else F.when(F.col("d") > 0, 0.5 / F.col("d")).otherwise(0.0)
    dd = F.transform(F.arrays_zip("d1", "d2", "dk"), lambda z: (0.5 * z["d1"] + 0.5 * z["d2"] - z["dk"]) * F.col("_s"))
    return j.withColumn("_s", slope).select("g1", "g2", "d", dd.alias("dd"))


def nodal_distances(nodal: DataFrame, diag_nodal: DataFrame, *, scale: float = 1.0, compat: bool = False) -> DataFrame:
    """(g1, g2, n1, n2, d) between nodes; scale sqrt(2) gives the unscaled variant."""
    d = lambda k: diag_nodal.select(F.col("gid").alias(f"g{k}"), F.col("nid").alias(f"n{k}"), F.col("r").alias(f"r{k}"))
    one = 0.9999995 if compat else 1.0
    j = nodal.join(d(1), ["g1", "n1"]).join(d(2), ["g2", "n2"])
    return j.select("g1", "g2", "n1", "n2", (F.sqrt(F.greatest(F.lit(0.0), one - F.col("r") / F.sqrt(F.col("r1") * F.col("r2")))) * scale).alias("d"))


def maximin(distances: DataFrame) -> DataFrame:
    """(g1, g2, d): Hausdorff distance from nodal distances: the largest distance to a nearest node, either way."""
    rows = distances.groupBy("g1", "g2", "n1").agg(F.min("d").alias("d")).groupBy("g1", "g2").agg(F.max("d").alias("a"))
    cols = distances.groupBy("g1", "g2", "n2").agg(F.min("d").alias("d")).groupBy("g1", "g2").agg(F.max("d").alias("b"))
    return rows.join(cols, ["g1", "g2"]).select("g1", "g2", F.greatest("a", "b").alias("d"))


def hotspot(distances: DataFrame, result: DataFrame) -> DataFrame:
    """(g1, g2, n1, n2): the node pair at the distance; of several the last in row order."""
    at = distances.join(result.withColumnRenamed("d", "_d"), ["g1", "g2"]).where(F.col("d") == F.col("_d"))
    return at.groupBy("g1", "g2").agg(F.max(F.struct("n1", "n2")).alias("s")).select("g1", "g2", "s.n1", "s.n2")


def kernel_over_distance(distances: DataFrame, formula: str, **hyper: float) -> DataFrame:
    """(g1, g2, k) from a formula in x, the distance."""
    return distances.select("g1", "g2", parse(formula).column({"x": F.col("d"), **hyper}).alias("k"))
