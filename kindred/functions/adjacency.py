"""Distance to edge weight: compactly supported shapes as Spark columns, with their cutoffs."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A compact shape reaches this many length scales.
REACH = 3


@dataclass(frozen=True)
class Gaussian:
    def column(self, d: Column, scale) -> Column:
        return F.exp(-0.5 * (d / scale) * (d / scale))

    def cutoff(self, scale: float) -> float:
        return math.inf


@dataclass(frozen=True)
class Tent:
    order: int = 1

    def __post_init__(self):
        if self.order < 1:
            raise ValueError("the order of a tent is at least 1")

    def column(self, d: Column, scale) -> Column:
        return F.pow(F.greatest(1 - d / (REACH * scale), F.lit(0.0)), F.lit(float(self.order)))

    def cutoff(self, scale: float) -> float:
        return REACH * scale


@dataclass(frozen=True)
class CompactBell:
    a: float
    b: float

    def __post_init__(self):
        if not (self.a > self.b >= 2):
            raise ValueError("a compact bell has a > b >= 2")

    def column(self, d: Column, scale) -> Column:
        s = F.greatest(1 - d / (REACH * scale), F.lit(0.0))
        a, b = float(self.a), float(self.b)
        return (a * F.pow(s, F.lit(b)) - b * F.pow(s, F.lit(a))) / (a - b)

    def cutoff(self, scale: float) -> float:
        return REACH * scale


def shape(text) -> Gaussian | Tent | CompactBell:
    """'gaussian', 'tent<order>' or 'compactbell<a>,<b>'; shape objects pass."""
    if not isinstance(text, str):
        return text
    if text == "gaussian":
        return Gaussian()
    if m := re.fullmatch(r"tent(\d+)", text):
        return Tent(int(m[1]))
    if m := re.fullmatch(r"compactbell(\d+),(\d+)", text):
        return CompactBell(int(m[1]), int(m[2]))
    raise ValueError(f"not a shape: {text!r}")


def atomic_scale(points: DataFrame, elements: DataFrame, *, column: str = "vdw_radius", zoom: float = 1.0) -> DataFrame:
    """``points`` with ``radius``: an element property in picometres, as angstrom, times zoom. Two atoms' length scale is
    the geometric mean of theirs; the table of elements has at most some hundred rows, hence the broadcast."""
    e = elements.select(F.col("atomic_number").alias("element"), (F.col(column) / 100 * zoom).alias("radius"))
    return points.join(F.broadcast(e), "element", "left")


def atomic_weight(form) -> Column:
    """Weight of an edge between structs a and b with ``radius``, by column ``length``."""
    return shape(form).column(F.col("length"), F.sqrt(F.col("a.radius") * F.col("b.radius")))
