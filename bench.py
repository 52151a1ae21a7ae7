"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from kindred import queries
from kindred.functions.microkernel import KroneckerDelta, SquareExponential, TensorProduct
from kindred.plans.kernel import GraphKernel, pack

HEADLINE = ["graph_kernel_diag", "graph_kernel_gradient", "graph_kernel_pair_list", "adjacency_matrix", "laplacian", "mk_tensor_product", "mk_normalize", "ngram_frequency", "gfr_loocv_error"]


def small_world(spark: SparkSession, count: int, n: int = 48, k: int = 5, p: float = 0.05):
    """The reference configuration: rings of 48 nodes with neighbours up to k // 2 steps away and added chords, labelled
    nodes and edges, weights 1 to 4."""
    r = np.random.default_rng(0)
    nodes, edges = [], []
    for g in range(count):
        ring = [(i, (i + s) % n) for i in range(n) for s in range(1, k // 2 + 1)]
        chords = [(i, int(r.integers(n))) for i, _ in ring if r.random() < p]
        ends = {(min(e), max(e)) for e in ring + chords if e[0] != e[1]}
        nodes += [(g, i, int(r.integers(3)), float(r.random())) for i in range(n)]
        edges += [(g, i, j, float(r.integers(1, 5)), float(r.random())) for i, j in sorted(ends)]
    return pack(
        spark.createDataFrame(pd.DataFrame(nodes, columns=["gid", "nid", "kind", "radius"])),
        spark.createDataFrame(pd.DataFrame(edges, columns=["gid", "src", "dst", "w", "length"])),
    )


KERNEL = GraphKernel(TensorProduct(kind=KroneckerDelta(0.5), radius=SquareExponential(0.5)), TensorProduct(length=SquareExponential(0.5)), q=0.05)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def run(name, make):
        start = time.time()
        make().write.format("noop").mode("overwrite").save()  # a count would leave the values out
        took[name] = round(time.time() - start, 3)

    for name in HEADLINE:
        run(name, lambda name=name: queries.QUERIES[name](spark, sf))
    rates = {}
    for count, block in ((1, 1), (16, 4), (128, 16)):
        x = small_world(spark, count).cache()
        x.count()
        run(f"small_world_{count}", lambda x=x, block=block: KERNEL.pairs(x, block=block))
        rates[f"pairs_per_second_{count}"] = round(count * (count + 1) / 2 / took[f"small_world_{count}"], 1)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, **rates}))


if __name__ == "__main__":
    main()
