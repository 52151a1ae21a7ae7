"""Queries of the plain table operations: columns, masks, rows, types and their unification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.microkernel import Constant, KroneckerDelta, Normalize, Product, SquareExponential, TensorProduct
from .operators import graph_ops as G
from .operators import metrics as M
from .sources.graphs import unify


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def table_column(spark, d):
    return _table(spark, d, "orders").select(F.col("o_orderkey"))


def table_select(spark, d):
    return _table(spark, d, "lineitem")[["l_orderkey", "l_quantity"]]


def table_mask(spark, d):
    t = _table(spark, d, "lineitem")
    return t[(t.l_quantity > 30) & (t.l_returnflag == "R")].select("l_orderkey", "l_linenumber", "l_quantity")


def table_assign(spark, d):
    """A new column and one that replaces another."""
    t = _table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return t.withColumn("n_code", F.col("n_regionkey") * 100 + F.col("n_nationkey")).withColumn("n_regionkey", F.col("n_regionkey") + 1)


def table_drop(spark, d):
    """Unknown names are passed over."""
    return _table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").drop("n_regionkey", "no_such_column")


def table_rows(spark, d):
    """Row by row, as a stream of partitions: a running number over the keys in order."""
    t = _table(spark, d, "orders").select("o_orderkey").repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey")

    def rows(batches):
        for b in batches:
            b["is_odd"] = [bool(r.o_orderkey % 2) for r in b.itertuples(index=False)]
            yield b

    return t.mapInPandas(rows, "o_orderkey long, is_odd boolean")


def table_info(spark, d):
    """Number of rows and columns, and whether a column is there."""
    t = _table(spark, d, "region").select("r_regionkey", "r_name")
    return t.agg(F.count("*").alias("rows")).select("rows", F.lit(len(t.columns)).alias("columns"), F.lit("r_name" in t.columns).alias("has_name"), F.lit("r_none" in t.columns).alias("has_none"))


def table_rowtype(spark, d):
    t = _table(spark, d, "region").select(F.col("r_regionkey").cast("long"), "r_name", F.lit(1.5).alias("x"), F.array(F.lit(1)).alias("a"))
    return spark.createDataFrame([(n + 1, f.name, f.dataType.simpleString()) for n, f in enumerate(t.schema)], "position int, name string, type string")


def table_copy(spark, d):
    """A frame is not changed by what is derived from it."""
    t = _table(spark, d, "region").select("r_regionkey", "r_name")
    changed = t.withColumn("r_name", F.upper(F.reverse("r_name")))
    return t.join(changed.withColumnRenamed("r_name", "changed"), "r_regionkey")


def table_series(spark, d):
    """A column with a type of its own, used by itself."""
    column = F.col("s_acctbal").cast("double")
    return _table(spark, d, "supplier").select("s_suppkey", F.round(column * column, 2).alias("squared"))


def table_unify(spark, d):
    """Two tables of unlike types under their common ones."""
    a = _table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_regionkey").cast("smallint").alias("v"), F.array(F.col("n_regionkey").cast("int")).alias("a"))
    b = _table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k"), (F.col("r_regionkey") + 0.5).cast("double").alias("v"), F.array(F.col("r_regionkey").cast("double")).alias("a"))
    x, y = unify(a, b)
    assert x.dtypes == y.dtypes
    return x.unionByName(y).select("k", "v", F.col("a")[0].alias("a"))


def graph_copy(spark, d):
    """A table of edges and one derived from it stand side by side."""
    e = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gid"), F.col("l_linenumber").alias("src"), (F.col("l_linenumber") + 1).alias("dst"), F.lit(1.0).alias("w"))
    return e.withColumn("twice", F.col("w") * 2).join(e.groupBy("gid").agg(F.count("*").alias("n")), "gid")


def ring_lists(spark, d):
    """Sorted sizes of the rings through each part: an order's lines form a ring, a part's lines its nodes."""
    li = _table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("gid"), F.col("l_partkey").cast("long").alias("nid"), "l_orderkey")
    rings = li.join(li.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("size")), "l_orderkey").select("gid", "nid", "size")
    nodes = _table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("gid"), F.lit(1).cast("long").alias("nid")).unionByName(rings.select("gid", "nid")).distinct()
    out = G.ring_lists(nodes, rings)
    return out.select("gid", "nid", F.array_join(F.transform("ring_list", lambda x: x.cast("string")), ",").alias("ring_list"))


def mk_plain_product(spark, d):
    """The product of two numbers as a microkernel."""
    li = _table(spark, d, "lineitem")
    x, y = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(Product().column(x, y), 4).alias("k"))


def mk_hyperparameters(spark, d):
    """A composed microkernel of consecutive suppliers' nations and balances, before and after a change of all its parameters,
    the parameters as it then reports them, and whether the value lies in the range it reports."""
    k = Normalize(TensorProduct(a=KroneckerDelta(0.3), b=SquareExponential(2.0, (0.5, 8.0))) + Constant(0.5, (0.1, 1.0)))
    moved = k.with_theta([0.25, 4.0, 0.125])
    s = _table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("gid"), F.col("s_nationkey").alias("a"), (F.col("s_acctbal").cast("double") / 1000).alias("b"))
    near = s.join(s.select((F.col("gid") - 1).alias("gid"), F.col("gid").alias("g2"), F.col("a").alias("a2"), F.col("b").alias("b2")), "gid")
    x, y = {"a": F.col("a"), "b": F.col("b")}, {"a": F.col("a2"), "b": F.col("b2")}
    after = moved.column(x, y)
    named = [F.lit(float(t)).alias(n) for n, t in zip(("h", "s", "c"), moved.theta, strict=True)]
    least = [F.lit(float(b[0])).alias(f"least_{n}") for n, b in zip(("h", "s", "c"), moved.bounds, strict=True)]
    low, high = map(float, moved.minmax)
    return near.select(F.col("gid").alias("g1"), "g2", F.round(k.column(x, y), 5).alias("before"), F.round(after, 5).alias("after"), *named, *least, after.between(low, high).alias("inside"))


def distance_gradient(spark, d):
    """The kernel distance of consecutive suppliers by the length scale of their similarity 2 exp(-x^2 / 2 s^2) of account balances."""
    s = _table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("gid"), (F.col("s_acctbal").cast("double") / 1000).alias("v"))
    near = s.withColumnsRenamed({"gid": "g1", "v": "a"}).join(s.select((F.col("gid") - 1).alias("g1"), F.col("gid").alias("g2"), F.col("v").alias("b")), "g1")
    x2 = (F.col("a") - F.col("b")) ** 2
    pairs = near.select("g1", "g2", (2 * F.exp(-x2 / 8)).alias("k"), F.array(2 * F.exp(-x2 / 8) * x2 / 8).alias("dk"))
    diag = s.select("gid", F.lit(2.0).alias("k"), F.array(F.lit(0.0)).alias("dk"))
    got = M.kernel_distance_gradient(pairs, diag)
    return got.select("g1", "g2", F.round("d", 5).alias("d"), (F.round(F.col("dd")[0], 4) + F.lit(0.0)).alias("dd"))


Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {
    "table_column": (table_column, "SELECT o_orderkey FROM orders"),
    "table_select": (table_select, "SELECT l_orderkey, l_quantity FROM lineitem"),
    "table_mask": (table_mask, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'"),
    "table_assign": (table_assign, "SELECT n_nationkey, n_regionkey + 1 AS n_regionkey, n_regionkey * 100 + n_nationkey AS n_code FROM nation"),
    "table_drop": (table_drop, "SELECT n_nationkey, n_name FROM nation"),
    "table_rows": (table_rows, "SELECT o_orderkey, o_orderkey % 2 = 1 AS is_odd FROM orders"),
    "table_info": (table_info, "SELECT count(*) AS rows, 2 AS columns, true AS has_name, false AS has_none FROM region"),
    "table_rowtype": (table_rowtype, "SELECT * FROM (VALUES (1, 'r_regionkey', 'bigint'), (2, 'r_name', 'string'), (3, 'x', 'double'), (4, 'a', 'array<int>')) t(position, name, type)"),
    "table_copy": (table_copy, "SELECT r_regionkey, r_name, upper(reverse(r_name)) AS changed FROM region"),
    "table_series": (table_series, "SELECT s_suppkey, round(CAST(s_acctbal AS DOUBLE) * CAST(s_acctbal AS DOUBLE), 2) AS squared FROM supplier"),
    "table_unify": (table_unify, "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS DOUBLE) AS v, CAST(n_regionkey AS DOUBLE) AS a FROM nation UNION ALL SELECT r_regionkey, r_regionkey + 0.5::DOUBLE, CAST(r_regionkey AS DOUBLE) FROM region"),
    "graph_copy": (graph_copy, "SELECT l_orderkey AS gid, l_linenumber AS src, l_linenumber + 1 AS dst, 1.0::DOUBLE AS w, 2.0::DOUBLE AS twice, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"),
    "ring_lists": (ring_lists, "WITH li AS (SELECT l_suppkey AS gid, l_partkey AS nid, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem), n AS (SELECT s_suppkey AS gid, 1 AS nid FROM supplier UNION SELECT gid, nid FROM li) SELECT n.gid, n.nid, coalesce(string_agg(CAST(size AS VARCHAR), ',' ORDER BY size), '0') AS ring_list FROM n LEFT JOIN li ON li.gid = n.gid AND li.nid = n.nid GROUP BY n.gid, n.nid"),
    "mk_plain_product": (mk_plain_product, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CAST(l_quantity AS DOUBLE) * CAST(l_discount AS DOUBLE), 4) AS k FROM lineitem"),
    "mk_hyperparameters": (mk_hyperparameters, """WITH s AS (SELECT s_suppkey AS gid, s_nationkey AS a, CAST(s_acctbal AS DOUBLE) / 1000 AS b FROM supplier),
 p AS (SELECT x.gid AS g1, y.gid AS g2, x.a = y.a AS same, pow(x.b - y.b, 2) AS d FROM s x JOIN s y ON y.gid = x.gid + 1)
 SELECT g1, g2, round((CASE WHEN same THEN 1 ELSE 0.3 END * exp(-d / 8) + 0.5) / 1.5, 5) AS before, round((CASE WHEN same THEN 1 ELSE 0.25 END * exp(-d / 32) + 0.125) / 1.125, 5) AS after,
  0.25::DOUBLE AS h, 4.0::DOUBLE AS s, 0.125::DOUBLE AS c, 0.001::DOUBLE AS least_h, 0.5::DOUBLE AS least_s, 0.1::DOUBLE AS least_c, true AS inside FROM p"""),
    "distance_gradient": (distance_gradient, """WITH s AS (SELECT s_suppkey AS gid, CAST(s_acctbal AS DOUBLE) / 1000 AS v FROM supplier), p AS (SELECT a.gid AS g1, b.gid AS g2, pow(a.v - b.v, 2) AS x FROM s a JOIN s b ON b.gid = a.gid + 1),
 k AS (SELECT *, 2 * exp(-x / 8) AS k FROM p), e AS (SELECT *, sqrt(greatest(0, 2 - k)) AS d FROM k) SELECT g1, g2, round(d, 5) AS d, CASE WHEN d > 0 THEN round(-k * x / 8 * 0.5 / d, 4) + 0.0 ELSE 0 END AS dd FROM e"""),
}
