"""Registered queries for the graph engine and the DuckDB SQL each is held against.

All graph queries take every user of ``events`` as a graph, all of its events; vector queries take all ``embeddings``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.adjacency import CompactBell, Gaussian, Tent
from .functions.microkernel import Additive, Constant, Convolution, DotProduct, KroneckerDelta, MicroKernel, Normalize, RationalQuadratic, SquareExponential, TensorProduct
from .operators import graph_ops as G
from .operators import metrics as M
from . import model_queries, search_queries, table_queries
from .operators import fitting, models, sequences
from .plans.checkpoint import checkpointed
from .plans.kernel import TASKS, GraphKernel, pack, walk_similarity
from .sources.graphs import USER_GRAPHS_SQL, edge_list, from_keyed, radius_edges, user_graphs
from .walk_sql import walk_sql

NODE = TensorProduct(lab=KroneckerDelta(0.3), val=SquareExponential(10.0))
EDGE = TensorProduct(len=SquareExponential(10.0))
Q, STEPS = 0.1, 40


def kernel(**options) -> GraphKernel:
    return GraphKernel(NODE, EDGE, q=Q, **options)


def _graphs(spark, d):
    return user_graphs(spark, d)


def _packed(spark, d) -> DataFrame:
    return pack(*_graphs(spark, d))


def _r(name: str, digits: int = 6):
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[_r(c, digits) if c in names else F.col(c) for c in df.columns])


# --------------------------------------------------------------------------- SQL of the walk iteration
def _walk_sql(pairs: str, body: str, steps: int = STEPS) -> str:
    return walk_sql(pairs, body, steps, graphs=USER_GRAPHS_SQL, node=NODE, edge=EDGE, q=Q)


_UPPER, _SAME = "a.gid <= b.gid", "a.gid = b.gid"


# --------------------------------------------------------------------------- graph queries
def graph_kernel_pairs(spark, d):
    return _rounded(kernel().pairs(_packed(spark, d)), "k")


def graph_kernel_walk(spark, d):
    """Every user and the next one, by joins and sums only, to convergence: the form for pairs too large for a task."""
    nodes, edges = _graphs(spark, d)
    return _rounded(walk_similarity(nodes, edges, NODE.column, EDGE.column, q=Q, pairs=_next(spark, d), tol=1e-7), "k", digits=5)


def graph_kernel_diag(spark, d):
    return _rounded(kernel().diag(_packed(spark, d)), "k")


def graph_kernel_nodal(spark, d):
    return _rounded(kernel().diag_nodal(_packed(spark, d)), "r")


def graph_kernel_lmin1(spark, d):
    return _rounded(kernel(lmin=1).diag(_packed(spark, d)), "k")


def graph_kernel_normalized(spark, d):
    return _rounded(kernel().normalized(_packed(spark, d)), "k", digits=5)


def graph_kernel_power(spark, d):
    return _rounded(kernel().normalized(_packed(spark, d), 2.0), "k", digits=5)


def _next(spark, d) -> DataFrame:
    ids = _graphs(spark, d)[0].select("gid").distinct()
    return ids.join(ids.select((F.col("gid") - 1).alias("gid"), F.col("gid").alias("g2")), "gid").select(F.col("gid").alias("g1"), "g2")


def graph_kernel_pair_list(spark, d):
    return _rounded(kernel().listed(_packed(spark, d), _next(spark, d)), "k")


def graph_kernel_cross(spark, d):
    """Even users against odd users."""
    p = _packed(spark, d)
    return _rounded(kernel().pairs(p.where("gid % 2 = 0"), p.where("gid % 2 = 1")), "k")


def kernel_induced_distance(spark, d):
    return _rounded(kernel().distances(_packed(spark, d)), "d", digits=4)


def maximin_distance(spark, d):
    return _rounded(kernel().maximin(_packed(spark, d)), "d", digits=4).where("g1 < g2")


def adjacency_matrix(spark, d):
    return _rounded(G.adjacency_matrix(_graphs(spark, d)[1]), "a")


def laplacian(spark, d):
    return _rounded(G.laplacian(_graphs(spark, d)[1]), "l")


def degree(spark, d):
    return _rounded(G.degree(*_graphs(spark, d)), "d")


def permute(spark, d):
    nodes, edges = _graphs(spark, d)
    size = nodes.groupBy("gid").agg(F.max("nid").alias("m"))
    perm = nodes.join(size, "gid").select("gid", "nid", (F.col("m") - F.col("nid")).alias("pos"))
    return G.permute(nodes, edges, perm)[1].select("gid", "src", "dst", "w")


def tile_count(spark, d):
    return G.tile_count(_graphs(spark, d)[1], 2)


def transition_graph(spark, d):
    return _graphs(spark, d)[1].select("gid", "src", "dst", "w", "len")


def _adjacency(form):
    def query(spark, d):
        e = _graphs(spark, d)[1]
        return e.select("gid", "src", "dst", F.round(form.column(F.col("len"), F.lit(5.0)), 6).alias("w"))

    return query


# --------------------------------------------------------------------------- microkernels over order lines
def _lines(spark, d) -> DataFrame:
    """Each line item with the next one of the same order in full key order."""
    key = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    w = Window.partitionBy("l_orderkey").orderBy(*key)
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", *key, "l_returnflag", "l_quantity", "l_discount")
    pair = li.select("l_orderkey", *key, *[F.col(c).alias(f"x_{c}") for c in ("l_returnflag", "l_quantity", "l_discount")], *[F.lead(c).over(w).alias(f"y_{c}") for c in ("l_returnflag", "l_quantity", "l_discount")])
    return pair.where("y_l_returnflag IS NOT NULL")


_LINES_SQL = """li AS (SELECT *, lead(l_returnflag) OVER w AS y_l_returnflag, lead(l_quantity) OVER w AS y_l_quantity, lead(l_discount) OVER w AS y_l_discount FROM lineitem
 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
pair AS (SELECT *, l_returnflag AS x_l_returnflag, l_quantity AS x_l_quantity, l_discount AS x_l_discount FROM li WHERE y_l_returnflag IS NOT NULL)"""
_SIDES = [{f: f"{s}_l_{c}" for f, c in (("flag", "returnflag"), ("qty", "quantity"), ("disc", "discount"))} for s in "xy"]


def _micro(k: MicroKernel, feature: str | None = None):
    def query(spark, d):
        x, y = ({f: F.col(c) for f, c in s.items()} for s in _SIDES)
        v = k.column(x[feature], y[feature]) if feature else k.column(x, y)
        return _lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round(v, 6) + F.lit(0.0)).alias("k"))

    x, y = _SIDES
    v = k.sql(x[feature], y[feature]) if feature else k.sql(x, y)
    return query, f"WITH {_LINES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({v}, 6) + 0.0 AS k FROM pair"


_DELTA, _SE, _RQ = KroneckerDelta(0.3), SquareExponential(10.0), RationalQuadratic(10.0, 2.0)
MICRO = {
    "mk_constant": _micro(Constant(0.5), "qty"),
    "mk_delta": _micro(_DELTA, "flag"),
    "mk_square_exponential": _micro(_SE, "qty"),
    "mk_rational_quadratic": _micro(_RQ, "qty"),
    "mk_sum": _micro(0.5 * _SE + 0.25, "qty"),
    "mk_product": _micro(_SE * _RQ, "qty"),
    "mk_power": _micro(_RQ**2, "qty"),
    "mk_formula": _micro(MicroKernel.from_formula("cos(a * abs(x - y)) * exp(0 - abs(x - y) / b)", {"a": (0.1, (0.01, 1)), "b": (5.0, (1, 9))}), "qty"),
    "mk_tensor_product": _micro(TensorProduct(flag=_DELTA, qty=_SE, disc=SquareExponential(0.05))),
    "mk_additive": _micro(Additive(flag=_DELTA, qty=_SE)),
    "mk_normalize": _micro(Normalize(Additive(flag=_DELTA, qty=_RQ))),
}


def _next_vectors(spark, d) -> DataFrame:
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").alias("x"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


def mk_dotproduct(spark, d):
    return _next_vectors(spark, d).select("vec_id", F.round(DotProduct().column(F.col("x"), F.col("y")), 6).alias("k"))


_CONV = Convolution(SquareExponential(1.0))


def mk_convolution(spark, d):
    return _next_vectors(spark, d).select("vec_id", F.round(_CONV.column(F.col("x"), F.col("y")), 6).alias("k"))


_VECTORS_SQL = "WITH v AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


# --------------------------------------------------------------------------- models
def label_mask_normalize(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    lab = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    y = docs.join(lab, "doc_id", "left").select(F.col("doc_id").alias("gid"), F.when(F.col("quality").isNotNull(), F.col("n_chars").cast("double")).alias("y"))
    return _rounded(models.masked_targets(y, normalize=True), "y")


def _class_weights(spark, d) -> tuple[DataFrame, DataFrame]:
    """Language and source profiles as points: weights by the difference of their mean length, labels by quality."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "n_chars")
    lab = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    prof = docs.join(lab, "doc_id", "left").groupBy("source").agg(F.avg("n_chars").alias("m"), F.avg("quality").alias("q"))
    a, b = prof.select(F.col("source").alias("i"), F.col("m").alias("a")), prof.select(F.col("source").alias("j"), F.col("m").alias("b"))
    w = a.join(b, F.col("i") != F.col("j")).select("i", "j", F.exp(-F.abs(F.col("a") - F.col("b")) / 1000).alias("w"))
    y = prof.select(F.col("source").alias("gid"), F.when(F.col("source").endswith("1"), F.lit(None)).otherwise(F.col("q")).alias("y"))
    return w, y


_PROFILE_SQL = """prof AS (SELECT source, avg(n_chars) AS m, avg(quality) AS q FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source),
wt AS (SELECT a.source AS i, b.source AS j, exp(-abs(a.m - b.m) / 1000) AS w FROM prof a JOIN prof b ON a.source <> b.source),
y AS (SELECT source AS gid, CASE WHEN source LIKE '%1' THEN NULL ELSE q END AS y FROM prof)"""


def gfr_predict(spark, d):
    return _rounded(models.propagate_labels(*_class_weights(spark, d), smoothing=1e-3), "y", digits=5)


def gfr_loocv_error(spark, d):
    return _rounded(models.label_loo_error(*_class_weights(spark, d), p=2.0), "error")


def rbf_weight(spark, d):
    w = _class_weights(spark, d)[0].select(F.col("i").alias("g1"), F.col("j").alias("g2"), (1 - F.col("w")).alias("d"))
    return _rounded(M.kernel_over_distance(w, "exp(-x**2 / (2 * s**2))", s=0.5), "k")


def _event_sequences(spark, d) -> DataFrame:
    """A symbol per event, one per event type in alphabetical order from A, a sequence per user."""
    ev = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    kinds = ev.select("event_type").distinct().select("event_type", F.char(F.lit(64) + F.rank().over(Window.orderBy("event_type"))).alias("c"))  # as few rows as there are event types
    named = ev.join(F.broadcast(kinds), "event_type").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "c"))).alias("s"))
    return named.select(F.col("user_id").alias("id"), F.array_join(F.col("s.c"), "").alias("s"))


_SEQ_SQL = "kinds AS (SELECT event_type, chr(CAST(64 + row_number() OVER (ORDER BY event_type) AS INTEGER)) AS c FROM (SELECT DISTINCT event_type FROM events)), seq AS (SELECT user_id AS id, string_agg(c, '' ORDER BY ts, event_id) AS s FROM events JOIN kinds USING (event_type) GROUP BY user_id)"
_GRAM_SQL = f"""{_SEQ_SQL}, pos AS (SELECT s, unnest(range(1, length(s) + 1)) AS p FROM seq), ctx AS (SELECT s, p, unnest(range(0, least(2, p - 1) + 1)) AS k FROM pos),
grams AS (SELECT substr(s, p - k, k) AS context, substr(s, p, 1) AS symbol, count(*) AS cnt FROM ctx GROUP BY ALL)"""


def ngram_counts(spark, d):
    return sequences.ngrams(_event_sequences(spark, d), 2)


def ngram_frequency(spark, d):
    return _rounded(sequences.frequencies(sequences.ngrams(_event_sequences(spark, d), 2)), "freq")


def context_match(spark, d):
    s = _event_sequences(spark, d)
    return sequences.match_context(sequences.ngrams(s, 2), s, 2)


def gpr_predict(spark, d):
    """Each user's mean value from the other half's, by the graph kernel."""
    p = _packed(spark, d)
    y = _graphs(spark, d)[0].groupBy("gid").agg(F.avg("val").alias("y"))
    train, rest = p.where("gid % 2 = 0"), p.where("gid % 2 = 1")
    return _rounded(models.IterativeGaussianProcess(alpha=1e-2).fit(kernel().pairs(train), y).predict(kernel().pairs(rest, train)), "y", digits=2)


def nystrom_predict(spark, d):
    p = _packed(spark, d)
    y = _graphs(spark, d)[0].groupBy("gid").agg(F.avg("val").alias("y"))
    core = p.orderBy("gid").limit(16)  # the low-rank form's core points
    cross = kernel().pairs(p, core)
    return _rounded(models.LowRankGaussianProcess(alpha=1e-2).fit(kernel().pairs(core), cross, y).predict(cross), "y", digits=2)


def hierarchical_select(spark, d):
    import numpy as np

    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("gid"), F.col("embedding").alias("v"))
    return models.hierarchical_selection(v, lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1)), 12)


def determinant_select(spark, d):
    import numpy as np

    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("gid"), F.col("embedding").alias("v"))
    return models.hierarchical_selection(v, lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1)), 12, selector=models.determinant_maximizer)


def label_entropy(spark, d):
    return _rounded(models.label_entropy(models.propagate_labels(*_class_weights(spark, d), smoothing=1e-3)), "entropy", digits=4)


def _profile(spark, d):
    """The sources' mean lengths, in thousands, and mean quality: as few rows as there are sources."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "n_chars")
    lab = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    prof = docs.join(lab, "doc_id", "left").groupBy("source").agg((F.avg("n_chars") / 1000).alias("m"), F.avg("quality").alias("q")).orderBy("source")
    if (n := prof.count()) > fitting.FIT_LIMIT:
        raise ValueError(f"{n} sources; the dense models hold {fitting.FIT_LIMIT}")
    t = prof.toPandas()
    return t, t[["m"]].to_numpy()


def gfr_fit_predict(spark, d):
    """Quality of the sources whose name ends in 1, with the weights' scale fitted by the label entropy."""
    t, x = _profile(spark, d)
    y = [None if s.endswith("1") else q for s, q in zip(t["source"], t["q"], strict=True)]
    field = fitting.GaussianField(fitting.PointSimilarity(s=(1.0, (1e-3, 1e3))))
    t["y"] = field.fit_predict(fitting.distances(x, x), y)
    return spark.createDataFrame(t[["source", "y"]])


def outlier_sources(spark, d):
    """Noise deviation of each source's mean quality as a function of its mean length."""
    t, x = _profile(spark, d)
    found = fitting.OutlierDetector(fitting.PointSimilarity(s=(1.0, (0.1, 10.0)))).fit(x, (t["q"] - t["q"].mean()).to_numpy(), w=3.0, repeat=3)
    t = t[t["q"].notna()].assign(sigma=found.y_uncertainty)
    return spark.createDataFrame(t[["source", "sigma"]])


def nystrom_fit(spark, d):
    """Every vector's label from its embedding: low-rank model with a fitted length scale, 16 core points."""
    import numpy as np

    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("gid"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("double").alias("y"))
    core = np.stack([r.v for r in v.orderBy("gid").limit(16).collect()])  # the low-rank form's core points
    similarity, model = fitting.fit_low_rank(fitting.PointSimilarity(s=(1.0, (0.05, 20.0))), core, v, alpha=1e-6)

    def means(batches):
        for t in batches:
            if len(t):
                yield t[["gid"]].assign(y=similarity(np.stack(t["v"].to_numpy()), core) @ model.weights)

    return v.select("gid", "v").mapInPandas(means, "gid long, y double")


def graph_kernel_gradient(spark, d):
    """Each user's self similarity and its derivatives by q, the node and the edge parameters."""
    got = kernel().diag(_packed(spark, d), gradient=True)
    return _rounded(got.select("gid", "k", *[F.col("dk")[n].alias(c) for n, c in enumerate(("dq", "dh", "dval", "dlen"))]), "k", "dq", "dh", "dval", "dlen", digits=4)


def maximin_gradient(spark, d):
    """All pairs of users: distance, the node pair that attains it, derivatives."""
    return kernel().maximin_gradient(_packed(spark, d))


def graph_kernel_pcg(spark, d):
    """Each user's self similarity by conjugate gradients."""
    return _rounded(kernel(solver="pcg").diag(_packed(spark, d)), "k")


def _label_graphs(spark, d) -> tuple[DataFrame, DataFrame]:
    """A graph per label: its vectors as nodes with their fourth coordinate, joined where the first three are near."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").cast("long").alias("gid"), "vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyzv")])
    n = v.withColumn("nid", (F.row_number().over(Window.partitionBy("gid").orderBy("vec_id")) - 1).cast("int"))
    return n.select("gid", "nid", F.round("v", 4).alias("v")), radius_edges(n.select("gid", "nid", "x", "y", "z"), 0.12).select("gid", "src", "dst", "w", F.round("length", 4).alias("length"))


_LABEL_NODE, _LABEL_EDGE = TensorProduct(v=SquareExponential(0.5)), TensorProduct(length=SquareExponential(0.5))


def graph_kernel_large(spark, d):
    """Self similarity of graphs of some fifty nodes and more, whose products are solved without their matrix."""
    packed = checkpointed(pack(*_label_graphs(spark, d)))
    packed = packed.repartition(max(1, min(TASKS, packed.count())))  # a task a graph
    return _rounded(GraphKernel(_LABEL_NODE, _LABEL_EDGE, q=0.3).diag(packed), "k", digits=4)


def graph_kernel_start(spark, d):
    """Each user and the next one, walks starting in proportion to the nodes' mean values."""
    nodes, edges = _graphs(spark, d)
    return _rounded(kernel().listed(pack(nodes, edges, start=F.col("val") / 100), _next(spark, d)), "k")


def graph_kernel_block(spark, d):
    """Each user's nodal self similarities, all nodes by all nodes."""
    r = kernel().diag_block(_packed(spark, d))
    rows = r.select("gid", F.posexplode("r").alias("i", "_r")).select("gid", "i", F.posexplode("_r").alias("j", "r"))
    return _rounded(rows, "r")


def maximin_hotspot(spark, d):
    """The node pair at the Hausdorff distance of each user and the next one."""
    return kernel().hotspots(_packed(spark, d), _next(spark, d))


def minimax_distance(spark, d):
    """The unscaled Hausdorff distance of all pairs of users."""
    return _rounded(kernel().maximin(_packed(spark, d), scale=2**0.5), "d", digits=4).where("g1 < g2")


def graph_edge_list(spark, d):
    """The users' graphs with names for node numbers."""
    return edge_list(*_graphs(spark, d), key="lab").select("gid", "src", "dst", "w", "len")


def periodic_graph(spark, d):
    """A graph per label in a cell of side 1, periodic along two axes."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    points = v.select(F.col("label").alias("gid"), F.col("vec_id").alias("nid"), *[(F.col("embedding")[k].cast("double") - F.floor(F.col("embedding")[k].cast("double"))).alias(c) for k, c in enumerate("xyz")])
    axis = lambda k: F.array(*[F.lit(1.0 if k == n else 0.0) for n in range(3)])
    cells = points.select("gid").distinct().select("gid", *[axis(k).alias(c) for k, c in enumerate("abc")], F.array(F.lit(True), F.lit(True), F.lit(False)).alias("pbc"))
    return _rounded(radius_edges(points, 0.15, cells=cells).select("gid", "src", "dst", "length"), "length", digits=5)


def _reordering(method: str):
    def query(spark, d):
        """What a reordering must keep: a new place for every node, no more tiles and no wider band than before."""
        nodes, edges = (checkpointed(t) for t in _graphs(spark, d))  # each is read several times
        order = checkpointed(G.reorder(nodes, edges, method=method))
        places = order.groupBy("gid").agg(F.count("nid").alias("n"), F.count_distinct("nid").alias("nodes"), F.count_distinct("pos").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"))
        moved = G.permute(nodes, edges, order)[1]
        band = lambda e, c: e.groupBy("gid").agg(F.max(F.abs(F.col("src") - F.col("dst"))).alias(c))
        if method == "rcm":
            wider = band(edges, "_b").join(band(moved, "_a"), "gid").select("gid", (F.col("_a") > F.col("_b")).alias("wider"))
            return places.join(wider, "gid", "left").withColumn("wider", F.coalesce("wider", F.lit(False)))
        before, after = G.tile_count(edges, 2), G.tile_count(moved, 2)
        grown = before.join(after.withColumnRenamed("tiles", "_after"), "gid").select("gid", (F.col("_after") > F.col("tiles")).alias("grown"))
        return places.join(grown, "gid", "left").withColumn("grown", F.coalesce("grown", F.lit(False)))

    return query


def rbf_vectors(spark, d):
    """A formula of the Euclidean distance of each vector and the next."""
    far = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a.cast("double") - b.cast("double")) ** 2), F.lit(0.0), lambda s, z: s + z))
    pairs = _next_vectors(spark, d).select(F.col("vec_id").alias("g1"), (F.col("vec_id") + 1).alias("g2"), far.alias("d"))
    return _rounded(fitting.PointSimilarity("exp(-x**2 / (2 * s**2)) + a * x", s=(1.5, "fixed"), a=(0.25, "fixed")).pairs(pairs), "k")


def user_transitions(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return G.transitions(ev.select(F.col("user_id").alias("gid"), F.row_number().over(order).alias("pos"), F.col("event_type").alias("symbol")))


def flag_graph(spark, d):
    """A graph per order from keyed tables: return flags, joined where lines with them follow each other."""
    lines = _lines(spark, d).select(F.col("l_orderkey").alias("gid"), F.col("x_l_returnflag").alias("src"), F.col("y_l_returnflag").alias("dst"), F.col("x_l_quantity").cast("double").alias("l_quantity"))
    nodes = lines.select("gid", F.explode(F.array("src", "dst")).alias("key")).distinct()
    e = from_keyed(nodes, lines, weight="l_quantity")[1]
    return e.groupBy("gid", "src", "dst").agg(F.sum("w").alias("w"), F.count("*").alias("n"))


def radius_graph(spark, d):
    """A graph per label: vectors as points by their first three coordinates, joined below a distance of 0.15."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    points = v.select(F.col("label").alias("gid"), F.col("vec_id").alias("nid"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    return _rounded(radius_edges(points, 0.15, Tent(1).column(F.col("length"), F.lit(0.05))), "w", "length", digits=5)


def place_tree(spark, d):
    """Regions and their nations as a tree, flattened."""
    region = spark.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return sequences.flatten_tree(region.unionByName(nation))


def sequence_rewrites(spark, d):
    s = _event_sequences(spark, d)
    return sequences.rewrites(sequences.SequenceRewriter(sequences.ngrams(s, 2), n=2), s)


_GFR_SQL = f"""WITH RECURSIVE {_PROFILE_SQL}, w AS (SELECT i, j, w + 1e-3 AS w FROM wt), u AS (SELECT gid AS i FROM y WHERE y IS NULL),
 d AS (SELECT i, sum(w) AS d FROM w JOIN u USING (i) GROUP BY i), b AS (SELECT u.i, coalesce(sum(w * y), 0) AS b FROM u LEFT JOIN w USING (i) LEFT JOIN (SELECT gid AS j, y FROM y WHERE y IS NOT NULL) USING (j) GROUP BY u.i),
 z(k, i, z) AS (SELECT 0, i, b / d FROM b JOIN d USING (i) UNION ALL SELECT k + 1, b.i, (b.b + coalesce(s, 0)) / d.d FROM b JOIN d USING (i) JOIN (SELECT k, w.i, sum(w.w * z.z) AS s FROM z JOIN w ON w.j = z.i JOIN u ON u.i = w.i WHERE k < 200 GROUP BY ALL) t ON t.i = b.i)"""
#: Means by the graph kernel: elimination of the Gramian of the walk iteration's values.
_P_SQL = ", p AS (SELECT g1, g2, sum(x) AS k FROM x GROUP BY g1, g2), pp AS (SELECT g1, g2, k FROM p UNION ALL SELECT g2, g1, k FROM p WHERE g1 <> g2), y AS (SELECT gid, avg(val) AS y FROM nodes GROUP BY gid)"
_GPR_SQL = f"""{_P_SQL}, t AS (SELECT gid, y, row_number() OVER (ORDER BY gid) AS i FROM y WHERE gid % 2 = 0),
{model_queries._eliminate('g', "SELECT a.i, b.i AS j, k + CASE WHEN a.i = b.i THEN 0.01 ELSE 0 END AS v FROM pp JOIN t a ON a.gid = g1 JOIN t b ON b.gid = g2")},
w AS (SELECT g_inv.i, sum(v * y) AS w FROM g_inv JOIN t ON t.i = g_inv.j GROUP BY g_inv.i) SELECT g1, round(sum(k * w), 2) + 0.0 AS y FROM pp JOIN t ON t.gid = g2 JOIN w USING (i) WHERE g1 % 2 = 1 GROUP BY g1"""
_NYSTROM_SQL = f"""{_P_SQL}, c AS (SELECT gid, row_number() OVER (ORDER BY gid) AS i FROM y ORDER BY gid LIMIT 16), r AS (SELECT g1 AS gid, i, k FROM pp JOIN c ON c.gid = g2),
{model_queries._eliminate('a', "SELECT a.i, b.i AS j, sum(a.k * b.k) AS v FROM r a JOIN r b USING (gid) GROUP BY a.i, b.i")},
b AS (SELECT i, sum(k * y) AS b FROM r JOIN y USING (gid) GROUP BY i), w AS (SELECT a_inv.i, sum(v * b) AS w FROM a_inv JOIN b ON b.i = a_inv.j GROUP BY a_inv.i) SELECT gid AS g1, round(sum(k * w), 2) + 0.0 AS y FROM r JOIN w USING (i) GROUP BY gid"""
_OWN_SQL = """, own AS (SELECT g1 AS g, i1 AS n, x AS r FROM x WHERE g1 = g2 AND i1 = i2),
 d AS (SELECT x.g1, x.g2, x.i1, x.i2, round(sqrt(greatest(0, 1 - x.x / sqrt(a.r * b.r))), 7) AS d FROM x JOIN own a ON a.g = x.g1 AND a.n = x.i1 JOIN own b ON b.g = x.g2 AND b.n = x.i2 WHERE x.g1 < x.g2)"""


def _gradient_sql(steps: int = 120) -> str:
    """The walk iteration of each user with itself together with its derivatives by q, the node and the edge parameters."""
    l, h = 10.0, 0.3
    same, val, edge = "CASE WHEN a.lab = b.lab THEN 1.0 ELSE 0.3 END", f"exp(-pow(a.val - b.val, 2) / (2 * {l} * {l}))", f"exp(-pow(a.len - b.len, 2) / (2 * {l} * {l}))"
    names = ("q", "h", "val", "len")
    step = {
        "q": f"p.v / p.d * (s.sq - 2 / {1 - Q!r} * s.s)",
        "h": "p.vh * (1 + s.s / p.d) + p.v / p.d * s.sh",
        "val": "p.vval * (1 + s.s / p.d) + p.v / p.d * s.sval",
        "len": "p.v / p.d * s.slen",
    }
    return f"""WITH RECURSIVE {USER_GRAPHS_SQL},
both_ways AS (SELECT gid, src, dst, w, len FROM edges UNION ALL SELECT gid, dst, src, w, len FROM edges WHERE src <> dst),
deg AS (SELECT n.gid, n.nid, CASE WHEN coalesce(sum(w), 0) = 0 THEN 1.0 ELSE sum(w) END AS d FROM nodes n LEFT JOIN both_ways e ON e.gid = n.gid AND e.src = n.nid GROUP BY ALL),
f AS (SELECT n.*, d FROM nodes n JOIN deg USING (gid, nid)),
pn AS (SELECT a.gid, a.nid AS i1, b.nid AS i2, {same} * {val} AS v, CASE WHEN a.lab = b.lab THEN 0.0 ELSE 1.0 END * {val} AS vh, {same} * {val} * pow(a.val - b.val, 2) / pow({l}, 3) AS vval, a.d * b.d / {(1 - Q) ** 2!r} AS d FROM f a JOIN f b ON a.gid = b.gid),
pe AS (SELECT a.gid, a.src AS i1, b.src AS i2, a.dst AS j1, b.dst AS j2, a.w * b.w * {edge} AS w, a.w * b.w * {edge} * pow(a.len - b.len, 2) / pow({l}, 3) AS wlen FROM both_ways a JOIN both_ways b ON a.gid = b.gid),
it(k, gid, i1, i2, x, xq, xh, xval, xlen) AS (
  SELECT 0, gid, i1, i2, v, 0.0::DOUBLE, vh, vval, 0.0::DOUBLE FROM pn
  UNION ALL
  SELECT s.k + 1, p.gid, p.i1, p.i2, p.v / p.d * (p.d + s.s), {', '.join(step[n] for n in names)}
  FROM pn p JOIN (SELECT k, t.gid, p.i1, p.i2, coalesce(sum(e.w * t.x), 0) AS s, coalesce(sum(e.w * t.xq), 0) AS sq, coalesce(sum(e.w * t.xh), 0) AS sh, coalesce(sum(e.w * t.xval), 0) AS sval, coalesce(sum(e.w * t.xlen + e.wlen * t.x), 0) AS slen
    FROM it t JOIN pe e ON e.gid = t.gid AND e.j1 = t.i1 AND e.j2 = t.i2 JOIN pn p ON p.gid = e.gid AND p.i1 = e.i1 AND p.i2 = e.i2 WHERE k < {steps} GROUP BY ALL) s USING (gid, i1, i2))
SELECT gid, round(sum(x), 4) AS k, round(sum(xq), 4) + 0.0 AS dq, round(sum(xh), 4) + 0.0 AS dh, round(sum(xval), 4) + 0.0 AS dval, round(sum(xlen), 4) + 0.0 AS dlen FROM it WHERE k = {steps} GROUP BY gid"""


_GRADIENT_SQL = _gradient_sql()
_LARGE_SQL = f"""WITH RECURSIVE n AS (SELECT CAST(label AS BIGINT) AS gid, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS nid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, round(CAST(embedding[4] AS DOUBLE), 4) AS v FROM embeddings),
e AS (SELECT a.gid, a.nid AS src, b.nid AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS l FROM n a JOIN n b ON a.gid = b.gid AND a.nid < b.nid),
bw AS (SELECT gid, src, dst, round(l, 4) AS len FROM e WHERE l < 0.12 UNION ALL SELECT gid, dst, src, round(l, 4) FROM e WHERE l < 0.12),
f AS (SELECT n.gid, n.nid, n.v, greatest(count(src), 1) AS d FROM n LEFT JOIN bw ON bw.gid = n.gid AND bw.src = n.nid GROUP BY ALL),
pn AS (SELECT a.gid, a.nid AS i1, b.nid AS i2, exp(-pow(a.v - b.v, 2) / 0.5) AS v, a.d * b.d / 0.49 AS d FROM f a JOIN f b ON a.gid = b.gid),
pe AS (SELECT a.gid, a.src AS i1, b.src AS i2, a.dst AS j1, b.dst AS j2, exp(-pow(a.len - b.len, 2) / 0.5) AS w FROM bw a JOIN bw b ON a.gid = b.gid),
it(k, gid, i1, i2, x) AS (SELECT 0, gid, i1, i2, v FROM pn UNION ALL
 SELECT p.k + 1, p.gid, p.i1, p.i2, p.v / p.d * (p.d + coalesce(s, 0)) FROM (SELECT DISTINCT it.k, pn.* FROM it JOIN pn USING (gid, i1, i2) WHERE k < 40) p
 LEFT JOIN (SELECT e.gid, e.i1, e.i2, sum(e.w * t.x) AS s FROM it t JOIN pe e ON e.gid = t.gid AND e.j1 = t.i1 AND e.j2 = t.i2 GROUP BY ALL) s ON s.gid = p.gid AND s.i1 = p.i1 AND s.i2 = p.i2)
SELECT gid, round(sum(x), 4) AS k FROM it WHERE k = 40 GROUP BY gid"""
Query = Callable[[SparkSession, str], DataFrame]
_T = "WITH " + USER_GRAPHS_SQL
_BOTH = ", s AS (SELECT gid, src, dst, w FROM edges UNION ALL SELECT gid, dst, src, w FROM edges)"

#: name -> (query, SQL or None)
REGISTRY: dict[str, tuple[Query, str | None]] = {
    "graph_kernel_pairs": (graph_kernel_pairs, _walk_sql(_UPPER, "SELECT g1, g2, round(sum(x), 6) AS k FROM x GROUP BY g1, g2")),
    "graph_kernel_walk": (graph_kernel_walk, _walk_sql("a.gid + 1 = b.gid", "SELECT g1, g2, round(sum(x), 5) AS k FROM x GROUP BY g1, g2", 60)),
    "graph_kernel_diag": (graph_kernel_diag, _walk_sql(_SAME, "SELECT g1 AS gid, round(sum(x), 6) AS k FROM x GROUP BY g1")),
    "graph_kernel_nodal": (graph_kernel_nodal, _walk_sql(_SAME, "SELECT g1 AS gid, i1 AS nid, round(x, 6) AS r FROM x WHERE i1 = i2")),
    "graph_kernel_lmin1": (graph_kernel_lmin1, _walk_sql(_SAME, "SELECT g1 AS gid, round(sum(x - v), 6) AS k FROM x GROUP BY g1")),
    "graph_kernel_normalized": (graph_kernel_normalized, _walk_sql(_UPPER, ", p AS (SELECT g1, g2, sum(x) AS k FROM x GROUP BY g1, g2) SELECT p.g1, p.g2, round(p.k / sqrt(a.k * b.k), 5) AS k FROM p JOIN p a ON a.g1 = p.g1 AND a.g2 = p.g1 JOIN p b ON b.g1 = p.g2 AND b.g2 = p.g2")),
    "graph_kernel_power": (graph_kernel_power, _walk_sql(_UPPER, ", p AS (SELECT g1, g2, sum(x) AS k FROM x GROUP BY g1, g2) SELECT p.g1, p.g2, round(p.k * p.k / (a.k * b.k), 5) AS k FROM p JOIN p a ON a.g1 = p.g1 AND a.g2 = p.g1 JOIN p b ON b.g1 = p.g2 AND b.g2 = p.g2")),
    "graph_kernel_pair_list": (graph_kernel_pair_list, _walk_sql("a.gid + 1 = b.gid", "SELECT g1, g2, round(sum(x), 6) AS k FROM x GROUP BY g1, g2")),
    "graph_kernel_cross": (graph_kernel_cross, _walk_sql("a.gid % 2 = 0 AND b.gid % 2 = 1", "SELECT g1, g2, round(sum(x), 6) AS k FROM x GROUP BY g1, g2")),
    "kernel_induced_distance": (kernel_induced_distance, _walk_sql(_UPPER, ", p AS (SELECT g1, g2, sum(x) AS k FROM x GROUP BY g1, g2) SELECT p.g1, p.g2, round(sqrt(greatest(0, CASE WHEN p.g1 = p.g2 THEN 0 ELSE 0.5 * (a.k + b.k) - p.k END)), 4) AS d FROM p JOIN p a ON a.g1 = p.g1 AND a.g2 = p.g1 JOIN p b ON b.g1 = p.g2 AND b.g2 = p.g2")),
    "maximin_distance": (maximin_distance, _walk_sql(_UPPER, """, own AS (SELECT g1 AS g, i1 AS n, x AS r FROM x WHERE g1 = g2 AND i1 = i2),
 d AS (SELECT x.g1, x.g2, x.i1, x.i2, sqrt(greatest(0, 1 - x.x / sqrt(a.r * b.r))) AS d FROM x JOIN own a ON a.g = x.g1 AND a.n = x.i1 JOIN own b ON b.g = x.g2 AND b.n = x.i2 WHERE x.g1 < x.g2),
 r AS (SELECT g1, g2, max(m) AS a FROM (SELECT g1, g2, i1, min(d) AS m FROM d GROUP BY ALL) GROUP BY ALL), c AS (SELECT g1, g2, max(m) AS b FROM (SELECT g1, g2, i2, min(d) AS m FROM d GROUP BY ALL) GROUP BY ALL)
 SELECT g1, g2, round(greatest(a, b), 4) AS d FROM r JOIN c USING (g1, g2)""")),
    "adjacency_matrix": (adjacency_matrix, _T + _BOTH + " SELECT gid, src AS i, dst AS j, round(sum(w), 6) AS a FROM s GROUP BY ALL"),
    "laplacian": (laplacian, _T + _BOTH + ", m AS (SELECT gid, src AS i, dst AS j, sum(w) AS a FROM s GROUP BY ALL), u AS (SELECT gid, j AS i, j, sum(a) AS l FROM m GROUP BY gid, j UNION ALL SELECT gid, i, j, -a FROM m) SELECT gid, i, j, round(sum(l), 6) + 0.0 AS l FROM u GROUP BY ALL"),
    "degree": (degree, _T + ", s AS (SELECT gid, src, w FROM edges UNION ALL SELECT gid, dst, w FROM edges WHERE src <> dst) SELECT n.gid, n.nid, CASE WHEN coalesce(sum(w), 0) = 0 THEN 1.0 ELSE round(sum(w), 6) END AS d FROM nodes n LEFT JOIN s ON s.gid = n.gid AND s.src = n.nid GROUP BY n.gid, n.nid"),
    "permute": (permute, _T + ", m AS (SELECT gid, max(nid) AS m FROM nodes GROUP BY gid) SELECT e.gid, least(m - src, m - dst) AS src, greatest(m - src, m - dst) AS dst, w FROM edges e JOIN m USING (gid)"),
    "tile_count": (tile_count, _T + ", s AS (SELECT gid, src // 2 AS a, dst // 2 AS b FROM edges UNION SELECT gid, dst // 2, src // 2 FROM edges) SELECT gid, count(*) AS tiles FROM s GROUP BY gid"),
    "transition_graph": (transition_graph, _T + " SELECT gid, src, dst, w, len FROM edges"),
    "gaussian_adjacency": (_adjacency(Gaussian()), _T + " SELECT gid, src, dst, round(exp(-0.5 * (len / 5.0) * (len / 5.0)), 6) AS w FROM edges"),
    "tent_adjacency": (_adjacency(Tent(2)), _T + " SELECT gid, src, dst, round(pow(greatest(1 - len / 15.0, 0), 2), 6) AS w FROM edges"),
    "compactbell_adjacency": (_adjacency(CompactBell(3, 2)), _T + ", t AS (SELECT *, greatest(1 - len / 15.0, 0) AS s FROM edges) SELECT gid, src, dst, round(3 * pow(s, 2) - 2 * pow(s, 3), 6) AS w FROM t"),
    **MICRO,
    "mk_dotproduct": (mk_dotproduct, f"{_VECTORS_SQL} SELECT vec_id, round({DotProduct().sql('x', 'y')}, 6) AS k FROM v"),
    "mk_convolution": (mk_convolution, f"{_VECTORS_SQL} SELECT vec_id, round({_CONV.sql('x', 'y')}, 6) AS k FROM v"),
    "label_mask_normalize": (label_mask_normalize, "WITH y AS (SELECT doc_id AS gid, CAST(n_chars AS DOUBLE) AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), m AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM y) SELECT gid, round((y - m) / s, 6) + 0.0 AS y FROM y, m"),
    "gfr_predict": (gfr_predict, _GFR_SQL + " SELECT i AS gid, round(z, 5) AS y FROM z WHERE k = 200"),
    "label_entropy": (label_entropy, _GFR_SQL + " SELECT round(avg(-p * ln(p) - (1 - p) * ln(1 - p)), 4) AS entropy FROM (SELECT least(greatest(z, 1e-7), 1 - 1e-7) AS p FROM z WHERE k = 200)"),
    "gfr_loocv_error": (gfr_loocv_error, f"WITH {_PROFILE_SQL}, k AS (SELECT * FROM y WHERE y IS NOT NULL), m AS (SELECT a.gid, a.y, sum(w * b.y) / sum(w) AS m FROM wt JOIN k a ON a.gid = i JOIN k b ON b.gid = j GROUP BY a.gid, a.y) SELECT round(sqrt(avg((y - m) * (y - m))), 6) AS error FROM m"),
    "rbf_weight": (rbf_weight, f"WITH {_PROFILE_SQL} SELECT i AS g1, j AS g2, round(exp(-(1 - w) * (1 - w) / 0.5), 6) AS k FROM wt"),
    "ngram_counts": (ngram_counts, f"WITH {_GRAM_SQL} SELECT context, symbol, cnt FROM grams"),
    "ngram_frequency": (ngram_frequency, f"WITH {_GRAM_SQL} SELECT context, symbol, cnt, round(cnt / sum(cnt) OVER (PARTITION BY context), 6) AS freq FROM grams"),
    "context_match": (context_match, f"WITH {_GRAM_SQL}, t AS (SELECT id, k, substr(s, length(s) - k + 1, k) AS context FROM (SELECT id, s, unnest(range(0, least(2, length(s)) + 1)) AS k FROM seq)) SELECT id, max_by(context, k) AS context FROM t WHERE context IN (SELECT context FROM grams) GROUP BY id"),
    "user_transitions": (user_transitions, "WITH e AS (SELECT user_id AS gid, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT gid, a, b, count(*) AS w FROM e WHERE b IS NOT NULL GROUP BY ALL"),
    "flag_graph": (flag_graph, f"""WITH {_LINES_SQL}, n AS (SELECT gid, key, CAST(dense_rank() OVER (PARTITION BY gid ORDER BY key) - 1 AS INTEGER) AS nid FROM (SELECT l_orderkey AS gid, x_l_returnflag AS key FROM pair UNION SELECT l_orderkey, y_l_returnflag FROM pair))
 SELECT p.l_orderkey AS gid, least(a.nid, b.nid) AS src, greatest(a.nid, b.nid) AS dst, sum(CAST(l_quantity AS DOUBLE)) AS w, count(*) AS n FROM pair p JOIN n a ON a.gid = l_orderkey AND a.key = x_l_returnflag JOIN n b ON b.gid = l_orderkey AND b.key = y_l_returnflag GROUP BY 1, 2, 3"""),
    "radius_graph": (radius_graph, """WITH p AS (SELECT label AS gid, vec_id AS nid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
 e AS (SELECT a.gid, a.nid AS src, b.nid AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS l FROM p a JOIN p b ON a.gid = b.gid AND a.nid < b.nid)
 SELECT gid, src, dst, round(1 - l / 0.15, 5) AS w, round(l, 5) AS length FROM e WHERE l < 0.15"""),
    "place_tree": (place_tree, "SELECT 'r' || r_regionkey AS id, 0 AS level, 'r' || r_regionkey AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 1, 'r' || n_regionkey || '/n' || n_nationkey FROM nation"),
    "reordered_rcm": (_reordering("rcm"), f"{_T} SELECT gid, count(*) AS n, count(*) AS nodes, count(*) AS places, 0 AS first, CAST(count(*) - 1 AS INTEGER) AS last, false AS wider FROM nodes GROUP BY gid"),
    "reordered_tiles": (_reordering("pbr"), f"{_T} SELECT gid, count(*) AS n, count(*) AS nodes, count(*) AS places, 0 AS first, CAST(count(*) - 1 AS INTEGER) AS last, false AS grown FROM nodes GROUP BY gid"),
    "gpr_predict": (gpr_predict, _walk_sql(_UPPER, _GPR_SQL, 90)),
    "nystrom_predict": (nystrom_predict, _walk_sql(_UPPER, _NYSTROM_SQL, 90)),
    "graph_kernel_pcg": (graph_kernel_pcg, _walk_sql(_SAME, "SELECT g1 AS gid, round(sum(x), 6) AS k FROM x GROUP BY g1")),
    "graph_kernel_large": (graph_kernel_large, _LARGE_SQL),
    "graph_kernel_start": (graph_kernel_start, _walk_sql("a.gid + 1 = b.gid", "SELECT g1, g2, round(sum(x * a.val / 100 * b.val / 100), 6) AS k FROM x JOIN nodes a ON a.gid = g1 AND a.nid = i1 JOIN nodes b ON b.gid = g2 AND b.nid = i2 GROUP BY g1, g2")),
    "graph_kernel_block": (graph_kernel_block, _walk_sql(_SAME, "SELECT g1 AS gid, i1 AS i, i2 AS j, round(x, 6) AS r FROM x")),
    "maximin_hotspot": (maximin_hotspot, _walk_sql("a.gid = b.gid OR a.gid + 1 = b.gid", _OWN_SQL + """,
 r AS (SELECT g1, g2, max(m) AS a FROM (SELECT g1, g2, i1, min(d) AS m FROM d GROUP BY ALL) GROUP BY ALL), c AS (SELECT g1, g2, max(m) AS b FROM (SELECT g1, g2, i2, min(d) AS m FROM d GROUP BY ALL) GROUP BY ALL),
 h AS (SELECT d.g1, d.g2, max({'n1': i1, 'n2': i2}) AS s FROM d JOIN r USING (g1, g2) JOIN c USING (g1, g2) WHERE d = greatest(a, b) GROUP BY ALL) SELECT g1, g2, s.n1 AS n1, s.n2 AS n2 FROM h""", 80)),
    "minimax_distance": (minimax_distance, _walk_sql(_UPPER, _OWN_SQL.replace("round(sqrt", "(sqrt(2) * sqrt").replace(", 7)", ")") + """,
 r AS (SELECT g1, g2, max(m) AS a FROM (SELECT g1, g2, i1, min(d) AS m FROM d GROUP BY ALL) GROUP BY ALL), c AS (SELECT g1, g2, max(m) AS b FROM (SELECT g1, g2, i2, min(d) AS m FROM d GROUP BY ALL) GROUP BY ALL) SELECT g1, g2, round(greatest(a, b), 4) AS d FROM r JOIN c USING (g1, g2)""")),
    "graph_edge_list": (graph_edge_list, _T + " SELECT e.gid, a.lab AS src, b.lab AS dst, w, len FROM edges e JOIN nodes a ON a.gid = e.gid AND a.nid = src JOIN nodes b ON b.gid = e.gid AND b.nid = dst"),
    "periodic_graph": (periodic_graph, """WITH v AS (SELECT label AS gid, vec_id AS nid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), p AS (SELECT gid, nid, x - floor(x) AS x, y - floor(y) AS y, z - floor(z) AS z FROM v),
 s AS (SELECT unnest([-1, 0, 1]) AS s), e AS (SELECT a.gid, a.nid AS src, b.nid AS dst, min(sqrt(pow(a.x - b.x - i.s, 2) + pow(a.y - b.y - j.s, 2) + pow(a.z - b.z, 2))) AS length FROM p a JOIN p b ON a.gid = b.gid AND a.nid < b.nid JOIN s i ON true JOIN s j ON true GROUP BY ALL)
 SELECT gid, src, dst, round(length, 5) AS length FROM e WHERE length < 0.15"""),
    "rbf_vectors": (rbf_vectors, f"{_VECTORS_SQL} SELECT vec_id AS g1, vec_id + 1 AS g2, round(exp(-d * d / (2 * 1.5 * 1.5)) + 0.25 * d, 6) + 0.0 AS k FROM (SELECT vec_id, sqrt(list_sum(list_transform(x, lambda a, i: pow(CAST(a AS DOUBLE) - CAST(y[i] AS DOUBLE), 2)))) AS d FROM v)"),
    "hierarchical_select": (hierarchical_select, None),
    "determinant_select": (determinant_select, None),
    "nystrom_fit": (nystrom_fit, None),
    "gfr_fit_predict": (gfr_fit_predict, None),
    "outlier_sources": (outlier_sources, None),
    "graph_kernel_gradient": (graph_kernel_gradient, _GRADIENT_SQL),
    "maximin_gradient": (maximin_gradient, None),
    "sequence_rewrites": (sequence_rewrites, None),
    **model_queries.REGISTRY,
    **search_queries.REGISTRY,
    **table_queries.REGISTRY,
}

QUERIES: dict[str, Query] = {k: q for k, (q, _) in REGISTRY.items()}
ORACLES: dict[str, str] = {k: s for k, (_, s) in REGISTRY.items() if s}
