"""Queries of the dense and low-rank models, selection and linear algebra, over the sources of ``documents`` as points.

A source has as its place the mean length of its documents in thousands and as its value their mean quality; there are
as few points as sources. Sources whose name ends in 1 are predicted, the others train. The SQL solves the same systems
by Gauss-Jordan elimination over lists of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import exact_gp, fitting, linalg, models, selection, tall

SCALE, ALPHA, CORE = 0.2, 0.1, 5
SIMILARITY = fitting.PointSimilarity(s=(SCALE, "fixed"))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "n_chars")
    lab = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    return docs.join(lab, "doc_id", "left").groupBy(F.col("source").alias("gid")).agg((F.avg("n_chars") / 1000).alias("m"), F.avg("quality").alias("y"))


def _points(spark, d) -> tuple[DataFrame, DataFrame]:
    """(all sources, the training ones)."""
    p = _profiles(spark, d)
    return p, p.where("y IS NOT NULL AND NOT endswith(gid, '1')")


def _pairs(a: DataFrame, b: DataFrame, upper: bool = False) -> DataFrame:
    x, y = a.select(F.col("gid").alias("g1"), F.col("m").alias("a")), b.select(F.col("gid").alias("g2"), F.col("m").alias("b"))
    both = x.join(y, F.col("g1") <= F.col("g2")) if upper else x.crossJoin(y)  # as few rows as there are sources
    return SIMILARITY.pairs(both.select("g1", "g2", F.abs(F.col("a") - F.col("b")).alias("d")))


def _rounded(df: DataFrame, *names: str, digits: int = 5) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


def _ones(p: DataFrame) -> DataFrame:
    return p.select("gid", F.lit(1.0).alias("k"))


def _dense(spark, d, how: str = "+"):
    p, t = _points(spark, d)
    return p, t, models.GaussianProcess(alpha=ALPHA, regularization=how).fit(_pairs(t, t, upper=True), t.select("gid", "y"))


def _low_rank(spark, d):
    p, t = _points(spark, d)
    core = t.orderBy("gid").limit(CORE)  # the low-rank form's core points
    return p, t, core, models.LowRankGaussianProcess(alpha=ALPHA).fit(_pairs(core, core, upper=True), _pairs(t, core), t.select("gid", "y"))


def gp_predict_std(spark, d):
    p, t, model = _dense(spark, d)
    return _rounded(model.predict_std(_pairs(p, t), _ones(p)), "y", "std")


def gp_predict_cov(spark, d):
    """Posterior covariance of all pairs of sources."""
    p, t, model = _dense(spark, d)
    return _rounded(model.predict_cov(_pairs(p, t), _pairs(p, p, upper=True)), "cov")


def gp_gramian(spark, d):
    t = _points(spark, d)[1]
    return _rounded(models.regularize(_pairs(t, t, upper=True), ALPHA, "*"), "k")


def gp_loocv(spark, d):
    _, _, model = _dense(spark, d)
    y, std = model.leave_one_out()
    return _rounded(spark.createDataFrame(pd.DataFrame({"gid": model.ids, "y": y, "std": std})), "y", "std")


def gp_objective(spark, d):
    """Both losses that hyperparameters are fitted to, under both regularisations (the same where the diagonal is 1)."""
    rows = []
    for how in "+*":
        model = _dense(spark, d, how)[2]
        rows.append((how, float(model.objective()), model.squared_loo_error()))
    return _rounded(spark.createDataFrame(rows, "how string, objective double, loo double"), "objective", "loo", digits=4)


def nystrom_predict_std(spark, d):
    p, _, core, model = _low_rank(spark, d)
    return _rounded(model.predict_std(_pairs(p, core), _ones(p)), "y", "std")


def nystrom_predict_cov(spark, d):
    p, _, core, model = _low_rank(spark, d)
    return _rounded(model.predict_cov(_pairs(p, core), _pairs(p, p, upper=True)), "cov")


def nystrom_loocv(spark, d):
    _, t, core, model = _low_rank(spark, d)
    return _rounded(model.leave_one_out(_pairs(t, core), t.select("gid", "y"), "ridge-like").select("g1", "y"), "y")


def nystrom_objective(spark, d):
    return _rounded(spark.createDataFrame([(_low_rank(spark, d)[3].objective(),)], "objective double"), "objective", digits=4)


def _local(spark, d) -> tuple[list, np.ndarray, np.ndarray]:
    """Training names, values and regularised Gramian; as few as there are sources."""
    p, t = _points(spark, d)
    ids, k = models.dense(models.regularize(_pairs(t, t, upper=True), ALPHA))
    y = {r.gid: r.y for r in t.select("gid", "y").collect()}
    return ids, np.array([y[i] for i in ids]), k


def _matrix(spark, named: dict[str, np.ndarray]) -> DataFrame:
    rows = [(name, i + 1, j + 1, float(v)) for name, m in named.items() for (i, j), v in np.ndenumerate(m)]
    return _rounded(spark.createDataFrame(rows, "method string, i long, j long, v double"), "v")


def la_inverse(spark, d):
    """One matrix inverted in five ways, and a low-rank matrix plus a diagonal."""
    _, _, k = _local(spark, d)
    inner = np.linalg.inv(k[:-1, :-1])
    return _matrix(spark, {
        "cholesky": linalg.inverse(k, 1e-8)[0],
        "pseudo": linalg.pinvh(k)[0],
        "power": linalg.powerh(k, -1.0),
        "bordered": linalg.bordered_inverse(inner, k[:-1, -1], k[-1, -1]),
        "shifted": linalg.shifted_pinvh(linalg.LowRank(k[:, :3]), np.full(len(k), 0.5)),
    })


def la_solve(spark, d):
    _, y, k = _local(spark, d)
    rows = [(name, i + 1, float(x)) for name, got in (("cholesky", linalg.chol_solve(k, y)), ("gradients", linalg.cg_solve(k, y))) for i, x in enumerate(got)]
    return _rounded(spark.createDataFrame(rows, "method string, i long, x double"), "x")


def la_low_rank(spark, d):
    """What the tall-factor forms give without their dense matrices; A = U U', B = U V' with three columns each."""
    _, y, k = _local(spark, d)
    a, b = linalg.LowRank(k[:, :3]), linalg.LowRank(k[:, :3], k[:, 3:6])
    total = lambda m: float(m.todense().sum())
    values = {
        "trace": b.trace(), "quadratic": float(b.quadratic(y, y)), "transposed": float(b.T.quadratic(y, np.ones(len(y)))), "sum": total(a + b), "difference": total(a - b),
        "negative": total(-b), "product": total(a @ b), "applied": float((b @ y).sum()), "diagonal": float((b.diagonal() ** 2).sum()), "logdet": a.logdet(), "square": (a**2).trace(), "pseudo": (a @ a.pinv() @ a).trace(),
    }
    return _rounded(spark.createDataFrame([(n, float(v)) for n, v in values.items()], "name string, value double"), "value", digits=4)


def field_influence(spark, d):
    """How much each training source's label counts in each unlabelled one's."""
    rows = _points(spark, d)[0].orderBy("gid").collect()  # as few as there are sources
    x = np.array([[r.m] for r in rows])
    y = [None if r.gid.endswith("1") else r.y for r in rows]
    field = fitting.GaussianField(SIMILARITY, smoothing=1e-3)
    filled, reach = field.predict(fitting.distances(x, x), y, influence=True)
    names = [[r.gid for r, v in zip(rows, y, strict=True) if (v is None) == lacks] for lacks in (True, False)]
    out = [(u, k, float(reach[i, j])) for i, u in enumerate(names[0]) for j, k in enumerate(names[1])]
    return _rounded(spark.createDataFrame(out, "i string, j string, w double"), "w")


def _select(selector):
    def query(spark, d):
        ids, _, k = _local(spark, d)
        return spark.createDataFrame([(n + 1, ids[i]) for n, i in enumerate(selector(k, 4))], "step int, gid string")

    return query


WIDE, SHIFT = 12, 0.5


def tall_pseudoinverse(spark, d):
    """The labels times the pseudoinverse of F F', F being the first components of all vectors; a shifted solve beside it."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    got = tall.TallFactor(v.select(F.col("vec_id").alias("gid"), F.slice("embedding", 1, WIDE).alias("f")), WIDE)
    y = v.select(F.col("vec_id").alias("gid"), F.col("label").cast("double").alias("y"))
    shifted, logdet = got.shifted_solve(y, SHIFT)
    both = got.pinv_times(y).join(shifted.withColumnRenamed("z", "shifted"), "gid")
    return _rounded(both.select(F.col("gid").alias("vec_id"), F.col("z").alias("pseudo"), "shifted", F.lit(got.logdet).alias("logdet"), F.lit(logdet).alias("shifted_logdet")), "pseudo", "shifted", "logdet", "shifted_logdet", digits=4)


NEAR, SMOOTH = 8, 1e-3


def propagate_quality(spark, d):
    """Quality of the documents without a label, from those next to them: NEAR consecutive ids form a chain whose weights
    fall with the ratio of lengths."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.log(1.0 + F.coalesce("n_chars", F.lit(0))).alias("s"))
    lab = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    order = Window.partitionBy(F.floor(F.col("doc_id") / NEAR)).orderBy("doc_id")
    links = docs.select("doc_id", F.lead("doc_id").over(order).alias("j"), (1 / (1 + F.abs(F.lead("s").over(order) - F.col("s")))).alias("w")).where("j IS NOT NULL")
    weights = links.select(F.col("doc_id").alias("i"), "j", "w").unionByName(links.select(F.col("j").alias("i"), F.col("doc_id").alias("j"), "w"))
    y = docs.join(lab, "doc_id", "left").select(F.col("doc_id").alias("gid"), F.col("quality").cast("double").alias("y"))
    got = models.propagate_labels(weights, y, smoothing=SMOOTH, tol=1e-7)
    return _rounded(got.select(F.col("gid").alias("doc_id"), F.col("y").alias("quality")), "quality", digits=4)


#: On a chain the values between two labels follow the resistance, the sum of 1 / weight, on either side.
_CHAIN = f"""WITH a AS (SELECT doc_id, doc_id // {NEAR} AS g, ln(1.0::DOUBLE + coalesce(n_chars, 0)) AS s, CAST(quality AS DOUBLE) AS y FROM documents LEFT JOIN labels USING (doc_id)),
b AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, coalesce(1 / (1 / (1 + abs(s - lag(s) OVER (PARTITION BY g ORDER BY doc_id))) + {SMOOTH}), 0) AS r FROM a),
c AS (SELECT *, sum(r) OVER (PARTITION BY g ORDER BY doc_id) AS way FROM b),
e AS (SELECT *, last_value(y IGNORE NULLS) OVER p AS yl, last_value(CASE WHEN y IS NOT NULL THEN way END IGNORE NULLS) OVER p AS rl, first_value(y IGNORE NULLS) OVER q AS yr, first_value(CASE WHEN y IS NOT NULL THEN way END IGNORE NULLS) OVER q AS rr
 FROM c WINDOW p AS (PARTITION BY g ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY g ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT doc_id, CASE WHEN n > 1 THEN round(coalesce(yl + (yr - yl) * (way - rl) / (rr - rl), yl, yr, 0), 4) + 0.0 END AS quality FROM e WHERE y IS NULL"""

PICKS, SPREAD, NOISE = 12, 0.6, 0.1


def _vectors(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("gid"), F.col("embedding").alias("v"))


def _selected(got: selection.Selection) -> DataFrame:
    return _rounded(got.points.select(F.col("gid").alias("vec_id"), "step", "residual"), "residual", digits=4)


def determinant_select_vectors(spark, d):
    """All vectors with the step at which they were chosen and the variance that the chosen leave them."""
    k = selection.Gaussian(SPREAD)
    return _selected(selection.select_by_determinant(_vectors(spark, d), k, k.variance, PICKS))


def variance_select_vectors(spark, d):
    k = selection.Gaussian(SPREAD)
    return _selected(selection.select_by_variance(_vectors(spark, d), k, k.variance, PICKS, alpha=NOISE))


REACH, JITTER, COLUMNS = 2.0, 0.2, 60


def exact_gp_weights(spark, d):
    """Each conversation's weight in the mean, and the mean there: turns by the logarithms of what users and others wrote."""
    t = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("gid"), "role", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    wrote = lambda own: F.log(1.0 + F.sum(F.when((F.col("role") == "user") == own, F.col("n")).otherwise(0)))
    points = t.groupBy("gid").agg(F.array(wrote(True), wrote(False)).alias("v"), F.log(1.0 + F.count("*")).alias("y"))
    model = exact_gp.ExactGaussianProcess(selection.Gaussian(REACH), JITTER, rank=COLUMNS, probes=0).fit(points.select("gid", "v"), points.select("gid", "y"))
    got = model.weights.join(model.known.select("gid", "y"), "gid")
    return _rounded(got.select(F.col("gid").alias("conv_id"), F.col("w").alias("weight"), (F.col("y") - JITTER * F.col("w")).alias("mean")), "weight", "mean", digits=4)


_EXACT = f"""WITH RECURSIVE t AS (SELECT gid, a, b, y, row_number() OVER (ORDER BY gid) AS i FROM (
 SELECT conv_id AS gid, ln(1.0::DOUBLE + sum(CASE WHEN role = 'user' THEN coalesce(length(text), 0) ELSE 0 END)) AS a, ln(1.0::DOUBLE + sum(CASE WHEN role <> 'user' THEN coalesce(length(text), 0) ELSE 0 END)) AS b, ln(1.0::DOUBLE + count(*)) AS y FROM conversations GROUP BY conv_id)), """


def _exact_sql() -> str:
    gram = f"SELECT a.i, b.i AS j, exp(-(pow(a.a - b.a, 2) + pow(a.b - b.b, 2)) / {2 * REACH**2!r}) + CASE WHEN a.i = b.i THEN {JITTER} ELSE 0 END AS v FROM t a JOIN t b ON true"
    return f"{_EXACT}{_eliminate('g', gram)}, w AS (SELECT g_inv.i, sum(v * y) AS w FROM g_inv JOIN t ON t.i = g_inv.j GROUP BY g_inv.i) SELECT gid AS conv_id, round(w, 4) + 0.0 AS weight, round(y - {JITTER} * w, 4) + 0.0 AS mean FROM w JOIN t USING (i)"


def _tall_sql() -> str:
    inner = lambda shift: f"SELECT x.i, y.i AS j, sum(x.f * y.f) + CASE WHEN x.i = y.i THEN {shift} ELSE 0 END AS v FROM r x JOIN r y USING (gid) GROUP BY x.i, y.i"
    return f"""WITH RECURSIVE r AS (SELECT vec_id AS gid, CAST(label AS DOUBLE) AS y, i, CAST(embedding[i] AS DOUBLE) AS f FROM embeddings, (SELECT unnest(range(1, {WIDE + 1})) AS i)),
b AS (SELECT i, sum(f * y) AS b FROM r GROUP BY i), {_eliminate('a', inner(0))}, {_eliminate('s', inner(SHIFT))},
u AS (SELECT a_inv.i, sum(v * b) AS u FROM a_inv JOIN b ON b.i = a_inv.j GROUP BY a_inv.i), w AS (SELECT a_inv.i, sum(v * u) AS w FROM a_inv JOIN u ON u.i = a_inv.j GROUP BY a_inv.i),
c AS (SELECT s_inv.i, sum(v * b) AS c FROM s_inv JOIN b ON b.i = s_inv.j GROUP BY s_inv.i), n AS (SELECT count(*) AS n FROM embeddings)
SELECT gid AS vec_id, round(sum(f * w), 4) + 0.0 AS pseudo, round((any_value(y) - sum(f * c)) / {SHIFT}, 4) + 0.0 AS shifted, round(any_value(a_det.ld), 4) AS logdet, round(any_value(s_det.ld + (n - {WIDE}) * ln({SHIFT})), 4) AS shifted_logdet
FROM r JOIN w USING (i) JOIN c USING (i), a_det, s_det, n GROUP BY gid"""


def _pivots_sql(by_sum: bool) -> str:
    """The same steps over rows: the pivot is the first row by what is left, and each row's column of the factor follows from it.

    Conditioning on a noisy point leaves it variance, so its column is divided by the root of its variance and the noise.
    """
    noise = NOISE if by_sum else 0.0
    k = f"exp(-list_sum(list_transform(v, lambda x, i: pow(x - pv[i], 2))) / {2 * SPREAD**2!r})"
    total = f"SELECT a.vec_id, sum(exp(-list_sum(list_transform(a.v, lambda x, i: pow(x - b.v[i], 2))) / {2 * SPREAD**2!r})) AS s FROM p a JOIN p b ON true GROUP BY a.vec_id" if by_sum else "SELECT vec_id, 0.0 AS s FROM p"
    return f"""WITH RECURSIVE p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
t AS ({total}),
r(n, vec_id, v, f, d, s, step) AS (SELECT 0, vec_id, v, []::DOUBLE[], 1.0::DOUBLE, CAST(s AS DOUBLE), CAST(NULL AS INTEGER) FROM p JOIN t USING (vec_id) UNION ALL
 SELECT n + 1, vec_id, v, list_append(f, c), d - c * c, s - c * ps / sqrt(pd + {noise!r}), CASE WHEN vec_id = pid THEN CAST(n + 1 AS INTEGER) ELSE step END
 FROM (SELECT *, ({k} - coalesce(list_sum(list_transform(f, lambda x, i: x * pf[i])), 0)) / sqrt(pd + {noise!r}) AS c
  FROM (SELECT *, first_value(vec_id) OVER w AS pid, first_value(v) OVER w AS pv, first_value(f) OVER w AS pf, first_value(d) OVER w AS pd, first_value(s) OVER w AS ps
   FROM r WHERE n < {PICKS} WINDOW w AS (ORDER BY step IS NOT NULL, {'s' if by_sum else 'd'} DESC, vec_id))))
SELECT vec_id, step, round(d, 4) + 0.0 AS residual FROM r WHERE n = {PICKS}"""


# --------------------------------------------------------------------------- SQL
_POINTS = """prof AS (SELECT source AS gid, avg(n_chars) / 1000 AS m, avg(quality) AS y FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source),
t AS (SELECT *, row_number() OVER (ORDER BY gid) AS i FROM prof WHERE y IS NOT NULL AND NOT gid LIKE '%1')"""


def _k(a: str, b: str) -> str:
    return f"exp(-pow({a}.m - {b}.m, 2) / (2 * {SCALE} * {SCALE}))"


def _eliminate(name: str, entries: str) -> str:
    """CTEs that invert the symmetric positive matrix of ``entries`` (i, j, v), i and j from 1: ``name``_inv (i, j, v) and ``name``_det (ld)."""
    return f"""{name}_e AS ({entries}),
{name}_0 AS (SELECT list(r ORDER BY i) AS m, count(*) AS n FROM (SELECT i, list_concat(list(v ORDER BY j), list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY j)) AS r FROM {name}_e GROUP BY i)),
{name}(k, n, m, ld) AS (SELECT 1::BIGINT, n, m, 0.0::DOUBLE FROM {name}_0 UNION ALL
 SELECT k + 1, n, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END), ld + ln(m[k][k]) FROM {name} WHERE k <= n),
{name}_inv AS (SELECT i, j, m[i][n + j] AS v FROM (SELECT m, n, i, unnest(range(1, n + 1)) AS j FROM (SELECT m, n, unnest(range(1, n + 1)) AS i FROM {name} WHERE k = n + 1))),
{name}_det AS (SELECT ld FROM {name} WHERE k = n + 1)"""


_GRAM = f"SELECT a.i, b.i AS j, {_k('a', 'b')} + CASE WHEN a.i = b.i THEN {ALPHA} ELSE 0 END AS v FROM t a JOIN t b ON true"
_DENSE = f"WITH RECURSIVE {_POINTS}, {_eliminate('g', _GRAM)}, w AS (SELECT g_inv.i, sum(v * y) AS w FROM g_inv JOIN t ON t.i = g_inv.j GROUP BY g_inv.i), z AS (SELECT p.gid, t.i, {_k('p', 't')} AS k FROM prof p JOIN t ON true)"
_REST = "u AS (SELECT z.gid, g_inv.j, sum(z.k * v) AS u FROM z JOIN g_inv USING (i) GROUP BY z.gid, g_inv.j)"
_COV = f"SELECT p.gid AS g1, o.gid AS g2, round(greatest(0, {_k('p', 'o')} + CASE WHEN p.gid = o.gid THEN {ALPHA} ELSE 0 END - sum(u.u * z.k)), 5) AS cov FROM prof p JOIN prof o ON p.gid <= o.gid JOIN u ON u.gid = p.gid JOIN z ON z.gid = o.gid AND z.i = u.j GROUP BY p.gid, o.gid, p.m, o.m"
_STD = f"q AS (SELECT u.gid, sum(u.u * z.k) AS q FROM u JOIN z ON z.gid = u.gid AND z.i = u.j GROUP BY u.gid)"
_CORE = f"c AS (SELECT * FROM t WHERE i <= {CORE}), r AS (SELECT t.gid, t.y, c.i, {_k('t', 'c')} AS k FROM t JOIN c ON true), b AS (SELECT i, sum(k * y) AS b FROM r GROUP BY i)"
_A = "SELECT x.i, y.i AS j, sum(x.k * y.k) AS v FROM r x JOIN r y USING (gid) GROUP BY x.i, y.i"
_KCC = f"SELECT a.i, b.i AS j, {_k('a', 'b')} + CASE WHEN a.i = b.i THEN {ALPHA} ELSE 0 END AS v FROM c a JOIN c b ON true"
_LOW = f"WITH RECURSIVE {_POINTS}, {_CORE}, {_eliminate('a', _A)}, {_eliminate('g', _KCC)}, w AS (SELECT a_inv.i, sum(v * b) AS w FROM a_inv JOIN b ON b.i = a_inv.j GROUP BY a_inv.i), z AS (SELECT p.gid, c.i, {_k('p', 'c')} AS k FROM prof p JOIN c ON true)"
_PREDICT = f", {_REST}, {_STD}, m AS (SELECT gid, sum(k * w) AS y FROM z JOIN w USING (i) GROUP BY gid) SELECT gid AS g1, round(m.y, 5) + 0.0 AS y, round(sqrt(greatest(0, 1 + {ALPHA} - q)), 5) AS std FROM m JOIN q USING (gid)"
_SHIFTED = "SELECT a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN 0.5 ELSE 0 END AS v FROM g_e a JOIN g_e b ON a.j = b.j WHERE a.j <= 3 GROUP BY a.i, b.i"
_FACTORS = """SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM g_e a JOIN g_e b ON a.j = b.j WHERE a.j <= 3 GROUP BY a.i, b.i"""
_INNER = "SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM g_e a JOIN g_e b ON a.i = b.i WHERE a.j <= 3 AND b.j <= 3 GROUP BY a.j, b.j"
_W = f"{_k('a', 'b')} + 1e-3"


def _greedy(score: str, deflate: str) -> str:
    """Four greedy steps over the Gramian as a list of rows; ``score`` of row r, ``deflate`` of entry v of row r at j, the pick being s."""
    return f"""WITH RECURSIVE {_POINTS}, e AS ({_GRAM}), m0 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM e GROUP BY i)),
pick(step, m, gone, s) AS (SELECT 0, m, []::BIGINT[], 0::BIGINT FROM m0 UNION ALL
 SELECT step + 1, list_transform(m, lambda r, i: list_transform(r, lambda v, j: {deflate})), list_append(gone, s2), s2
 FROM (SELECT step, m, gone, list_position(sc, list_max(sc))::BIGINT AS s2 FROM (SELECT *, list_transform(m, lambda r, i: CASE WHEN list_contains(gone, i::BIGINT) THEN -1e300 ELSE {score} END) AS sc FROM pick WHERE step < 4)))
SELECT CAST(step AS INTEGER) AS step, gid FROM pick JOIN t ON t.i = s WHERE step > 0"""


Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {
    "tall_pseudoinverse": (tall_pseudoinverse, _tall_sql()),
    "propagate_quality": (propagate_quality, _CHAIN),
    "exact_gp_weights": (exact_gp_weights, _exact_sql()),
    "determinant_select_vectors": (determinant_select_vectors, _pivots_sql(False)),
    "variance_select_vectors": (variance_select_vectors, _pivots_sql(True)),
    "gp_predict_std": (gp_predict_std, _DENSE + _PREDICT),
    "gp_predict_cov": (gp_predict_cov, f"{_DENSE}, {_REST} {_COV}"),
    "gp_gramian": (gp_gramian, f"WITH {_POINTS} SELECT a.gid AS g1, b.gid AS g2, round({_k('a', 'b')} * CASE WHEN a.i = b.i THEN 1 + {ALPHA} ELSE 1 END, 5) AS k FROM t a JOIN t b ON a.i <= b.i"),
    "gp_loocv": (gp_loocv, f"{_DENSE} SELECT t.gid, round(t.y - w.w / v, 5) + 0.0 AS y, round(sqrt(1 / v), 5) AS std FROM t JOIN w USING (i) JOIN g_inv ON g_inv.i = t.i AND g_inv.j = t.i"),
    "gp_objective": (gp_objective, f"{_DENSE}, o AS (SELECT sum(t.y * w.w) + any_value(ld) AS objective, 0.5 * sum(pow(w.w / v, 2)) AS loo FROM t JOIN w USING (i) JOIN g_inv ON g_inv.i = t.i AND g_inv.j = t.i JOIN g_det ON true) SELECT how, round(objective, 4) AS objective, round(loo, 4) AS loo FROM o JOIN (VALUES ('+'), ('*')) h(how) ON true"),
    "nystrom_predict_std": (nystrom_predict_std, _LOW + _PREDICT),
    "nystrom_predict_cov": (nystrom_predict_cov, f"{_LOW}, {_REST} {_COV}"),
    "nystrom_loocv": (nystrom_loocv, f"WITH RECURSIVE {_POINTS}, {_CORE}, {_eliminate('a', f'SELECT i, j, v + CASE WHEN i = j THEN {ALPHA} ELSE 0 END AS v FROM ({_A})')}, u AS (SELECT r.gid, r.y, a_inv.j AS i, sum(r.k * v) AS u FROM r JOIN a_inv USING (i) GROUP BY ALL), f AS (SELECT u.gid, u.y, sum(u.u * r.k) AS d, sum(u.u * b) AS m FROM u JOIN r ON r.gid = u.gid AND r.i = u.i JOIN b ON b.i = u.i GROUP BY u.gid, u.y) SELECT gid AS g1, round(y - (y - m) / (1 - d), 5) + 0.0 AS y FROM f"),
    "nystrom_objective": (nystrom_objective, f"{_LOW} SELECT round(sum(x.w * y.w * v) + any_value(a_det.ld) - any_value(g_det.ld), 4) AS objective FROM g_e JOIN w x ON x.i = g_e.i JOIN w y ON y.i = g_e.j JOIN a_det ON true JOIN g_det ON true"),
    "la_inverse": (la_inverse, f"{_DENSE}, {_eliminate('s', _SHIFTED)} SELECT method, i, j, round(v, 5) + 0.0 AS v FROM g_inv JOIN (VALUES ('cholesky'), ('pseudo'), ('power'), ('bordered')) h(method) ON true UNION ALL SELECT 'shifted', i, j, round(v, 5) + 0.0 FROM s_inv"),
    "la_solve": (la_solve, f"{_DENSE} SELECT method, i, round(w, 5) + 0.0 AS x FROM w JOIN (VALUES ('cholesky'), ('gradients')) h(method) ON true"),
    "la_low_rank": (la_low_rank, f"""{_DENSE}, a AS ({_FACTORS}), b AS (SELECT x.i, y.i AS j, sum(x.v * y.v) AS v FROM g_e x JOIN g_e y ON x.j + 3 = y.j WHERE x.j <= 3 GROUP BY x.i, y.i), {_eliminate('n', _INNER)},
 s(name, value) AS (SELECT 'trace', sum(v) FROM b WHERE i = j UNION ALL SELECT 'quadratic', sum(p.y * v * o.y) FROM b JOIN t p ON p.i = b.i JOIN t o ON o.i = b.j UNION ALL SELECT 'transposed', sum(v * o.y) FROM b JOIN t o ON o.i = b.j
  UNION ALL SELECT 'sum', (SELECT sum(v) FROM a) + (SELECT sum(v) FROM b) UNION ALL SELECT 'difference', (SELECT sum(v) FROM a) - (SELECT sum(v) FROM b) UNION ALL SELECT 'negative', -sum(v) FROM b
  UNION ALL SELECT 'product', sum(a.v * b.v) FROM a JOIN b ON a.j = b.i UNION ALL SELECT 'applied', sum(v * o.y) FROM b JOIN t o ON o.i = b.j UNION ALL SELECT 'diagonal', sum(v * v) FROM b WHERE i = j
  UNION ALL SELECT 'logdet', ld FROM n_det UNION ALL SELECT 'square', sum(v * v) FROM a UNION ALL SELECT 'pseudo', sum(v) FROM a WHERE i = j) SELECT name, round(value, 4) + 0.0 AS value FROM s"""),
    "field_influence": (field_influence, f"""WITH RECURSIVE {_POINTS}, un AS (SELECT *, row_number() OVER (ORDER BY gid) AS n FROM prof WHERE y IS NULL OR gid LIKE '%1'),
 tot AS (SELECT a.gid, sum({_W}) AS d FROM un a JOIN prof b ON a.gid <> b.gid GROUP BY a.gid),
 {_eliminate('l', f"SELECT a.n AS i, b.n AS j, CASE WHEN a.n = b.n THEN d ELSE -({_W}) END AS v FROM un a JOIN un b ON true JOIN tot ON tot.gid = a.gid")}
 SELECT o.gid AS i, b.gid AS j, round(sum(v * ({_W})), 5) AS w FROM l_inv JOIN un o ON o.n = l_inv.i JOIN un a ON a.n = l_inv.j JOIN t b ON true GROUP BY o.gid, b.gid"""),
    "variance_select": (_select(lambda k, n: models.variance_minimizer(k, n, 1e-6)), _greedy("list_sum(r)", "v - r[s2] * m[s2][j] / (m[s2][s2] + 1e-6)")),
    "determinant_select_sources": (_select(models.determinant_maximizer), _greedy("list_sum(list_transform(r, lambda z: z * z))", "v - m[s2][j] * list_sum(list_transform(r, lambda z, q: z * m[s2][q])) / list_sum(list_transform(m[s2], lambda z: z * z))")),
}
