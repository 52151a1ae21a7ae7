"""The walk iteration of the graph kernel as DuckDB SQL, which queries of graphs are held against."""

from __future__ import annotations

from .functions.microkernel import MicroKernel


def walk_sql(pairs: str, body: str, steps: int, *, graphs: str, node: MicroKernel, edge: MicroKernel, q: float) -> str:
    """``body`` over x(g1, g2, i1, i2, v, x) for the pairs of graphs that satisfy ``pairs``.

    ``graphs`` has CTEs nodes(gid, nid, lab, val) and edges(gid, src, dst, w, len).
    """
    node = node.sql({"lab": "a.lab", "val": "a.val"}, {"lab": "b.lab", "val": "b.val"})
    edge = edge.sql({"len": "a.len"}, {"len": "b.len"})
    return f"""WITH RECURSIVE {graphs},
both_ways AS (SELECT gid, src, dst, w, len FROM edges UNION ALL SELECT gid, dst, src, w, len FROM edges WHERE src <> dst),
deg AS (SELECT n.gid, n.nid, CASE WHEN coalesce(sum(w), 0) = 0 THEN 1.0 ELSE sum(w) END AS d FROM nodes n LEFT JOIN both_ways e ON e.gid = n.gid AND e.src = n.nid GROUP BY ALL),
full_nodes AS (SELECT n.*, d FROM nodes n JOIN deg USING (gid, nid)),
pn AS (SELECT a.gid AS g1, b.gid AS g2, a.nid AS i1, b.nid AS i2, {node} AS v, a.d * b.d / {(1 - q) ** 2!r} AS d FROM full_nodes a JOIN full_nodes b ON {pairs}),
pe AS (SELECT a.gid AS g1, b.gid AS g2, a.src AS i1, b.src AS i2, a.dst AS j1, b.dst AS j2, a.w * b.w * {edge} AS w FROM both_ways a JOIN both_ways b ON {pairs}),
it(k, g1, g2, i1, i2, x) AS (
  SELECT 0, g1, g2, i1, i2, v FROM pn
  UNION ALL
  SELECT s.k + 1, p.g1, p.g2, p.i1, p.i2, p.v / p.d * (p.d + coalesce(s.s, 0))
  FROM pn p JOIN (SELECT k, e.g1, e.g2, e.i1, e.i2, sum(e.w * t.x) AS s FROM it t JOIN pe e ON e.g1 = t.g1 AND e.g2 = t.g2 AND e.j1 = t.i1 AND e.j2 = t.i2 WHERE k < {steps} GROUP BY ALL) s USING (g1, g2, i1, i2)),
x AS (SELECT g1, g2, i1, i2, pn.v, it.x FROM it JOIN pn USING (g1, g2, i1, i2) WHERE k = {steps})
{body}"""
