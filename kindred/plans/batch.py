"""Solves of one graph against many, stacked into arrays.

Graphs on the right are sorted into classes of like size, padded with nodes of no weight, and stacked; the edge similarity
is evaluated once for each pair of undirected edges. Small products are solved directly, a stack at a time. Others go
through conjugate gradients that run over the whole stack, and over both right sides at once where derivatives are wanted.
Their operand is laid out by node and slot (each node's edges padded to the largest degree) where that wastes little, and
as a plain list of edge pairs where degrees are uneven; either way the matrix is never formed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    from .kernel import GraphKernel, Packed

#: Products of at most this many node pairs are solved directly.
DIRECT = 100
#: Entries of a stacked operand, so that a step stays in a core's cache; a larger pair stands alone.
ENTRIES = 1 << 18
#: The same for products solved directly.
DIRECT_ENTRIES = 1 << 15
#: A layout by slots may have this many times the entries of the list.
WASTE = 3.0


@dataclass
class Side:
    """One graph laid out for products: undirected edges' features, and its directed edges by node."""

    g: Packed
    features: object
    src: np.ndarray
    dst: np.ndarray
    w: np.ndarray
    edge: np.ndarray
    slot: np.ndarray
    degree: int
    table: np.ndarray | None  # (n, n): the undirected edge between two nodes, -1 for none; absent where edges are parallel

    @classmethod
    def of(cls, g: Packed) -> Side:
        if hasattr(g, "side"):
            return g.side
        once = len(g.src) if g.once is None else g.once
        edge = np.arange(len(g.src))
        edge[once:] = np.flatnonzero(g.src[:once] != g.dst[:once]) if once < len(g.src) else edge[once:]
        by = np.argsort(g.src, kind="stable")
        src = g.src[by]
        deg = np.bincount(src, minlength=g.n)
        slot = np.arange(len(src)) - np.repeat(np.cumsum(deg) - deg, deg)
        features = {c: v[:once] for c, v in g.edges.items()} if g.edges else np.zeros(once)
        table = None
        if g.n <= DIRECT and g.once is not None and len(np.unique(g.src * g.n + g.dst)) == len(g.src):
            table = np.full((g.n, g.n), -1)
            table[g.src, g.dst] = edge
        g.side = cls(g, features, src, g.dst[by], g.w[by], edge[by], slot, int(deg.max(initial=0)), table)
        return g.side


def joined(parts: list) -> object:
    """Features of several graphs one after the other."""
    if isinstance(parts[0], Mapping):
        return {c: joined([p[c] for p in parts]) for c in parts[0]}
    return np.concatenate([np.asarray(p) for p in parts])


def _class(n: int) -> int:
    """The size a graph is padded to: a power of two has eight sizes."""
    step = max(1, 1 << max(0, n.bit_length() - 4))
    return -(-n // step) * step


def solved(kernel: GraphKernel, a: Packed, bs: list[Packed], gradient: bool = False, adjoint: Callable | None = None) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """For each of ``bs``: x as (a.n, b.n), and with ``gradient`` the adjoint solution and the derivatives of p' x p.

    ``adjoint(b, x)`` gives weights instead of p p', (a.n, b.n), from the solution: the derivatives of their sum of x.
    """
    out: list = [None] * len(bs)
    left = Side.of(a)
    sides = [Side.of(b) for b in bs]
    classes: dict[int, list[int]] = {}
    for k, b in enumerate(bs):
        classes.setdefault(_class(b.n), []).append(k)
    for n, members in classes.items():
        while members:
            if a.n * n <= DIRECT:
                take = max(1, DIRECT_ENTRIES // (a.n * n) ** 2)
            else:
                take = _take(a, left, sides, members, n)
            for k, r in zip(members[:take], _Stack(kernel, left, [sides[k] for k in members[:take]], n).run(gradient, adjoint), strict=True):
                out[k] = r
            members = members[take:]
    return out


def _take(a: Packed, left: Side, sides: list[Side], members: list[int], n: int) -> int:
    """How many of ``members`` make a stack of at most ENTRIES."""
    deg = take = 0
    for k in members:
        deg = max(deg, sides[k].degree)
        if take and (take + 1) * a.n * n * max(left.degree * deg, 1) > ENTRIES:
            break
        take += 1
    return take


class _Stack:
    def __init__(self, kernel: GraphKernel, a: Side, bs: list[Side], n: int):
        self.kernel, self.a, self.bs, self.n = kernel, a, bs, n
        self.shape = (len(bs), a.g.n, n)
        nodes = [b.g.nodes or np.zeros(b.g.n) for b in bs]
        self.node_args = (a.g.nodes or np.zeros(a.g.n), joined(nodes))
        self.edge_args = (a.features, joined([b.features for b in bs]))
        self.first = np.cumsum([0, *[b.g.once if b.table is not None else len(b.edge) and int(b.edge.max()) + 1 for b in bs]])
        # where each of the concatenated nodes stands
        self.of = np.repeat(np.arange(len(bs)), [b.g.n for b in bs])
        self.at = np.concatenate([np.arange(b.g.n) for b in bs])
        self.any_edges = len(a.src) > 0 and self.first[-1] > 0

    def _spread(self, m: np.ndarray, fill: float) -> np.ndarray:
        """(a.n, nodes of all bs) as (stack, a.n, n), padded."""
        out = np.full(self.shape, fill)
        out[self.of, :, self.at] = m.T
        return out

    def run(self, gradient: bool, adjoint: Callable | None = None) -> list[tuple]:
        kernel, a, bs = self.kernel, self.a, self.bs
        gradient = gradient or adjoint is not None
        if gradient:
            v, gv = kernel.node.values_and_partials(*self.node_args)
            e, ge = kernel.edge.values_and_partials(*self.edge_args) if self.any_edges else (None, [])
        else:
            v, gv, ge = kernel.node.values(*self.node_args), [], []
            e = kernel.edge.values(*self.edge_args) if self.any_edges else None
        v = self._spread(v, 1.0)
        d = np.concatenate([b.g.d for b in bs])
        rhs = self._spread(np.outer(a.g.d, d) / (1 - kernel.q) ** 2, 0.0)
        diag = np.where(rhs == 0, 1.0, rhs) / v
        sides = [rhs]
        if gradient and adjoint is None:
            pp = self._spread(np.outer(a.g.p, np.concatenate([b.g.p for b in bs])), 0.0)
            sides.append(pp)
        self._lay_out(e)
        x = self._solve(diag, np.stack(sides))
        if adjoint is not None:
            pp = np.zeros(self.shape)
            for k, b in enumerate(bs):
                pp[k, :, : b.g.n] = adjoint(b.g, (x[0] - v if kernel.lmin else x[0])[k, :, : b.g.n])
            x = np.concatenate([x, self._solve(diag, pp[None])])
        grads = self._derivatives(x, v, gv, ge, rhs, pp) if gradient else None
        y = x[0] - v if kernel.lmin else x[0]
        return [(y[k, :, : b.g.n], x[1][k, :, : b.g.n] if gradient else None, grads[k] if gradient else None) for k, b in enumerate(bs)]

    # ------------------------------------------------------------------ the operand
    def _lay_out(self, e: np.ndarray | None) -> None:
        k, n1, n2 = self.shape
        a, bs = self.a, self.bs
        self.form = "none"
        if e is None:
            return
        if n1 * n2 <= DIRECT and a.table is not None and all(b.table is not None for b in bs):
            self.form = "matrix"
            self.ww = np.outer(a.g.w[: a.g.once], np.concatenate([b.g.w[: b.g.once] for b in bs]))
            if all(b.g.n == n2 for b in bs):
                other = np.stack([b.table for b in bs])
            else:
                other = np.full((k, n2, n2), -1)
                for z, b in enumerate(bs):
                    other[z, : b.g.n, : b.g.n] = b.table
            other = np.where(other >= 0, other + self.first[:-1, None, None], -1)
            self.edge_pair = a.table.ravel(), other.ravel()
            self.weights = self._entries(self.ww * e)
            return
        slots = max(b.degree for b in bs)
        pairs = len(a.src) * sum(len(b.src) for b in bs)
        if k * n1 * n2 * a.degree * slots <= WASTE * pairs and n1 * n2 > DIRECT:
            self.form = "slots"
            nb1, w1, e1 = (np.zeros((a.degree, n1), t) for t in (np.int64, float, np.int64))
            nb2, w2, e2 = (np.zeros((k, slots, n2), t) for t in (np.int64, float, np.int64))
            nb1[a.slot, a.src], w1[a.slot, a.src], e1[a.slot, a.src] = a.dst, a.w, a.edge
            for z, b in enumerate(bs):
                nb2[z, b.slot, b.src], w2[z, b.slot, b.src], e2[z, b.slot, b.src] = b.dst, b.w, b.edge + self.first[z]
            wide = (k, a.degree * slots, n1, n2)
            self.edge_pair = (e1[None, :, None, :, None] * e.shape[1] + e2[:, None, :, None, :]).reshape(wide)
            self.ww = (w1[None, :, None, :, None] * w2[:, None, :, None, :]).reshape(wide)
            start = np.arange(k)[:, None, None, None, None] * (n1 * n2)
            self.cols = (start + nb1[None, :, None, :, None] * n2 + nb2[:, None, :, None, :]).reshape(wide)
        else:
            self.form = "list"
            cat = lambda f: np.concatenate([f(z, b) for z, b in enumerate(bs)])
            start = cat(lambda z, b: np.full(len(b.src), z * n1 * n2))
            self.rows = (start[None] + a.src[:, None] * n2 + cat(lambda z, b: b.src)[None]).ravel()
            self.cols = (start[None] + a.dst[:, None] * n2 + cat(lambda z, b: b.dst)[None]).ravel()
            self.ww = np.outer(a.w, cat(lambda z, b: b.w)).ravel()
            self.edge_pair = (a.edge[:, None] * e.shape[1] + cat(lambda z, b: b.edge + self.first[z])[None]).ravel()
        self.weights = self.ww * e.ravel().take(self.edge_pair)

    def _entries(self, values: np.ndarray) -> np.ndarray:
        """Values of pairs of undirected edges as matrices (stack, node pairs, node pairs), 0 where there is no edge."""
        k, n1, n2 = self.shape
        padded = np.zeros((values.shape[0] + 1, values.shape[1] + 1))
        padded[:-1, :-1] = values
        left, right = self.edge_pair
        m = padded[left].take(right, axis=1).reshape(n1, n1, k, n2, n2)
        return m.transpose(2, 0, 3, 1, 4).reshape(k, n1 * n2, n1 * n2)

    def _times(self, x: np.ndarray, active: np.ndarray | None = None) -> np.ndarray:
        """W x for each right side."""
        if self.form == "none":
            return np.zeros_like(x)
        if self.form == "slots":
            return np.stack([np.einsum("kdij,kdij->kij", self.weights, s.ravel().take(self.cols)) for s in x])
        size = int(np.prod(self.shape))
        return np.stack([np.bincount(self.rows, self.weights * s.ravel().take(self.cols), size).reshape(self.shape) for s in x])

    def _solve(self, diag: np.ndarray, rhs: np.ndarray) -> np.ndarray:
        if self.shape[1] * self.shape[2] <= DIRECT:
            return self._direct(diag, rhs)
        return _conjugate(self._times, diag, rhs, self.kernel.tol)

    def _direct(self, diag: np.ndarray, rhs: np.ndarray) -> np.ndarray:
        k, n1, n2 = self.shape
        n = n1 * n2
        m = np.zeros((k, n, n))
        if self.form == "list":
            m = -np.bincount(self.rows * n + self.cols % n, self.weights, k * n * n).reshape(k, n, n)
        elif self.form == "matrix":
            m = -self.weights
        m[:, np.arange(n), np.arange(n)] += diag.reshape(k, n)
        x = np.linalg.solve(m, rhs.reshape(len(rhs), k, n).transpose(1, 2, 0))
        return x.transpose(2, 0, 1).reshape(rhs.shape)

    # ------------------------------------------------------------------ derivatives
    def _derivatives(self, x, v, gv, ge, rhs, pp) -> np.ndarray:
        """(stack, parameters): with respect to q, the node's, then the edge's parameters."""
        y, z = x
        k, n1, n2 = self.shape
        total = lambda m: m.reshape(k, -1).sum(1)
        dd = 2 / (1 - self.kernel.q) * rhs
        out = [total(z * (dd - dd / v * y))]
        inner = z * rhs / v**2 * y
        for g in gv:
            g = self._spread(g, 0.0)
            out.append(total(inner * g) - (total(pp * g) if self.kernel.lmin else 0.0))
        if self.form == "none":
            out += [np.zeros(k)] * len(self.kernel.edge.theta)
        elif self.form == "matrix":
            left, right = z.reshape(k, 1, n1 * n2), y.reshape(k, n1 * n2, 1)
            out += [(left @ self._entries(self.ww * g) @ right)[:, 0, 0] for g in ge]
        elif self.form == "slots":
            zy = self.ww * y.ravel().take(self.cols) * z[:, None]
            out += [total(zy * g.ravel().take(self.edge_pair)) for g in ge]
        else:
            zy = self.ww * y.ravel().take(self.cols) * z.ravel().take(self.rows)
            out += [np.bincount(self.rows // (n1 * n2), zy * g.ravel().take(self.edge_pair), k) for g in ge]
        return np.stack(out, 1)


def _conjugate(times, diag: np.ndarray, rhs: np.ndarray, tol: float) -> np.ndarray:
    """x of (diag - W) x = rhs for a stack of systems (..., n1, n2), each until its residual is below ``tol`` of its right side."""
    dot = lambda a, b: np.einsum("skij,skij->sk", a, b)
    x, r = np.zeros_like(rhs), rhs.copy()
    z = r / diag
    s, rz = z.copy(), dot(r, z)
    goal = tol * np.sqrt(dot(rhs, rhs))
    for _ in range(10 * diag[0].size):
        t = diag * s - times(s)
        curve = dot(s, t)
        step = np.divide(rz, curve, out=np.zeros_like(rz), where=curve != 0)[..., None, None]
        x += step * s
        r -= step * t
        if (np.sqrt(dot(r, r)) <= goal).all():
            return x
        z = r / diag
        new = dot(r, z)
        s = z + np.divide(new, rz, out=np.zeros_like(rz), where=rz != 0)[..., None, None] * s
        rz = new
    raise ArithmeticError("conjugate gradients did not converge")
