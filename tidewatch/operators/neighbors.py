"""Exact nearest-neighbour and radius joins on vector columns.

No cross join and no all-pairs table.  Reference points are dealt to a metric
tree: a node with more than ``BLOCK`` points is split among ``FAN``
hash-chosen pivots of its own, level by level, until every leaf is bounded, so
the number of pivots follows the data and a dense region gets more of them.
The driver holds the tree (about 3 / BLOCK nodes a point: vector, radius),
never points.  A leaf that pivots cannot split is cut into chunks; small leaves
in a row share a block, so that a row travels to fewer blocks.

A block (leaf, chunk) and the queries that can have neighbours there are
solved by one ``cogroup().applyInArrow`` task, which splits the block the same
way into cells of ``CELL`` points and visits a cell only if the triangle
inequality allows it.  Where most cells are within reach (many dimensions),
points are screened in single precision instead and only the survivors get
exact distances.  The kNN join has two phases: the query's own block gives
a true k-th distance, and with it the tree names the other blocks that can
hold a nearer point, usually few or none.

Equal vectors are one point with its smallest keys, on both sides, so copies
make no distances; they are told apart again in the result.  Rows without a
vector have no neighbours.  The lists of nearest keys (``neighbour_lists``) can
be kept: a later search among the same points takes them from there.

Ties: distances are compared rounded to 9 decimals, then by key, so results
are the same whatever the partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.hashing import DEFAULT_SEED
from tidewatch.session import materialize

FAN = 16               # pivots of a node that is split
CELL = 64              # points of a cell inside a block
BLOCK = 16384          # points per side in one group
WIDE = 1 << 22         # numbers of the points of a group whose queries come ``BLOCK`` at a time
SUB = 512              # query rows per NumPy sub-batch
DENSE = 0.25           # share of a block within reach from which cells are not told apart
PART = 2048            # points screened at once then
TILE = 1024            # the same in the kNN join: the products stay in the cache
FEW = 1024             # queries of a group where more groups would only ship blocks again
DIGITS = 9
_SLACK = 1e-9


def vectors(column, d: int) -> np.ndarray:
    """Rows of a list column (Arrow or pandas) as a matrix of ``d`` columns."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, d))
    return np.stack([np.asarray(v, dtype=np.float64) for v in column.to_numpy()]) if len(column) else np.zeros((0, d))


def matrix(rows: pa.Table, d: int) -> np.ndarray:
    """The vectors of rows shipped by ``Blocks.solve``."""
    short, long = rows.column("f"), rows.column("v")
    if short.null_count == 0:
        return vectors(short, d)
    if long.null_count == 0:
        return vectors(long, d)
    has = short.is_valid().to_numpy()
    out = np.empty((len(has), d))
    out[has], out[~has] = vectors(short.drop_null(), d), vectors(long.drop_null(), d)
    return out


def _squares(Q: np.ndarray, R: np.ndarray) -> np.ndarray:
    """Squared distances by the product form: fast, exact to rounding of the norms."""
    d2 = (Q ** 2).sum(1)[:, None] + (R ** 2).sum(1)[None, :] - 2.0 * Q @ R.T
    return np.maximum(d2, 0.0, out=d2)


def _true(flags: np.ndarray) -> np.ndarray:
    """Places of the few set flags, eight looked at together."""
    flat = flags.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    at = np.flatnonzero(flat.view(np.uint64))
    i, j = np.nonzero(flat.reshape(-1, 8)[at])
    return 8 * at[i] + j


def _nearest(X: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.zeros(len(X), dtype=np.int64)
    for s in range(0, len(X), SUB):
        out[s:s + SUB] = _squares(X[s:s + SUB], pivots).argmin(axis=1)
    return out


class Tree:
    """Balls in a hierarchy: centre, radius, first child and number of children
    (0: leaf) of every node; node 0 is the root, children follow parents."""

    def __init__(self, root: np.ndarray):
        self.centre, self.radius = [root], [np.inf]
        self.first, self.children = [0], [0]

    def split(self, node: int, pivots: np.ndarray) -> None:
        self.first[node], self.children[node] = len(self.centre), len(pivots)
        for p in pivots:
            self.centre.append(p)
            self.radius.append(np.inf)
            self.first.append(0)
            self.children.append(0)

    def freeze(self) -> "Tree":
        """Arrays instead of lists; a radius left open comes from the children."""
        self.centre, self.radius = np.stack(self.centre), np.array(self.radius, dtype=np.float64)
        self.first, self.children = np.array(self.first), np.array(self.children)
        for n in range(len(self.first) - 1, -1, -1):
            if self.children[n] and np.isinf(self.radius[n]):
                kids = slice(self.first[n], self.first[n] + self.children[n])
                reach = np.sqrt(((self.centre[kids] - self.centre[n]) ** 2).sum(1)) + self.radius[kids]
                self.radius[n] = reach.max()
        return self

    def route(self, X: np.ndarray) -> np.ndarray:
        """Leaf of the nearest pivots, from the root down."""
        at = np.zeros(len(X), dtype=np.int64)
        while True:
            inner = np.unique(at[np.asarray(self.children)[at] > 0])
            if not len(inner):
                return at
            for n in inner.tolist():
                own = np.flatnonzero(at == n)
                first = self.first[n]
                pivots = np.asarray(self.centre[first:first + self.children[n]])
                at[own] = first + _nearest(X[own], pivots)

    def visit(self, X: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs such that the leaf's ball comes within ``bound`` of the row."""
        out = []
        for s in range(0, len(X), SUB):
            row = np.arange(s, min(s + SUB, len(X)))
            node = np.zeros(len(row), dtype=np.int64)
            while len(row):
                keep = np.zeros(len(row), dtype=bool)
                for c in range(0, len(row), 1 << 15):
                    r, n = row[c:c + (1 << 15)], node[c:c + (1 << 15)]
                    dist = np.sqrt(((X[r] - self.centre[n]) ** 2).sum(1))
                    keep[c:c + (1 << 15)] = dist - self.radius[n] <= bound[r] + _SLACK * (1.0 + dist)
                row, node = row[keep], node[keep]
                leaf = self.children[node] == 0
                out.append((row[leaf], node[leaf]))
                row, node = row[~leaf], node[~leaf]
                n = self.children[node]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, node = np.repeat(row, n), np.repeat(self.first[node], n) + nth
        row, node = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        return row, node


class Cells:
    """The points of a block in a tree of cells of ``CELL`` points."""

    def __init__(self, X: np.ndarray, cell: int = CELL):
        self.X = X
        rng = np.random.default_rng(0)
        tree, self.rows, todo = Tree(X[0]), {}, [(0, np.arange(len(X)), True)]
        while todo:
            node, rows, splits = todo.pop()
            tree.centre[node] = X[rows].mean(axis=0)
            far = np.sqrt(((X[rows] - tree.centre[node]) ** 2).sum(1).max())
            tree.radius[node] = far * (1 + _SLACK)
            if len(rows) <= cell or not splits or far == 0:
                self.rows[node] = rows
                continue
            to = _nearest(X[rows], X[rng.choice(rows, min(FAN, -(-len(rows) // (cell // 2 or 1))), replace=False)])
            kinds = np.unique(to)
            if len(kinds) == 1:
                self.rows[node] = rows
                continue
            tree.split(node, np.zeros((len(kinds), X.shape[1])))
            todo += [(tree.first[node] + i, rows[to == j], True) for i, j in enumerate(kinds.tolist())]
        self.tree = tree.freeze()
        # single precision suffices to leave points out: [q, 1] . [-2 x, x . x] + q . q is
        # within ``off`` (x . x + q . q) of the square, by which the last column is lowered
        self.off = 4 * (X.shape[1] + 8) * 2.0 ** -24
        self.middle = np.median(X[self.some()], axis=0)
        with np.errstate(over="ignore", invalid="ignore"):
            far = X - self.middle
            self.squares = (far ** 2).sum(1)
            self.screen = None
            if self.squares.max() < 1e30:
                self.screen = np.hstack([-2 * far, (self.squares * (1 - self.off))[:, None]]).astype(np.float32)

    def some(self, n: int = PART) -> np.ndarray:
        return np.unique(np.linspace(0, len(self.X) - 1, n).astype(np.int64))

    def spread(self, Q: np.ndarray, bound: np.ndarray) -> bool:
        """Whether a good part of the points is within reach of the cells that a
        few of the queries open, so that telling cells apart costs more than it saves."""
        if self.screen is None or len(self.rows) == 1:
            return False
        some = np.unique(np.linspace(0, len(Q) - 1, 16).astype(np.int64))
        row, leaf = self.tree.visit(Q[some], bound[some])
        return sum(len(self.rows[n]) for n in leaf.tolist()) > DENSE * len(some) * len(self.X)

    def _asked(self, Q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centred queries with a 1 in single precision, and their squares."""
        with np.errstate(over="ignore", invalid="ignore"):
            far = Q - self.middle
            return np.hstack([far, np.ones((len(far), 1))]).astype(np.float32), (far ** 2).sum(1)

    def _close(self, Q32: np.ndarray, squares: np.ndarray, limit: np.ndarray, rows: slice, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place in ``rows``) of all that may be within ``limit``, and a
        few more; ``room`` holds the products meanwhile."""
        with np.errstate(over="ignore", invalid="ignore"):
            level = ((limit + 1e-6) ** 2 + 1e-6 - squares * (1 - self.off)).astype(np.float32)
            n = rows.stop - rows.start
            products = np.matmul(Q32, self.screen[rows].T, out=room[:len(Q32) * n].reshape(len(Q32), n))
            at = _true(products <= np.nextafter(level, np.float32(np.inf))[:, None])
        return np.divmod(at, n)

    def _dense(self, part: np.ndarray, limit: np.ndarray):
        """Pieces of (query, point, distance) within ``limit``, no cell left out."""
        Q32, squares = self._asked(part)
        huge = ~(squares < 1e30)  # beyond single precision
        room = np.empty(len(part) * min(TILE, len(self.X)), dtype=np.float32)
        for a in range(0, len(self.X), TILE):
            rows = slice(a, min(a + TILE, len(self.X)))
            i, j = self._close(Q32, squares, limit, rows, room)
            if huge.any():
                more = np.flatnonzero(huge)
                keep = ~huge[i]
                n = rows.stop - rows.start
                i, j = np.concatenate([i[keep], np.repeat(more, n)]), np.concatenate([j[keep], np.tile(np.arange(n), len(more))])
            for c in range(0, len(i), 1 << 18):
                q, r = i[c:c + (1 << 18)], j[c:c + (1 << 18)] + a
                yield q, r, np.sqrt(((part[q] - self.X[r]) ** 2).sum(1))

    def tighten(self, Q: np.ndarray, need: int, bound: np.ndarray) -> np.ndarray:
        """``bound`` or the distance of the ``need``-th of some points, an eighth
        of them or ``PART``, if less."""
        some = self.some(max(PART, len(self.X) // 8))
        if len(some) < need or not self.spread(Q, bound):
            return bound
        out = bound.copy()
        above = self.screen[some]
        above[:, -1] = self.squares[some] * (1 + self.off)
        for s in range(0, len(Q), SUB):
            Q32, squares = self._asked(Q[s:s + SUB])
            with np.errstate(over="ignore", invalid="ignore"):
                kth = np.partition(Q32 @ above.T, need - 1, axis=1)[:, need - 1].astype(np.float64)
                kth = np.sqrt(np.maximum(kth + squares * (1 + self.off), 0.0)) * (1 + 1e-6) + 1e-6
            out[s:s + SUB] = np.where(kth < out[s:s + SUB], kth, out[s:s + SUB])
        return out

    def pairs(self, Q: np.ndarray, bound: np.ndarray):
        """(query rows, point rows, distances) within ``bound``, cell by cell for
        ``SUB`` queries at a time; yields None at the end of each sub-batch."""
        dense = len(Q) > 0 and self.spread(Q, bound)
        for s in range(0, len(Q), SUB):
            part = Q[s:s + SUB]
            if dense:
                for i, j, dist in self._dense(part, bound[s:s + SUB]):
                    ok = np.round(dist, DIGITS) <= bound[s + i] + _SLACK
                    yield s + i[ok], j[ok], dist[ok]
                yield None
                continue
            row, leaf = self.tree.visit(part, bound[s:s + SUB])
            order = np.argsort(leaf, kind="stable")
            row, leaf = row[order], leaf[order]
            edge = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])) if len(leaf) else []
            for a, b in zip(edge, [*edge[1:], len(leaf)]):
                qs, rs = row[a:b], self.rows[leaf[a]]
                limit = bound[s + qs]
                # screening by the product form, then exact distances for the survivors
                near = _squares(part[qs], self.X[rs]) <= ((limit + 1e-6) ** 2 + 1e-6)[:, None]
                i, j = np.nonzero(near)
                i, j = qs[i], rs[j]
                dist = np.sqrt(((part[i] - self.X[j]) ** 2).sum(1))
                ok = np.round(dist, DIGITS) <= bound[s + i] + _SLACK
                yield s + i[ok], j[ok], dist[ok]
            yield None

    def counts(self, Q: np.ndarray, weight: np.ndarray, eps: float, enough: int) -> np.ndarray:
        """Weight of the points within ``eps`` of each query, exact below
        ``enough``: cells inside the ball count whole, others are only opened
        for queries that still need them."""
        out = np.zeros(len(Q), dtype=np.int64)
        if len(Q) and self.spread(Q, np.full(len(Q), eps)):
            for s in range(0, len(Q), SUB):
                open_ = np.arange(s, min(s + SUB, len(Q)))
                for a in range(0, len(self.X), PART):
                    rows = np.arange(a, min(a + PART, len(self.X)))
                    out[open_] += self.near(Q[open_], rows, eps) @ weight[rows]
                    open_ = open_[out[open_] < enough]
                    if not len(open_):
                        break
            return out
        held = np.zeros(len(self.tree.first), dtype=np.int64)
        for n, rows in self.rows.items():
            held[n] = weight[rows].sum()
        row, leaf = self.tree.visit(Q, np.full(len(Q), eps))
        inside = self.inside(Q, row, leaf, eps)
        np.add.at(out, row[inside], held[leaf[inside]])
        row, leaf = row[~inside], leaf[~inside]
        order = np.argsort(leaf, kind="stable")
        row, leaf = row[order], leaf[order]
        edge = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])) if len(leaf) else []
        for a, b in zip(edge, [*edge[1:], len(leaf)]):
            q = row[a:b]
            q = q[out[q] < enough]
            for s in range(0, len(q), SUB):
                rows = self.rows[leaf[a]]
                out[q[s:s + SUB]] += self.near(Q[q[s:s + SUB]], rows, eps) @ weight[rows]
        return out

    def inside(self, Q: np.ndarray, row: np.ndarray, leaf: np.ndarray, eps: float) -> np.ndarray:
        """Whether the whole cell lies within ``eps`` of the query."""
        out = np.zeros(len(row), dtype=bool)
        for c in range(0, len(row), 1 << 15):
            r, n = row[c:c + (1 << 15)], leaf[c:c + (1 << 15)]
            out[c:c + (1 << 15)] = np.sqrt(((Q[r] - self.tree.centre[n]) ** 2).sum(1)) + self.tree.radius[n] <= eps - 1e-8
        return out

    def near(self, Q: np.ndarray, rows: np.ndarray, eps: float) -> np.ndarray:
        """Matrix of Q against some points: distance (rounded) within ``eps``."""
        d2 = _squares(Q, self.X[rows])
        out = d2 <= max(eps - 1e-6, 0.0) ** 2
        i, j = np.nonzero(~out & (d2 <= (eps + 1e-6) ** 2 + 1e-6))  # exact distances near the edge
        out[i, j] = np.round(np.sqrt(((Q[i] - self.X[rows[j]]) ** 2).sum(1)), DIGITS) <= eps
        return out

    def spanning(self, Q: np.ndarray, eps: float, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Links that join what distances within ``eps`` join: (query, point)
        and (point, point) pairs, at most one per query and per point.

        The points of a cell no wider than ``eps`` are linked outright; a query
        is linked to one point of every group that it touches, and the groups
        become one (union-find over whole labels).  ``group`` names, by one of
        its points, the group that each point is known to be in: such points
        need no links among them."""
        known = group is not None
        group = group.copy() if known else np.arange(len(self.X))
        stars = []
        for n, rows in self.rows.items():
            if not known and 2 * self.tree.radius[n] <= eps - 1e-8:
                group[rows] = rows[0]
                stars.append(rows)
        star_a = np.concatenate([np.full(len(r) - 1, r[0]) for r in stars]) if stars else np.zeros(0, np.int64)
        star_b = np.concatenate([r[1:] for r in stars]) if stars else np.zeros(0, np.int64)
        tight = np.zeros(len(self.tree.first), dtype=bool)
        for n, rows in self.rows.items():
            tight[n] = not known and 2 * self.tree.radius[n] <= eps - 1e-8
        links_q, links_r = [], []
        dense = len(Q) > 0 and self.spread(Q, np.full(len(Q), eps))
        for s in range(0, len(Q), SUB):
            part = Q[s:s + SUB]
            if dense:
                self._joined(part, s, eps, group, links_q, links_r)
                continue
            row, leaf = self.tree.visit(part, np.full(len(part), eps))
            inside = self.inside(part, row, leaf, eps)
            touched: list[list[np.ndarray]] = [[] for _ in range(len(part))]
            order = np.lexsort((leaf, inside))
            for i in order[np.flatnonzero(inside[order])].tolist():
                rows = self.rows[leaf[i]]
                touched[row[i]].append(rows[:1] if tight[leaf[i]] else rows)
            out = np.flatnonzero(~inside)
            out = out[np.argsort(leaf[out], kind="stable")]
            edge = np.flatnonzero(np.concatenate([[True], leaf[out][1:] != leaf[out][:-1]])) if len(out) else []
            for a, b in zip(edge, [*edge[1:], len(out)]):
                q, rows = row[out[a:b]], self.rows[leaf[out[a]]]
                near = self.near(part[q], rows, eps)
                if tight[leaf[out[a]]]:  # one point of a linked cell stands for it
                    for i in np.flatnonzero(near.any(axis=1)).tolist():
                        touched[q[i]].append(rows[near[i].argmax():][:1])
                else:
                    for i in np.flatnonzero(near.any(axis=1)).tolist():
                        touched[q[i]].append(rows[near[i]])
            for i, t in enumerate(touched):
                if not t:
                    continue
                names = np.unique(group[np.concatenate(t)])
                links_q += [s + i] * len(names)
                links_r += names.tolist()
                if len(names) > 1:
                    group[np.isin(group, names[1:])] = names[0]
        return np.array(links_q, dtype=np.int64), np.array(links_r, dtype=np.int64), star_a, star_b

    def _joined(self, part: np.ndarray, s: int, eps: float, group: np.ndarray, links_q: list, links_r: list) -> None:
        """Links of some queries where cells are not told apart: one point of
        the largest group will do, the points outside it are all looked at."""
        names, sizes = np.unique(group, return_counts=True)
        main = names[sizes.argmax()]
        hit = np.full(len(part), -1, dtype=np.int64)
        rest, of = np.arange(len(part)), np.flatnonzero(group == main)
        for a in range(0, len(of), PART):
            near = self.near(part[rest], of[a:a + PART], eps)
            found = near.any(axis=1)
            hit[rest[found]] = of[a + near[found].argmax(axis=1)]
            rest = rest[~found]
            if not len(rest):
                break
        of = np.flatnonzero(group != main)
        pieces = [np.zeros((2, 0), dtype=np.int64)]
        for a in range(0, len(of), PART):
            i, j = np.nonzero(self.near(part, of[a:a + PART], eps))
            pieces.append(np.stack([i, of[a + j]]))
        i, j = np.concatenate(pieces, axis=1)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        edge = np.searchsorted(i, np.arange(len(part) + 1))
        for q in range(len(part)):
            touched = j[edge[q]:edge[q + 1]]
            if hit[q] >= 0:
                touched = np.append(touched, hit[q])
            if not len(touched):
                continue
            kinds = np.unique(group[touched])
            links_q += [s + q] * len(kinds)
            links_r += kinds.tolist()
            if len(kinds) > 1:
                group[np.isin(group, kinds)] = main if main in kinds else kinds[0]

    def reach(self, Q: np.ndarray, weight: np.ndarray, need: int) -> np.ndarray:
        """Distance within which each query has points of ``need`` weight: the
        true one inside its own cell, or a bound from the balls around it."""
        held = {n: weight[r].sum() for n, r in self.rows.items()}
        total = np.array([held.get(n, 0) for n in range(len(self.tree.first))])
        for n in range(len(total) - 1, -1, -1):
            if self.tree.children[n]:
                total[n] = total[self.tree.first[n]:self.tree.first[n] + self.tree.children[n]].sum()
        out = np.full(len(Q), np.inf)
        at = np.zeros(len(Q), dtype=np.int64)
        while len(own := np.flatnonzero(at >= 0)):
            for n in np.unique(at[own]).tolist():
                q = own[at[own] == n]
                if total[n] >= need:
                    away = np.sqrt(((Q[q] - self.tree.centre[n]) ** 2).sum(1))
                    out[q] = np.minimum(out[q], (away + self.tree.radius[n]) * (1 + _SLACK) + _SLACK)
                if self.tree.children[n]:
                    first = self.tree.first[n]
                    at[q] = first + _nearest(Q[q], self.tree.centre[first:first + self.tree.children[n]])
                    continue
                at[q] = -1
                if total[n] >= need:
                    rows = self.rows[n]
                    dist = np.sqrt(_squares(Q[q], self.X[rows]))
                    order = np.argsort(dist, axis=1)
                    enough = np.argmax(np.cumsum(weight[rows][order], axis=1) >= need, axis=1)
                    kth = dist[np.arange(len(q)), order[np.arange(len(q)), enough]]
                    out[q] = np.minimum(out[q], kth + 1e-6 * (1.0 + kth))
        return out


class Blocks:
    """Points (id, v, ...) of a written table dealt to the leaves and chunks of a
    metric tree."""

    def __init__(self, points: DataFrame, block: int | None, seed: int = DEFAULT_SEED):
        some = points.agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v")).head()
        n, self.d = some.n, len(some.v) if some.n else 1
        block = block or max(BLOCK, min(4 * BLOCK, WIDE // self.d))
        self.block = block
        tree = Tree(np.asarray(some.v, dtype=np.float64) if n else np.zeros(1))
        whole, stuck = {0: n}, set()
        while big := sorted(x for x, c in whole.items() if c > block and x not in stuck):
            at = self._routed(points, tree).where(F.col("leaf").isin(big)) if len(tree.first) > 1 else points.withColumn("leaf", F.lit(0))
            nth = Window.partitionBy("leaf").orderBy(F.xxhash64(F.lit(seed), "v"))
            drawn = at.select("leaf", "v", F.row_number().over(nth).alias("_nth")).where(F.col("_nth") <= FAN).collect()
            for leaf in big:
                tree.split(leaf, np.stack([np.asarray(r.v, dtype=np.float64) for r in drawn if r.leaf == leaf]))
            counts = {r.leaf: r.n for r in self._routed(points, tree).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
            for leaf in big:  # equal or nearly equal points: chunks, not pivots
                kids = range(tree.first[leaf], tree.first[leaf] + tree.children[leaf])
                stuck.update(k for k in kids if counts.get(k, 0) == whole[leaf])
            whole = counts
        if len(tree.first) == 1:
            routed = points.withColumn("leaf", F.lit(0))
        else:
            self.pack = self._packed(whole, tree, block)
            routed = self._routed(points, tree)
        chunks = {x: math.ceil(c / block) for x, c in whole.items() if c > block}
        chunk = F.lit(0)
        for leaf, c in chunks.items():
            chunk = F.when(F.col("leaf") == leaf, F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(c)).cast("int")).otherwise(chunk)
        self.points = routed.withColumn("chunk", chunk)
        if len(tree.first) > 1:
            self.points = materialize(self.points.withColumn("pack", self._pack_of("leaf")), "blocks")
        self.chunks = chunks
        if len(tree.first) > 1:
            tree.radius = [-np.inf] * len(tree.first)
            centres = np.stack(tree.centre)

            @F.pandas_udf("double")
            def away(v: pd.Series, leaf: pd.Series) -> pd.Series:
                return pd.Series(np.sqrt(((vectors(v, centres.shape[1]) - centres[leaf.to_numpy()]) ** 2).sum(1)))

            for r in self.points.groupBy("leaf").agg(F.max(away("v", "leaf")).alias("r")).collect():
                tree.radius[r.leaf] = r.r * (1 + _SLACK)
            self.points = self.points.withColumn("leaf", F.col("pack")).drop("pack")
            for n, c in enumerate(tree.children):
                if c:
                    tree.radius[n] = np.inf
        self.tree = tree.freeze()

    @staticmethod
    def _packed(whole: dict[int, int], tree: Tree, block: int) -> np.ndarray:
        """Block of every leaf: leaves in a row share one, named after its first,
        as long as they hold ``block`` points or fewer together."""
        out = np.arange(len(tree.first), dtype=np.int32)
        first, held = -1, 0
        for n in np.flatnonzero(np.asarray(tree.children) == 0).tolist():
            c = whole.get(n, 0)
            if first < 0 or held + c > block:
                first, held = n, 0
            out[n], held = first, held + c
        return out

    def _pack_of(self, leaf: str) -> Column:
        pack = self.pack

        @F.pandas_udf("int")
        def block_of(x: pd.Series) -> pd.Series:
            return pd.Series(pack[x.to_numpy()])

        return block_of(leaf)

    @staticmethod
    def _routed(points: DataFrame, tree: Tree) -> DataFrame:
        @F.pandas_udf("int")
        def leaf(v: pd.Series) -> pd.Series:
            return pd.Series(tree.route(vectors(v, len(tree.centre[0]))).astype(np.int32))

        return points.withColumn("leaf", leaf("v"))

    def own(self, queries: DataFrame) -> DataFrame:
        """``queries`` with the block (``leaf``, the first of its leaves) and chunk that they would belong to."""
        out = queries.withColumn("leaf", F.lit(0)) if len(self.tree.first) == 1 else self._routed(queries, self.tree).withColumn("leaf", self._pack_of("leaf"))
        chunk = F.lit(0)
        for leaf, c in self.chunks.items():
            chunk = F.when(F.col("leaf") == leaf, F.pmod(F.xxhash64("v"), F.lit(c)).cast("int")).otherwise(chunk)
        return out.withColumn("chunk", chunk)

    def within(self, queries: DataFrame, bound: Column) -> DataFrame:
        """``queries`` once per block and chunk that comes within ``bound``."""
        tree, d = self.tree, self.d
        pack = None if len(tree.first) == 1 else self.pack
        if len(tree.first) == 1:
            leaf = F.array(F.lit(0))
        else:
            @F.pandas_udf(T.ArrayType(T.IntegerType()))
            def leaves(v: pd.Series, b: pd.Series) -> pd.Series:
                row, node = tree.visit(vectors(v, d), b.to_numpy(np.float64))
                pairs = np.unique(row * len(pack) + pack[node])
                row, node = pairs // len(pack), pairs % len(pack)
                parts = np.split(node.astype(np.int32), np.searchsorted(row, np.arange(1, len(v))))
                return pd.Series([p.tolist() for p in parts[:len(v)]])

            leaf = leaves("v", bound.cast("double"))
        out = self.short(queries.withColumn("leaf", leaf)).withColumn("leaf", F.explode("leaf"))
        last = F.lit(0)
        for x, c in self.chunks.items():
            last = F.when(F.col("leaf") == x, F.lit(c - 1)).otherwise(last)
        return out.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))

    @staticmethod
    def short(rows: DataFrame) -> DataFrame:
        """``rows`` with single-precision vectors ``f`` wherever they lose
        nothing, and ``v`` only elsewhere: a row travels to every block near it."""
        if "f" in rows.columns:
            return rows.select(*[F.col(c).alias(c) for c in rows.columns])
        short = F.col("v").cast("array<float>")
        exact = short.cast("array<double>") == F.col("v")
        return rows.select(*[F.col(c).alias(c) for c in rows.columns if c != "v"],
                           F.when(exact, short).alias("f"), F.when(~exact, F.col("v")).alias("v"))

    def solve(self, queries: DataFrame, fn, schema, points: DataFrame | None = None, ask: int | None = None,
              even: bool = False) -> DataFrame:
        """``fn(queries, points)`` (Arrow tables) for every (leaf, chunk), where
        at most about ``ask`` (``BLOCK``) queries meet a block at once.  ``points`` stands
        in for ``self.points`` (rows of it, with other columns).  Queries are not
        written: which blocks a row goes to is found again for the shuffle.

        ``even`` is for groups that take long for their size: they are dealt to
        partitions by their number, and take fewer queries where there would be
        fewer groups than tasks that run at once."""
        ask = ask or min(self.block, BLOCK)
        many = queries.groupBy("leaf", "chunk").agg(F.count(F.lit(1)).alias("n"))
        many = materialize(many, "parts") if even or len(self.tree.first) > 1 else many
        if even:
            at_once = many.sparkSession.sparkContext.defaultParallelism
            ask = min(ask, max(FEW, -(-(many.agg(F.sum("n")).first()[0] or 0) // at_once)))
        many = many.select("leaf", "chunk", F.ceil(F.col("n") / F.lit(ask)).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")
        left = self.short(queries).join(F.broadcast(many), ["leaf", "chunk"]).withColumn("part", part).drop("parts")
        right = self.short(self.points if points is None else points).join(F.broadcast(many), ["leaf", "chunk"])
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        left, right = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (left, right))  # names of their own, both sides may be one table
        by = ["leaf", "chunk", "part"]
        if even:
            tasks = min(4 * (many.agg(F.sum("parts")).first()[0] or 1), 16 * at_once)
            left, right = left.repartition(tasks, *by), right.repartition(tasks, *by)
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(fn, schema)


def _points(df: DataFrame, key: str, vec: str, keys: int) -> DataFrame:
    """(h, v, id, keys): distinct vectors with their ``keys`` smallest keys; the
    hash ``h`` goes first where vectors are sorted."""
    rows = _hashed(df.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"), F.col(key).alias("key")))
    same = Window.partitionBy("h", "v")
    least = rows.withColumn("_nth", F.row_number().over(same.orderBy(F.asc_nulls_last("key")))).where(F.col("_nth") <= keys)
    least = least.withColumn("keys", F.sort_array(F.collect_list("key").over(same))).where(F.col("_nth") == 1)
    return least.select("h", "v", F.get("keys", F.lit(0)).alias("id"), "keys")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.xxhash64("v"))


def _block(df: DataFrame, n_pivots: int | None) -> int | None:
    return min(BLOCK, max(1, -(-df.count() // n_pivots))) if n_pivots else None


def _combined(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


def _knn_in_block(need: int, d: int, first: bool):
    """Solver of a block: the ``need`` nearest keys of each query, with the
    bound that comes from the block itself (first) or with the query."""
    def solve(q: pa.Table, r: pa.Table) -> pa.Table:
        Q, R = matrix(q, d), matrix(r, d)
        keys = _combined(r.column("keys"))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        if len(Q) and len(R):
            cells = Cells(R)
            sizes = np.diff(keys.offsets.to_numpy())
            begin, flat = keys.offsets.to_numpy(), keys.values
            values = flat.to_numpy(zero_copy_only=False)
            bound = cells.tighten(Q, need, cells.reach(Q, sizes, need)) if first else q.column("bound").to_numpy()
            rows: list[tuple] = []
            for part in cells.pairs(Q, bound):
                if part is not None:
                    rows.append(part)
                    continue
                if rows:
                    i, j, dist = (np.concatenate(x) for x in zip(*rows))
                    rows.clear()
                    copies = sizes[j]
                    at = np.repeat(begin[j], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                    i, dist = np.repeat(i, copies), np.repeat(dist, copies)
                    rd = np.round(dist, DIGITS)
                    order = np.lexsort((values[at], rd, i))
                    i, at, rd, dist = i[order], at[order], rd[order], dist[order]
                    top = np.arange(len(i)) - np.searchsorted(i, i, "left") < need
                    found.append((i[top], at[top], rd[top], dist[top]))
        i, at, rd, dist = (np.concatenate(x) for x in zip(*found))  # by query: sub-batches follow one another
        near = pa.StructArray.from_arrays([pa.array(rd), keys.values.take(pa.array(at)), pa.array(dist)], ["rd", "key", "dist"])
        ends = np.searchsorted(i, np.arange(len(Q) + 1)).astype(np.int32)
        out = {"id": q.column("id"), "found": pa.ListArray.from_arrays(pa.array(ends), near)}
        if first:
            out = {"id": q.column("id"), "v": pa.ListArray.from_arrays(pa.array(np.arange(len(Q) + 1, dtype=np.int32) * d), pa.array(Q.ravel())), "leaf": q.column("leaf"), "chunk": q.column("chunk"), "found": out["found"]}
        return pa.table(out)

    return solve


def neighbour_lists(query: DataFrame, ref: DataFrame, key: str, vec: str, need: int, n_pivots: int | None = None,
                    seed: int = DEFAULT_SEED, known: DataFrame | None = None) -> DataFrame:
    """(h, v, found): for every distinct vector of ``query`` (and those of
    ``known``) its ``need`` nearest ``ref`` rows, (key, dist) by (distance rounded
    to 9 dp, key).

    ``known`` holds such lists of the same ``ref`` rows, of ``need`` or more
    rows each: vectors that are there are not searched again."""
    kind, q_kind = (x.schema[key].dataType.simpleString() for x in (ref, query))
    asked = None
    if known is not None:
        known = known.select("h", "v", F.slice("found", 1, need).alias("found"))
        asked = materialize(_points(query, key, vec, 1).select("h", "v", "id").join(known.select("h", "v"), ["h", "v"], "left_anti"), "asked")
        if asked.isEmpty():
            return known
    refs = materialize(_points(ref, key, vec, need), "ref_points")
    if asked is None:
        asked = refs.drop("keys") if query is ref else _points(query, key, vec, 1).drop("keys")
    asked = asked.select("id", "v")
    blocks = Blocks(refs.drop("h"), _block(refs, n_pivots), seed)
    one = f"found array<struct<rd:double,key:{kind},dist:double>>"
    first = blocks.solve(blocks.own(asked), _knn_in_block(need, blocks.d, True), f"id {q_kind}, v array<double>, leaf int, chunk int, {one}",
                         ask=max(1, min(blocks.block, BLOCK) // 2), even=True)
    if len(blocks.tree.first) > 1 or blocks.chunks:
        first = materialize(first, "own_blocks")
        kth = F.when(F.size("found") >= need, F.element_at("found", need)["dist"]).otherwise(F.lit(float("inf")))
        rest = blocks.within(first.select("id", "v", kth.alias("bound"), F.col("leaf").alias("_leaf"), F.col("chunk").alias("_chunk")), F.col("bound"))
        rest = rest.where("leaf <> _leaf or chunk <> _chunk").drop("_leaf", "_chunk")
        more = blocks.solve(rest, _knn_in_block(need, blocks.d, False), f"id {q_kind}, {one}", even=True)
        more = more.groupBy("id").agg(F.flatten(F.collect_list("found")).alias("more"))
        merged = F.slice(F.sort_array(F.concat("found", F.coalesce("more", F.array()))), 1, need)
        first = first.join(more, "id", "left").select("v", F.when(F.col("more").isNull(), F.col("found")).otherwise(merged).alias("found"))
    out = _hashed(first).select("h", "v", F.transform("found", lambda x: F.struct(x["key"].alias("key"), x["dist"].alias("dist"))).alias("found"))
    out = materialize(out, "lists")
    return out if known is None else known.unionByName(out)


def ranked(lists: DataFrame, query: DataFrame, key: str, vec: str, k: int, exclude_self: bool = False) -> DataFrame:
    """(q_key, r_key, dist, rank) of every ``query`` row from the lists of the vectors."""
    rows = _hashed(query.where(F.col(vec).isNotNull()).select(F.col(key).alias("q_key"), F.col(vec).cast("array<double>").alias("v")))
    best = F.col("found")
    if exclude_self:
        best = F.expr("filter(found, x -> x.key <> q_key)")
    out = rows.join(lists, ["h", "v"]).select("q_key", F.posexplode(F.slice(best, 1, k)).alias("_at", "b"))
    out = out.select("q_key", F.col("b.key").alias("r_key"), F.col("b.dist").alias("dist"), (F.col("_at") + 1).alias("rank"))
    return materialize(out, "neighbours")


def knn(query: DataFrame, ref: DataFrame, key: str, vec: str, k: int, exclude_self: bool = False,
        n_pivots: int | None = None, seed: int = DEFAULT_SEED, known: DataFrame | None = None) -> DataFrame:
    """The k nearest ``ref`` rows of every ``query`` row:
    (q_key, r_key, dist, rank), rank 1..k by (distance rounded to 9 dp, key).

    ``n_pivots`` aims at that many leaves or more, where blocks are to be
    smaller than ``BLOCK``.  ``known``: see ``neighbour_lists``."""
    need = k + 1 if exclude_self else k
    lists = neighbour_lists(query, ref, key, vec, need, n_pivots, seed, known)
    return ranked(lists, query, key, vec, k, exclude_self)


def radius_join(query: DataFrame, ref: DataFrame, key: str, vec: str, eps: float,
                n_pivots: int | None = None, seed: int = DEFAULT_SEED) -> DataFrame:
    """Every (query, ref) pair with distance <= eps (self pairs included)."""
    def rows(df: DataFrame) -> DataFrame:
        return df.where(F.col(vec).isNotNull()).select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"))

    blocks = Blocks(materialize(rows(ref), "ref_points"), _block(ref, n_pivots) or BLOCK, seed)
    d, kinds = blocks.d, [x.schema[key].dataType.simpleString() for x in (query, ref)]

    def solve(q: pa.Table, r: pa.Table) -> pa.Table:
        Q, R = matrix(q, d), matrix(r, d)
        qk, rk = q.column("id").combine_chunks(), r.column("id").combine_chunks()
        found = [p for p in Cells(R).pairs(Q, np.full(len(Q), eps)) if p is not None] if len(Q) and len(R) else []
        i, j, dist = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        ok = np.round(dist, DIGITS) <= eps
        return pa.table({"q_key": qk.take(pa.array(i[ok])), "r_key": rk.take(pa.array(j[ok])), "dist": pa.array(dist[ok])})

    near = blocks.within(rows(query), F.lit(float(eps)))
    # pairs may be many: they are not written before they are used
    return blocks.solve(near, solve, f"q_key {kinds[0]}, r_key {kinds[1]}, dist double")
