"""Exact top-k search by inner product with two cover trees.

Queries and data are both indexed by cover trees: a node's children are chosen
so that they are farther than ``radius / BASE`` apart and every point below the
node is within that distance of one of them.  A query node and a data node with
centres q and r and covering radii a and b hold no pair whose inner product is
above

    q.r + a |r| + b |q| + a b,

so the pair of nodes is pruned when that is below the worst kth score found so
far in the query node's group.  Bounds are floating point with slack; scores
are exact integers.

Scale: queries are taken in blocks of ``QUERY_BLOCK`` (a bound, whatever the
size of the table), whose tree goes to every task with its code; every data split is streamed in
chunks of ``CHUNK`` rows, each indexed and searched in turn, and leaves k rows
a query.  Data isn't shuffled or copied, and equal vectors are spread like any
others.  Per query the k rows of every split are merged by one grouped window.

Defined cases: a vector that is null, or holds null or non-finite components,
and a row without an id take no part; vectors are only compared with those of
the same length; rows with the query's id are its own and no candidates; other
repeated rows each take a place; a query given twice is answered once; ties go
to the smaller id; an empty table gives an empty result; further columns of the
input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import python_ready, settle

K = 10
QUERY_BLOCK = 20_000
CHUNK, BASE = 4096, 1.3
#: Points of a leaf: of data, and of queries, whose groups are kept tight since one worst score stands for each.
LEAF, QUERY_LEAF = 32, 4
_NONE = np.iinfo(np.int64).min
_SLACK = 1e-9


@dataclass
class CoverTree:
    """Nodes in arrays; ``children`` and ``points`` by node (points of leaves only)."""

    x: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    children: list[np.ndarray]
    points: list[np.ndarray]

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = LEAF) -> CoverTree:
        """Of float64 rows (at least one)."""
        square = np.einsum("ij,ij->i", x, x)

        def away(rows: np.ndarray, c: int) -> np.ndarray:
            return np.sqrt(np.maximum(square[rows] + square[c] - 2 * (x[rows] @ x[c]), 0.0))

        every = np.arange(len(x))
        centres, radii, children, points = [0], [0.0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(0, every, away(every, 0))]
        while todo:
            node, rows, far = todo.pop()
            radii[node] = float(far.max())
            if len(rows) <= leaf or radii[node] <= 1e-9:
                points[node] = rows
                continue
            cover, best, owner, chosen = radii[node] / BASE, far.copy(), np.zeros(len(rows), np.int64), [centres[node]]
            while best[k := int(best.argmax())] > cover:
                d = away(rows, int(rows[k]))
                closer = d < best
                closer[k] = True
                d[k] = 0.0
                best[closer], owner[closer] = d[closer], len(chosen)
                chosen.append(int(rows[k]))
            below = []
            for k, c in enumerate(chosen):
                own = owner == k
                if own.any():
                    below.append(len(centres))
                    todo.append((len(centres), rows[own], best[own]))
                    centres.append(c)
                    radii.append(0.0)
                    children.append(np.zeros(0, np.int64))
                    points.append(np.zeros(0, np.int64))
            children[node] = np.array(below)
        centre = x[centres]
        return cls(x, centre, np.array(radii) * (1 + _SLACK), np.sqrt(square[centres]), children, points)


class Search:
    """The best k of the data seen so far for every query."""

    def __init__(self, tree: CoverTree, ids: np.ndarray, k: int):
        self.tree, self.ids, self.k = tree, ids, k
        self.score = np.full((len(ids), k), _NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.exact = tree.x.astype(np.int64)
        self.top = float(np.abs(tree.x).max(initial=0.0))

    def see(self, x: np.ndarray, ids: np.ndarray) -> None:
        """More data: integer rows and their ids."""
        data = CoverTree.build(x.astype(np.float64))
        # products below 2 ** 53 are exact in floating point, which is faster
        largest = self.top * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, x.shape[1])
        fits = 53 if largest < 2**53 else 63 if largest < 2**62 else 0
        self._descend(0, np.array([0]), data, ids, x, fits)

    def _bounds(self, q: int, nodes: np.ndarray, data: CoverTree) -> np.ndarray:
        t = self.tree
        a, b, n = t.radius[q], data.radius[nodes], data.norm[nodes]
        at = data.centre[nodes] @ t.centre[q] + a * n + b * t.norm[q] + a * b
        return at + np.abs(at) * _SLACK + 1e-3

    def _worst(self, rows: np.ndarray) -> int:
        return int(self.score[rows, -1].min())

    def _rows(self, q: int) -> np.ndarray:
        """All queries below a node."""
        found, todo = [], [q]
        while todo:
            n = todo.pop()
            found.append(self.tree.points[n])
            todo += self.tree.children[n].tolist()
        return np.concatenate(found)

    def _descend(self, q: int, nodes: np.ndarray, data: CoverTree, ids: np.ndarray, x: np.ndarray, fits: int) -> None:
        worst = self._worst(self._rows(q))
        nodes = nodes[self._bounds(q, nodes, data) >= worst]
        if not nodes.size:
            return
        if self.tree.children[q].size:
            opened = np.concatenate([data.children[n] if data.children[n].size else np.array([n]) for n in nodes])
            for child in self.tree.children[q]:
                self._descend(int(child), opened, data, ids, x, fits)
            return
        rows = self.tree.points[q]
        leaves = []
        while nodes.size:  # down to leaves
            nodes = nodes[self._bounds(q, nodes, data) >= worst]
            leaves += [n for n in nodes if not data.children[n].size]
            inner = [data.children[n] for n in nodes if data.children[n].size]
            nodes = np.concatenate(inner) if inner else np.zeros(0, np.int64)
        if not leaves:
            return
        order = np.array(leaves)
        bound = self._bounds(q, order, data)
        order = order[np.argsort(-bound, kind="stable")]
        bound = -np.sort(-bound)
        for k in range(0, len(order), 16):  # the most promising first
            if bound[k] < self._worst(rows):
                break
            self._compare(rows, np.concatenate([data.points[n] for n in order[k : k + 16]]), x, ids, fits)

    def _compare(self, rows: np.ndarray, points: np.ndarray, x: np.ndarray, ids: np.ndarray, fits: int) -> None:
        if fits == 53:
            s = (self.tree.x[rows] @ x[points].T.astype(np.float64)).astype(np.int64)
        elif fits:
            s = self.exact[rows] @ x[points].T
        else:  # Python's integers have no bound
            s = np.clip(self.exact[rows].astype(object) @ x[points].T.astype(object), _NONE + 1, -(_NONE + 1)).astype(np.int64)
        s[self.ids[rows][:, None] == ids[points][None, :]] = _NONE
        some = (s >= np.maximum(self.score[rows, -1], _NONE + 1)[:, None]).any(axis=0)
        if not some.any():
            return
        s = np.concatenate([self.score[rows], s[:, some]], axis=1)
        i = np.concatenate([self.found[rows], np.broadcast_to(ids[points[some]], (len(rows), int(some.sum())))], axis=1)
        order = np.lexsort((i, -(s + 1)), axis=1)[:, : self.k]  # + 1: the least integer has no negative
        self.score[rows], self.found[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def quantised(vector: Column) -> Column:
    """Components as floor(1024 * x); null if the vector, a component or its finiteness is missing."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("long")))


def search(vectors: DataFrame, k: int = K, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of rows (vec_id, embedding) for each id divisible by ``every``."""
    python_ready(vectors.sparkSession, CHUNK)
    rows = vectors.select("vec_id", quantised(F.col("embedding")).alias("q")).where("vec_id is not null and q is not null")
    rows = settle(rows)
    queries = settle(rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "q"]))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = []
    for b in range(blocks):
        # hashed blocks are uneven by little; a block is all that the driver ever holds of the queries
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id", "q").toArrow()
        by_length: dict[int, tuple[list[int], list[list[int]]]] = {}
        for i, q in zip(block.column("vec_id").to_pylist(), block.column("q").to_pylist(), strict=True):
            ids, own = by_length.setdefault(len(q), ([], []))
            ids.append(i)
            own.append(q)
        trees = {n: (CoverTree.build(np.array(own, dtype=np.float64).reshape(len(own), n), QUERY_LEAF), np.array(ids)) for n, (ids, own) in by_length.items()}
        parts.append(rows.mapInArrow(_searcher(trees, k), "query_id long, q long, vec_id long, score long"))
    if not parts:
        parts = [rows.mapInArrow(_searcher({}, k), "query_id long, q long, vec_id long, score long")]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searcher(trees: dict[int, tuple[CoverTree, np.ndarray]], k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {n: Search(t, ids, k) for n, (t, ids) in trees.items()}
        for batch in batches:
            q = batch.column("q")
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            ends = q.offsets.to_numpy()
            flat, length = q.values.to_numpy(zero_copy_only=False), np.diff(ends)
            for n in np.unique(length):
                if int(n) in state:
                    own = np.flatnonzero(length == n)
                    x = flat[(ends[own][:, None] + np.arange(n)[None, :])].reshape(len(own), n)
                    for c in range(0, len(own), CHUNK):
                        state[int(n)].see(x[c : c + CHUNK], ids[own[c : c + CHUNK]])
        for n, s in state.items():
            at, place = np.nonzero(s.score > _NONE)
            columns = [s.ids[at], at + (n << 32), s.found[at, place], s.score[at, place]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "q", "vec_id", "score"])

    return run
