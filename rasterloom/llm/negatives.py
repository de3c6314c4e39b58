"""Hard negatives by vantage-point trees over norm-augmented vectors.

With ``M`` the largest norm of a block, a vector x becomes (x, sqrt(M^2 - |x|^2))
and an anchor q becomes (q, 0), so that |q - x|^2 = |q|^2 + M^2 - 2 <q, x>: scores
fall as distances rise, and a window of scores is an annulus about the anchor.
Candidates are dealt to blocks of bounded size by a hash of their id; each block
is written as one row with its tree.  A search takes the tree's parts nearest
first, leaves out what lies inside or outside the annulus, and ends once no part
that is left can hold a row before the k-th.  Distances carry a slack for
rounding and only rule parts out; scores are exact integers, and decide.
Anchors walk a tree many at a time (``Asks``): each opens its nearest parts, in
rounds of growing size, and a part is scored once for all that open it in a round.
Where products exceed what float64 holds exactly, an anchor walks alone (``Search``).

First each anchor's positives are found (any score, same label), then for each of
its positives the different-label rows within the window.  Trees are dealt to a
bounded number of groups; every group's task holds its trees and lets the anchors
stream past, which takes a copy of the anchors a group.  An anchor's k-th score in
one tree is a floor in the group's next, and a group yields k rows an anchor (and
positive) at most.  No join pairs anchors with trees: behind an explode Spark takes
the copies for as few bytes as the anchors, and would send them all to the driver.

Defined results: rows with a null id, a null label, a null vector, or a null or
non-finite component take no part; rows alike in id, label and vector count once;
other rows of an anchor's id are neither its positives nor its negatives; rows of
one id with several vectors or labels are anchors each; vectors of unequal length
count as padded with zeros; ties go to the smaller id; scores are cut to 64 bits;
a positive without rows in its window gives none; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import MOST_TASKS, Scratch, materialize
from rasterloom.llm.topk import EXACT, exact_scores, quantised

BLOCK, ANCHORS, LEAF = 4096, 256, 128
#: Groups of trees, each with a copy of the anchors; more only where one would hold over HELD trees.
GROUPS, HELD = 48, 32
#: Rows found by a walk that are held before the best are kept.
FOUND = 1 << 16
_TREE = "c long, dims long, ids binary, labels binary, vectors binary, nodes binary, bounds binary"
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Tree:
    """A vantage-point tree of one block; its rows stand in the order of its leaves.

    ``nodes``: (first, last, vantage, left, right), vantage -1 in a leaf; ``bounds``: least
    and largest distance to the vantage in the left and the right part.
    """

    def __init__(self, ids, labels, vectors, nodes=None, bounds=None):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.largest = np.abs(vectors).max(initial=0.0)
        self.scale = max(1.0, self.largest)  # keeps squares finite
        small = vectors / self.scale
        squares = (small * small).sum(axis=1)
        self.most = squares.max(initial=0.0)
        self.points = np.concatenate([small, np.sqrt(self.most - squares)[:, None]], axis=1)
        self.nodes, self.bounds = (nodes, bounds) if nodes is not None else self._grow()

    def _grow(self):
        order, nodes, bounds, todo = np.arange(len(self.ids)), [[0, len(self.ids), -1, -1, -1]], [[0.0] * 4], [0]
        while todo:
            at = todo.pop()
            a, z = nodes[at][:2]
            if z - a <= LEAF:
                continue
            part = order[a:z]
            vantage = part[np.argmax(self._distances(part[0], part))]
            d = self._distances(vantage, part)
            by = np.lexsort((self.ids[part], d))
            order[a:z], d, mid = part[by], d[by], (z - a) // 2
            nodes[at][2:] = [vantage, len(nodes), len(nodes) + 1]
            bounds[at] = [d[0], d[mid - 1], d[mid], d[-1]]
            todo += [len(nodes), len(nodes) + 1]
            nodes += [[a, a + mid, -1, -1, -1], [a + mid, z, -1, -1, -1]]
            bounds += [[0.0] * 4, [0.0] * 4]
        self.ids, self.labels, self.vectors, self.points = (x[order] for x in (self.ids, self.labels, self.vectors, self.points))
        place = np.argsort(order)
        return [[a, z, int(place[v]) if v >= 0 else -1, x, y] for a, z, v, x, y in nodes], bounds

    def _distances(self, vantage, part):
        return np.sqrt(((self.points[part] - self.points[vantage]) ** 2).sum(axis=1))


class Search:
    """One anchor's searches in a tree."""

    def __init__(self, tree: Tree, own: int, q: np.ndarray):
        self.tree, self.own, self.q = tree, own, q
        small = q / tree.scale
        self.base = float(small @ small) + float(tree.most)
        self.slack = 1e-6 * (1 + self.base**0.5)
        self.small = np.append(small, 0.0)
        self.exact = max(np.abs(q).max(initial=0), 1) * max(tree.largest, 1) * max(1, len(q)) < EXACT
        self.leaves = 0

    def _radius(self, score: int) -> float:
        """Within it lie all rows of the score and higher ones."""
        return max(0.0, self.base - 2 * score / self.tree.scale**2) ** 0.5

    def _reach(self, distance: float) -> float:
        """No row from the distance on has a higher score; beyond 62 bits scores may have been cut, so nothing is told."""
        top = (self.base - max(0.0, distance) ** 2) / 2 * self.tree.scale**2
        return top + 1 if abs(top) < 1 << 62 else float("inf")

    def nearest(self, accept, low: int | None = None, high: int | None = None) -> Iterator[tuple[int, int]]:
        """(score, id) of the rows that ``accept`` takes by their labels, of scores from ``low`` to ``high``: nearest first, so higher scores first, then smaller ids.

        A row is told once no part that is left can hold a row before it; parts are only opened until then.
        """
        t = self.tree
        inner = 0.0 if high is None or abs(high) >= 1 << 62 else self._radius(high) - self.slack
        outer = float("inf") if low is None or abs(low) >= 1 << 62 else self._radius(low) + self.slack
        parts, rows = [(0.0, 0, float("inf"))] if len(t.ids) else [], []
        while parts or rows:
            reach = self._reach(parts[0][0]) if parts else -float("inf")
            while rows and -rows[0][0] > reach:
                score, i = heapq.heappop(rows)
                yield -score, i
            if not parts:
                continue
            near, at, far = heapq.heappop(parts)
            first, last, vantage, left, right = t.nodes[at]
            if vantage >= 0:
                gap = t.points[vantage] - self.small
                d, b = float(gap @ gap) ** 0.5, t.bounds[at]
                for child, lo, hi in ((left, b[0], b[1]), (right, b[2], b[3])):
                    least, most = max(near, d - hi - self.slack, lo - d - self.slack), min(far, d + hi + self.slack)
                    if least <= outer and most >= inner:
                        heapq.heappush(parts, (least, child, most))
                continue
            self.leaves += 1
            span = slice(first, last)
            s = (t.vectors[span] @ self.q).astype(np.int64) if self.exact else exact_scores(self.q, t.vectors[span])
            ok = accept(t.labels[span]) & (t.ids[span] != self.own)
            if low is not None:
                ok &= s >= low
            if high is not None:
                ok &= s <= high
            if ok.any():
                rows += zip((-s[ok]).tolist() if self.exact else [-x for x in s[ok].tolist()], t.ids[span][ok].tolist(), strict=True)
                heapq.heapify(rows)


class Asks:
    """What many anchors ask of trees, and the ``k`` best rows found so far for each ask: the highest scores, then the smallest ids.

    ``of``: the place of an ask's anchor, ascending; scores lie from ``low`` to ``high``; rows are of the anchor's label, or of others if not ``same``.
    """

    def __init__(self, own: np.ndarray, labels: np.ndarray, q: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.own, self.labels, self.q, self.of, self.high, self.same, self.k = own, labels, q, of, high, same, k
        self.floor = low.copy()
        self.first, self.n = np.searchsorted(of, np.arange(len(own))), np.bincount(of, minlength=len(own))
        self.asking = self.n > 0
        self.top = np.full(len(own), _LEAST)
        np.maximum.at(self.top, of, high)
        self.best = (np.zeros(0, np.int64),) * 3
        self._lower()

    def _lower(self) -> None:
        """The least score that some ask of an anchor still takes."""
        self.bar = np.full(len(self.own), _MOST)
        np.minimum.at(self.bar, self.of, self.floor)

    def take(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Offer rows to all asks of their anchors."""
        n = self.n[anchor]
        row = np.repeat(np.arange(len(anchor)), n)
        ask = self.first[anchor][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        fits = (score[row] >= self.floor[ask]) & (score[row] <= self.high[ask])
        self._keep(ask[fits], score[row[fits]], ids[row[fits]])

    def _keep(self, ask: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        ask, score, ids = (np.concatenate(x) for x in zip(self.best, (ask, score, ids), strict=True))
        order = np.lexsort((ids, ~score, ask))
        ask, score, ids = ask[order], score[order], ids[order]
        rank = np.arange(len(ask)) - np.searchsorted(ask, ask)
        last = rank == self.k - 1
        self.floor[ask[last]] = score[last]
        self.best = tuple(x[rank < self.k] for x in (ask, score, ids))
        self._lower()

    def accepts(self, labels: np.ndarray, of: np.ndarray) -> np.ndarray:
        return (labels == self.labels[of][:, None]) == self.same

    def walk(self, tree: Tree) -> int:
        """Search a tree for all asks; how many leaves were scored, once for each anchor."""
        d = tree.vectors.shape[1]  # rows have nothing in an anchor's dimensions beyond theirs
        q = np.pad(self.q, ((0, 0), (0, max(0, d - self.q.shape[1]))))[:, :d]
        exact = np.maximum(np.abs(q).max(axis=1, initial=0), 1) * max(tree.largest, 1) * max(1, d) < EXACT
        for i in np.flatnonzero(~exact & self.asking):
            self._alone(tree, int(i), q[i])
        live, leaves = exact & self.asking, 0
        if not live.any() or not len(tree.ids):
            return leaves
        small = np.where(live[:, None], q / tree.scale, 0.0)
        base = (small * small).sum(axis=1) + tree.most
        slack = 1e-6 * (1 + np.sqrt(base))
        radius = lambda score: np.sqrt(np.maximum(0.0, base - 2 * score.astype(float) / tree.scale**2))
        inner = np.where(np.abs(self.top.astype(float)) >= 1 << 62, 0.0, radius(self.top) - slack)
        spans, near, far = self._parts(tree, np.pad(small, ((0, 0), (0, 1))), slack)
        order = np.argsort(near, axis=1, kind="stable")
        near, far = np.take_along_axis(near, order, axis=1), np.take_along_axis(far, order, axis=1)
        at, step = 0, 1
        while at < len(spans):
            outer = np.where(np.abs(self.bar.astype(float)) >= 1 << 62, np.inf, radius(self.bar) + slack)
            live &= near[:, at] <= outer
            if not live.any():
                break
            part = slice(at, at + step)
            want = live[:, None] & (near[:, part] <= outer[:, None]) & (far[:, part] >= inner[:, None])
            self._open(tree, q, spans, np.where(want, order[:, part], -1))
            leaves += int(want.sum())
            at, step = at + step, 2 * step
        return leaves

    def _open(self, tree: Tree, q: np.ndarray, spans: list[slice], wanted: np.ndarray) -> None:
        """Score the leaves that each anchor wants."""
        found, held = [], 0
        for leaf in np.setdiff1d(wanted, [-1]):
            of, span = np.flatnonzero((wanted == leaf).any(axis=1)), spans[leaf]
            s = q[of] @ tree.vectors[span].T
            ok = (s >= self.bar[of][:, None]) & (s <= self.top[of][:, None]) & self.accepts(tree.labels[span], of)
            i, j = np.nonzero(ok & (tree.ids[span] != self.own[of][:, None]))
            found.append((of[i], s[i, j].astype(np.int64), tree.ids[span][j]))
            held += len(i)
            if held > FOUND:
                self.take(*map(np.concatenate, zip(*found, strict=True)))
                found, held = [], 0
        if held:
            self.take(*map(np.concatenate, zip(*found, strict=True)))

    @staticmethod
    def _parts(tree: Tree, small: np.ndarray, slack: np.ndarray) -> tuple[list[slice], np.ndarray, np.ndarray]:
        """The leaves, and each anchor's least and largest distance to them."""
        todo, spans, near, far = [(0, np.zeros(len(small)), np.full(len(small), np.inf))], [], [], []
        while todo:
            at, least, most = todo.pop()
            first, last, vantage, left, right = tree.nodes[at]
            if vantage < 0:
                spans.append(slice(first, last))
                near.append(least)
                far.append(most)
                continue
            gap = small - tree.points[vantage]
            d, b = np.sqrt((gap * gap).sum(axis=1)), tree.bounds[at]
            for child, lo, hi in ((left, b[0], b[1]), (right, b[2], b[3])):
                todo.append((child, np.maximum(least, np.maximum(d - hi, lo - d) - slack), np.minimum(most, d + hi + slack)))
        return spans, np.array(near).T, np.array(far).T

    def _alone(self, tree: Tree, i: int, q: np.ndarray) -> None:
        """One anchor's asks, whose products may not be exact in float64."""
        accept = lambda labels: self.accepts(labels, np.array([i]))[0]
        for ask in range(self.first[i], self.first[i] + self.n[i]):
            low, high = int(self.floor[ask]), int(self.high[ask])
            rows = Search(tree, int(self.own[i]), q).nearest(accept, None if low == _LEAST else low, None if high == _MOST else high)
            if got := list(itertools.islice(rows, self.k)):
                score, ids = (np.array(x, np.int64) for x in zip(*got, strict=True))
                self._keep(np.full(len(got), ask), score, ids)


def trees(rows: DataFrame, n: int) -> DataFrame:
    """A row for each of ``n`` blocks of (vec_id, label, v)."""

    def run(key, t):
        t = t.sort_by([("vec_id", "ascending"), ("label", "ascending")])
        m = dense(t.column("v"))
        ids, labels = (t.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        tree = Tree(ids, labels, m)
        parts = (tree.ids, tree.labels, tree.vectors, np.array(tree.nodes, np.int64), np.array(tree.bounds))
        names = ("ids", "labels", "vectors", "nodes", "bounds")
        return pa.table({"c": pa.array([key[0].as_py()], pa.int64()), "dims": pa.array([m.shape[1]], pa.int64()), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(names, parts, strict=True)}})

    # a task for each block: Spark reads a file's rows in batches of thousands, and a file of many trees is one batch
    return rows.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(n))).repartition(min(n, MOST_TASKS), "c").groupBy("c").applyInArrow(run, _TREE)


def dense(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    n = pc.list_value_length(column).to_numpy()
    m = np.zeros((len(n), n.max(initial=0)))
    m[np.arange(m.shape[1]) < n[:, None]] = pc.list_flatten(column)
    return m


def _tree(r: dict) -> Tree:
    ids, labels = (np.frombuffer(r[c], np.int64) for c in ("ids", "labels"))
    nodes, bounds = np.frombuffer(r["nodes"], np.int64).reshape(-1, 5), np.frombuffer(r["bounds"]).reshape(-1, 4)
    return Tree(ids, labels, np.frombuffer(r["vectors"]).reshape(len(ids), r["dims"]), nodes.tolist(), bounds.tolist())


def _searched(anchors: DataFrame, forest: DataFrame, n: int, schema: str, asks: Callable[[pa.RecordBatch], tuple[Asks, list[np.ndarray]]]) -> DataFrame:
    """What every anchor's asks find in the ``n`` trees, the best of each group of trees.

    ``asks``: of a batch of anchors, what they ask, and for each ask the values that come before (id, score) of its rows.
    """
    groups = max(min(n, GROUPS), -(-n // HELD))
    names = [x.split()[0] for x in schema.split(", ")]
    copies = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = forest.withColumn("g", F.pmod("c", F.lit(groups)).cast("int")).unionByName(copies, allowMissingColumns=True)
    dealt = dealt.repartitionById(groups, "g").sortWithinPartitions("g", F.col("c").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for b in batches:
            at = 0
            while at < b.num_rows:
                rows = b.slice(at, 1)
                if rows.column("g")[0].as_py() != group:
                    group, held = rows.column("g")[0].as_py(), []
                if rows.column("c")[0].is_valid:
                    held.append(_tree(rows.select([x.split()[0] for x in _TREE.split(", ")]).to_pylist()[0]))
                    at += 1
                    continue
                rows = b.slice(at, ANCHORS)
                rows = rows.slice(0, int((rows.column("g").to_numpy() == group).sum()))
                at += rows.num_rows
                asked, values = asks(rows)
                for tree in held:
                    asked.walk(tree)
                ask, score, ids = asked.best
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in [*(v[ask] for v in values), ids, score]], names)

    return dealt.mapInArrow(run, schema)


def _first(found: DataFrame, keys: list[str], score: str, id_col: str, k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc(score), id_col)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, label: Column, k_pos: int = 5, k_neg: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` and ``label``: columns over ``vectors``.  A negative's score lies between ``share[0] / share[1]``
    of the positive's score and that score.
    """
    num, den = share
    labelled = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v_"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor")).where("label is not null")
    with Scratch() as scratch:
        rows = scratch.keep(quantised(labelled, "vec_id", "v_", scale, "label", "anchor"), "vectors")
        n = max(1, -(-rows.count() // BLOCK))
        forest = scratch.keep(trees(rows, n), "forest")
        anchors = rows.where("anchor").select(F.col("vec_id").alias("own"), F.col("label").alias("own_label"), "v", F.xxhash64("vec_id", "label", "v").alias("key"))

        def positives(b: pa.RecordBatch) -> tuple[Asks, list[np.ndarray]]:
            own, labels, keys = (b.column(c).to_numpy() for c in ("own", "own_label", "key"))
            return Asks(own, labels, dense(b.column("v")), np.arange(len(own)), np.full(len(own), _LEAST), np.full(len(own), _MOST), True, k_pos), [own, keys]

        found = _searched(anchors, forest, n, "anchor_id long, key long, positive_id long, positive_score long", positives)
        found = scratch.keep(_first(found, ["anchor_id", "key"], "positive_score", "positive_id", k_pos), "positives")
        chosen = found.groupBy(F.col("anchor_id").alias("own"), "key").agg(F.collect_list("positive_id").alias("positive"), F.collect_list("positive_score").alias("score"))

        def negatives(b: pa.RecordBatch) -> tuple[Asks, list[np.ndarray]]:
            """An ask for each positive whose window isn't empty."""
            own, labels, keys = (b.column(c).to_numpy() for c in ("own", "own_label", "key"))
            of = np.repeat(np.arange(len(own)), pc.list_value_length(b.column("score")).to_numpy())
            positive, high = (pc.list_flatten(b.column(c)).to_numpy() for c in ("positive", "score"))
            low = [-(-num * x // den) for x in high.tolist()]
            asked = np.array([x <= y for x, y in zip(low, high.tolist(), strict=True)], bool)
            low = np.array([max(_LEAST, x) for x, ok in zip(low, asked, strict=True) if ok], np.int64)
            of, positive, high = of[asked], positive[asked], high[asked]
            return Asks(own, labels, dense(b.column("v")), of, low, high, False, k_neg), [own[of], keys[of], positive, high]

        schema = "anchor_id long, key long, positive_id long, positive_score long, negative_id long, negative_score long"
        mined = _searched(anchors.join(chosen.hint("merge"), ["own", "key"]), forest, n, schema, negatives)
        first = _first(mined, ["anchor_id", "key", "positive_id", "positive_score"], "negative_score", "negative_id", k_neg)
        return materialize(first.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
