"""Hard negatives of anchor vectors, with bounds along spanning trees of the anchors.

Anchors are sorted by a hash of their direction, so neighbours stand together, and cut into blocks; every block gets a minimum
spanning tree.  A block of anchors meets a block of candidates in one task.  The root's scores are computed for all
candidates; for a child at distance ``e`` from its parent, a candidate of norm ``n`` scores within ``e * n`` of what it
scores at the parent.  Only candidates whose bounds overlap what is asked for (the best of the same label, or the
windows of scores below the positives) are scored again; all others hand their widened bounds down.  So the results are exact,
and the nearer anchors are to each other, the fewer products are formed.

Every pair of blocks is looked at (a stated query set against all rows); the best of each pair are merged per anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorframe.plans.scan import number_by_sort
from sensorframe.plans.sizing import Sized, attach, store

#: anchors of a spanning tree, anchors and candidates that meet in a task
TREE, GROUP, BLOCK = 512, 16_384, 16_384
#: bits of the hash that brings neighbours together
BITS = 40
#: products below this are exact in double precision, also times 100; larger ones are done in Python's integers
EXACT = 2.0**45
LARGEST = (1 << 63) - 1


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = np.zeros(len(batch), np.int64)
        vec, dims = batch.column("_vec"), batch.column("_dim").to_numpy()
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            x = np.asarray(pc.list_flatten(vec.take(pa.array(rows))), np.float64).reshape(len(rows), d)
            top = np.abs(x).max(axis=1, keepdims=True, initial=0.0)
            plane = np.random.default_rng(int(d)).standard_normal((int(d), BITS))
            sig[rows] = (x / np.where(top > 0, top, 1.0) @ plane > 0) @ (1 << np.arange(BITS - 1, -1, -1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig)], [*batch.schema.names, "_sig"])


def matrix(column: pa.ChunkedArray, dim: int, scale: float) -> np.ndarray:
    """Rows of ``floor(scale * x)``, exact: doubles, or Python's integers where a double would not do."""
    x = np.asarray(pc.list_flatten(column).combine_chunks(), np.float64).reshape(len(column), dim)
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * x)
    if np.isfinite(scaled).all():
        return scaled
    whole = [int(s) if np.isfinite(s) else int(v) * int(scale) for s, v in zip(scaled.ravel(), x.ravel())]
    return np.array(whole, object).reshape(x.shape)


def _doubles(x: np.ndarray) -> np.ndarray:
    """Numbers small enough for squares; what is cut off here is never bounded but computed."""
    return np.clip(x, -1e150, 1e150).astype(np.float64)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent (-1 for the root) and distance to it of every point, and the points' turns.

    The tree is minimal; its root is the point nearest to the middle.  Turns put parents before children and small subtrees
    before large ones, so that few points wait for children at any time.
    """
    n = len(points)
    points = _doubles(points)
    middle = points - points.mean(axis=0)
    root = int((middle * middle).sum(axis=1).argmin())
    parent, edge = np.full(n, -1), np.zeros(n)
    near, left = np.full(n, np.inf), np.ones(n, bool)
    at, order = root, []
    for _ in range(n):
        order.append(at)
        left[at] = False
        if len(order) == n:
            break
        gap = points - points[at]
        gap = np.sqrt((gap * gap).sum(axis=1))
        closer = left & (gap < near)
        near[closer], parent[closer] = gap[closer], at
        at = int(np.where(left, near, np.inf).argmin())
        edge[at] = near[at]
    size = np.ones(n, int)
    for i in reversed(order):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in sorted(order, key=lambda i: -size[i]):
        if parent[i] >= 0:
            children[parent[i]].append(i)
    turn, stack, k = np.zeros(n, int), [root], 0
    while stack:
        i = stack.pop()
        turn[i], k = k, k + 1
        stack += children[i]
    return parent, edge, turn


def _spanned(scale: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        x = matrix(table["_vec"], table["_dim"][0].as_py(), scale)
        parent, edge, turn = spanning_tree(x)
        first = table["_pos"][0].as_py()
        parent = np.where(parent < 0, -1, parent + first)
        return table.select(["_dim", "_rid", "_id", "_label", "_vec", "_pos"]).append_column(
            "_parent", pa.array(parent, pa.int64())
        ).append_column("_edge", pa.array(edge, pa.float64())).append_column("_turn", pa.array(turn + first, pa.int64()))

    return run


def _best(score: np.ndarray, at: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> np.ndarray:
    """Indices into ``at`` of the ``k`` first: higher scores, then smaller ids."""
    if len(at) > k:
        keep = np.flatnonzero(score >= np.sort(score)[-k])
    else:
        keep = np.arange(len(at))
    order = np.lexsort((rids[at[keep]], ids[at[keep]], -score[keep]))
    return keep[order[:k]]


class Bounds:
    """Scores of all candidates at the anchors of a group, as bounds that a spanning tree hands down."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table, scale: float) -> None:
        dim = anchors["_dim"][0].as_py()
        self.anchors = anchors.sort_by("_turn")
        self.q, self.x = matrix(self.anchors["_vec"], dim, scale), matrix(candidates["_vec"], dim, scale)
        self.norm, lengths = (np.sqrt((_doubles(m) ** 2).sum(axis=1)) for m in (self.x, self.q))
        longest = lengths.max(initial=0.0)
        self.exact = self.q.dtype == self.x.dtype == np.float64 and self.norm.max(initial=0.0) * longest < EXACT
        if not self.exact:
            self.q, self.x = (np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) for m in (self.q, self.x))
        self.scored = 0

    def _scores(self, i: int, at: np.ndarray | slice) -> np.ndarray:
        rows = self.x[at]
        self.scored += len(rows)
        if self.exact:
            return rows @ self.q[i]
        return np.array([sum(a * b for a, b in zip(r, self.q[i])) for r in rows], object)

    def walk(self, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(anchor, candidates, their scores)`` for the candidates that ``wanted(anchor, low, high)`` picks by their bounds."""
        parents, places = self.anchors["_parent"].to_pylist(), self.anchors["_pos"].to_pylist()
        edges = self.anchors["_edge"].to_numpy()
        waiting: dict[int, int] = {}
        for p in parents:
            waiting[p] = waiting.get(p, 0) + 1
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, (place, parent) in enumerate(zip(places, parents)):
            if parent < 0 or not self.exact:
                low = high = self._scores(i, slice(None))
                at = wanted(i, low, high)
            else:
                low, high = held[parent]
                width = self.norm * (edges[i] * (1 + 1e-9))
                low, high = low - width, high + width
                waiting[parent] -= 1
                if not waiting[parent]:
                    del held[parent]
                at = wanted(i, low, high)
                if 2 * len(at) > len(low):  # one product with all rows is cheaper than gathering most of them
                    low = high = self._scores(i, slice(None))
                else:
                    low[at] = high[at] = self._scores(i, at)
            yield i, at, low[at]
            if place in waiting and self.exact:
                held[place] = low, high


def _positives(k: int, scale: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(anchors) or not len(candidates):
            return _table([], _POSITIVES)
        bounds = Bounds(anchors, candidates, scale)
        own, label = bounds.anchors["_rid"].to_pylist(), bounds.anchors["_label"].to_pylist()
        rids, ids, labels = (candidates[c].to_numpy() for c in ("_rid", "_id", "_label"))
        of = {x: np.flatnonzero(labels == x) for x in set(label)}

        def wanted(i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            at = of[label[i]]
            at = at[rids[at] != own[i]]
            if len(at) <= k or low is high:
                return at
            return at[high[at] >= np.partition(low[at], len(at) - k)[-k]]

        rows = []
        for i, at, score in bounds.walk(wanted):
            for j in _best(score, at, ids, rids, k):
                rows.append((own[i], int(rids[at[j]]), int(ids[at[j]]), _long(score[j])))
        return _table(rows, _POSITIVES)

    return run


def _negatives(k: int, scale: float, least: int, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(anchors) or not len(candidates):
            return _table([], _NEGATIVES)
        bounds = Bounds(anchors, candidates, scale)
        label, own = bounds.anchors["_label"].to_pylist(), bounds.anchors["_rid"].to_pylist()
        windows = [x or [] for x in bounds.anchors["_positives"].to_pylist()]
        rids, ids, labels = (candidates[c].to_numpy() for c in ("_rid", "_id", "_label"))
        others = {x: np.flatnonzero(labels != x) for x in set(label)}

        def wanted(i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            at, inside = others[label[i]], False
            for p in windows[i]:
                inside = inside | ((100 * high[at] >= least * p["score"]) & (100 * low[at] <= most * p["score"]))
            return at[inside] if windows[i] else at[:0]

        rows = []
        for i, at, score in bounds.walk(wanted):
            for p in windows[i]:
                within = np.flatnonzero((100 * score >= least * p["score"]) & (100 * score <= most * p["score"]))
                for j in _best(score[within], at[within], ids, rids, k):
                    c = at[within[j]]
                    rows.append((own[i], p["rid"], p["id"], p["score"], int(rids[c]), int(ids[c]), _long(score[within[j]])))
        return _table(rows, _NEGATIVES)

    return run


def _long(value: float | int) -> int:
    return max(-LARGEST, min(LARGEST, int(value)))


_POSITIVES = ["_rid", "_p_rid", "_p_id", "_p_score"]
_NEGATIVES = [*_POSITIVES[:1], *_POSITIVES[1:], "_n_rid", "_n_id", "_n_score"]


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[] for _ in names])], names=names)


def _longs(names: list[str]) -> str:
    return ", ".join(f"{c} long" for c in names)


def mine(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label: Column | None = None,
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    scale: float = 256.0,
    tree: int = TREE,
    group: int = GROUP,
    block: int = BLOCK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``, whole numbers.

    Vectors become ``floor(scale * x)``; scores are inner products.  Anchors are the rows for which ``anchor`` holds.  An anchor's
    positives are its best ``positives`` other rows of the same label (an integer; default: column ``label``); for each, the best
    ``negatives`` rows of another label are returned whose score is between ``least`` and ``most`` percent of the positive's.  Ties
    go to smaller ids, then to any order of equal rows.

    Rows with a null label, a null vector or a null or non-finite component take no part.  Every row counts, repeated ones
    too; a null id comes after all others.  Vectors of different lengths never meet.  Scores beyond 64 bits are held at the
    limit.  Other columns are not read, and an empty table gives no rows.  ``tree`` anchors share a spanning tree, ``group`` (a
    multiple of it) anchors and about ``block`` candidates meet in a task.
    """
    finite = F.forall(vector_col, lambda x: F.abs(x.cast("double")) < float("inf"))
    usable = rows.select(
        F.monotonically_increasing_id().alias("_rid"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LARGEST)).alias("_id"),
        (F.col("label") if label is None else label).cast("long").alias("_label"),
        F.col(vector_col).alias("_vec"),
        F.coalesce(F.size(vector_col), F.lit(0)).alias("_dim"),
        F.coalesce(anchor, F.lit(False)).alias("_anchor"),
        F.coalesce(finite, F.lit(False)).alias("_finite"),
    )
    table = store(usable.filter("_finite AND _label IS NOT NULL").drop("_finite"))
    sizes = Sized(table.groupBy("_dim").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_anchor").alias("_a")))
    kind = dict(table.dtypes)["_vec"]
    anchors = attach(table.filter("_anchor").select("_rid", "_id", "_label", "_vec", "_dim"), sizes, ["_dim"])
    signed = anchors.mapInArrow(_signatures, f"_rid long, _id long, _label long, _vec {kind}, _dim int, _n long, _a long, _sig long")
    placed = number_by_sort(store(signed), ["_dim"], ["_sig", "_id", "_rid"], "_pos")
    columns = f"_dim int, _rid long, _id long, _label long, _vec {kind}, _pos long, _parent long, _edge double, _turn long"
    spanned = placed.groupBy("_dim", F.call_function("div", "_pos", F.lit(tree))).applyInArrow(_spanned(scale), columns)
    anchors = store(attach(spanned, sizes, ["_dim"]))

    parts = F.ceil(F.col("_n") / block).cast("int")
    groups = F.ceil(F.col("_a") / group).cast("int")
    dealt = attach(table.drop("_anchor"), sizes, ["_dim"]).withColumn("_c", F.pmod(F.xxhash64("_rid"), parts).cast("int"))
    dealt = dealt.filter("_a > 0").withColumn("_g", F.explode(F.sequence(F.lit(0), groups - 1))).drop("_n", "_a")

    def met(left: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], names: list[str]) -> DataFrame:
        left = left.withColumn("_g", F.call_function("div", "_pos", F.lit(group)).cast("int"))
        left = left.withColumn("_c", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_n", "_a")
        keys = ["_dim", "_g", "_c"]
        return left.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(fn, _longs(names))

    found = met(anchors, _positives(positives, scale), _POSITIVES)
    order = Window.partitionBy("_rid").orderBy(F.desc("_p_score"), "_p_id", "_p_rid")
    found = found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= positives)
    one = F.struct(F.col("_p_rid").alias("rid"), F.col("_p_id").alias("id"), F.col("_p_score").alias("score"))
    kept = store(found.groupBy("_rid").agg(F.collect_list(one).alias("_positives")))
    mined = met(anchors.join(kept, "_rid", "left"), _negatives(negatives, scale, least, most), _NEGATIVES)
    order = Window.partitionBy("_rid", "_p_rid").orderBy(F.desc("_n_score"), "_n_id", "_n_rid")
    mined = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    ids = anchors.select("_rid", "_id")

    def shown(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(LARGEST))

    return mined.join(ids, "_rid").select(
        shown("_id").alias("anchor_id"),
        shown("_p_id").alias("positive_id"),
        "rank",
        shown("_n_id").alias("negative_id"),
        F.col("_p_score").alias("positive_score"),
        F.col("_n_score").alias("negative_score"),
    )
