"""Merkle manifest of a table, and the versions of it in which single leaves were tampered with.

Rows are leaves, ordered within their group; runs of ``FANOUT`` nodes are hashed together until one node, the subroot, is
left; the subroots, ordered by group, give the root in the same way.  The tree is cut into aligned blocks of ``FANOUT **
LEVELS`` leaves, so a block is a whole subtree and is handled by one task.

Inside a block the tree is persistent: a node is never changed.  A tampered leaf makes a version, which copies the leaf's
ancestors in the block and shares all other nodes with the untouched tree.  Above the block a version goes on where it is: the
shared nodes it needs there (the siblings along the block's way to the root) are the same for the whole block, and are handed
down as one row a block.  So versions never gather at the top of the tree, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, functions as F

from sensorframe.plans.scan import number_by_sort
from sensorframe.plans.sizing import attach, store

#: children of a node, and levels in an aligned block (4,096 leaves)
FANOUT, LEVELS = 8, 4

#: siblings of a node, level by level upwards: its place among them and their digests
PATH = "array<struct<place:int,others:array<string>>>"
Path = list[tuple[int, list[str]]]


def field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value (numbers in decimal)."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def digest(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def fold(start: str, path: Path) -> str:
    """The digest reached from ``start`` with the siblings of ``path``."""
    for place, others in path:
        start = digest([*others[:place], start, *others[place:]])
    return start


class Tree:
    """Persistent hash tree over the leaves of one block.

    A block of a larger tree has ``levels`` levels, also if it holds one leaf; a tree of its own (0) ends at one node.
    """

    def __init__(self, leaves: Sequence[str], levels: int = 0) -> None:
        self.digests = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(self.digests)
        row, self.depth = list(range(len(self.digests))), 0
        while len(row) > 1 or self.depth < levels:
            row = [self._node(tuple(row[i : i + FANOUT])) for i in range(0, len(row), FANOUT)]
            self.depth += 1
        self.root = row[0]

    def _node(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest([self.digests[c] for c in children]))
        self.children.append(children)
        return len(self.digests) - 1

    def way(self, at: int) -> list[tuple[int, int]]:
        """From the root down to leaf ``at``: inner nodes, each with the place of the child to go to."""
        out, node = [], self.root
        for level in range(self.depth - 1, -1, -1):
            place = at // FANOUT**level % FANOUT
            out.append((node, place))
            node = self.children[node][place]
        return out

    def siblings(self, at: int) -> Path:
        """Siblings along the way from leaf ``at`` up to the root."""
        return [
            (place, [self.digests[c] for i, c in enumerate(self.children[node]) if i != place])
            for node, place in reversed(self.way(at))
        ]

    def replaced(self, at: int, value: str) -> int:
        """Root of a new version with ``value`` as leaf ``at``; only the leaf and its ancestors are new nodes."""
        self.digests.append(value)
        self.children.append(())
        node = len(self.digests) - 1
        for parent, place in reversed(self.way(at)):
            kids = self.children[parent]
            node = self._node((*kids[:place], node, *kids[place + 1 :]))
        return node


def _block(nodes: pa.Table, levels: int) -> tuple[pa.Table, Tree]:
    nodes = nodes.sort_by("_pos")
    return nodes, Tree(nodes["_digest"].to_pylist(), levels if nodes["_n"][0].as_py() > FANOUT**levels else 0)


def _blocks(nodes: DataFrame, levels: int) -> GroupedData:
    return nodes.withColumn("_block", F.call_function("div", "_pos", F.lit(FANOUT**levels))).groupBy("_g", "_block")


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """One node per block: those ``levels`` levels above, with positions and the group's number of nodes there."""

    schema, size = _arrow(nodes), FANOUT**levels

    def run(table: pa.Table) -> pa.Table:
        table, tree = _block(table, levels)
        n = -(-table["_n"][0].as_py() // size)
        pos = table["_pos"][0].as_py() // size
        return pa.table({"_g": table["_g"][:1], "_pos": [pos], "_n": [n], "_digest": [tree.digests[tree.root]]}, schema)

    return _blocks(nodes, levels).applyInArrow(run, f"_g {_type(nodes)}, _pos long, _n long, _digest string")


def _type(nodes: DataFrame) -> str:
    return dict(nodes.dtypes)["_g"]


def _arrow(nodes: DataFrame) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    return pa.schema([("_g", kinds[_type(nodes)]), ("_pos", pa.int64()), ("_n", pa.int64()), ("_digest", pa.string())])


def _handed(
    nodes: DataFrame, upper: DataFrame, levels: int, out: Callable[[pa.Table, Tree, dict], pa.Table], schema: str
) -> DataFrame:
    """``out(nodes of the block, its tree, the block's row of upper)`` for every block."""

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        table, tree = _block(table, levels)
        return out(table, tree, above.to_pylist()[0])

    return _blocks(nodes, levels).cogroup(upper.withColumnRenamed("_pos", "_block").groupBy("_g", "_block")).applyInArrow(run, schema)


def _path(row: dict) -> Path:
    return [(s["place"], s["others"]) for s in row["path"]]


def _paths(nodes: DataFrame, upper: DataFrame, levels: int) -> DataFrame:
    """For every node: the siblings from there to the root, its group's subroot and the root."""
    kept = _arrow(nodes).field("_g").type

    def out(table: pa.Table, tree: Tree, above: dict) -> pa.Table:
        n = len(table)
        paths = [[{"place": p, "others": o} for p, o in tree.siblings(i)] + above["path"] for i in range(n)]
        columns = [table["_g"].cast(kept), table["_pos"], pa.array(paths, _PATH)]
        columns += [pa.array([above[c]] * n, pa.string()) for c in ("subroot", "root")]
        return pa.table(columns, names=["_g", "_pos", "path", "subroot", "root"])

    return _handed(nodes, upper, levels, out, f"_g {_type(nodes)}, _pos long, path {PATH}, subroot string, root string")


_PATH = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))


def _rounds(nodes: DataFrame, most: int, levels: int) -> list[DataFrame]:
    """``nodes`` and the tops of their blocks, again and again until every group has one node."""
    out = [nodes]
    while most > 1 or len(out) == 1:
        out.append(store(_tops(out[-1], levels)))
        most = -(-most // FANOUT**levels)
    return out


def _down(rounds: list[DataFrame], upper: DataFrame, levels: int) -> DataFrame:
    """From the rows of ``upper`` for the last round's nodes to the rows for the blocks of the first round."""
    for nodes in reversed(rounds[1:-1]):
        upper = store(_paths(nodes, upper, levels))
    return upper


def manifest(
    rows: DataFrame,
    columns: Sequence[str],
    order: str,
    group: str,
    tampered: Callable[[dict[str, Column]], dict[str, Column]],
    levels: int = LEVELS,
) -> DataFrame:
    """``(order, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row.

    The leaf is the hash of ``columns``.  ``tampered`` maps the columns to what a tampered row holds (rows for which it
    changes nothing stay untampered).  ``folded_root`` is the root of the row's own version, ``verified`` says that it is the
    untampered root.  ``proof_sha256`` hashes the siblings from the leaf up to the root.

    Nulls are hashed as ``-``; null groups are a group of their own (the first), a null ``order`` comes first.  Rows with the same
    ``order`` are ordered by their leaf, so repeated rows are leaves of their own.  Texts are hashed whole, whatever
    their length, and are read once; other columns are not read.  An empty table gives no rows.
    """
    whole = {c: F.col(c) for c in columns}
    changed = tampered(whole)
    other = F.lit(False)
    for c, value in changed.items():
        other = other | ~value.eqNullSafe(F.col(c))
    leaves = store(
        rows.select(
            F.col(group).cast("string").alias("_g"),
            F.col(order).alias("_order"),
            leaf([whole[c] for c in columns]).alias("_digest"),
            F.when(other, leaf([changed.get(c, whole[c]) for c in columns])).alias("_new"),
        )
    )
    counts = store(leaves.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")))
    most = counts.agg(F.max("_n")).first()[0] or 0
    numbered = number_by_sort(leaves, ["_g"], ["_order", "_digest"], "_pos")
    nodes = store(attach(numbered, counts, ["_g"]))
    rounds = _rounds(nodes.select("_g", "_pos", "_n", "_digest"), most, levels)

    groups = rounds[-1].select(F.col("_g").alias("_key"), "_digest", F.lit(0).alias("_g"))
    seats = number_by_sort(groups, [], ["_key"], "_pos")
    n = groups.count()
    seats = store(seats.withColumn("_n", F.lit(n).cast("long")))
    over = _rounds(seats.select("_g", "_pos", "_n", "_digest"), n, levels)
    start = [F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("_digest").alias("root")]
    top = over[-1].select("_g", "_pos", *start)
    top = _paths(over[0], _down(over, top, levels), levels) if n else top
    named = seats.select("_pos", F.col("_key"), F.col("_digest").alias("_sub"))
    upper = named.join(top.select("_pos", "path", "root"), "_pos").select(
        F.col("_key").alias("_g"), F.lit(0).cast("long").alias("_pos"), "path", F.col("_sub").alias("subroot"), "root"
    )
    upper = _down(rounds, store(upper), levels)

    kind = dict(leaves.dtypes)["_order"]
    schema = f"_order {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    out = _handed(nodes, upper, levels, _versions, schema)
    out = out.withColumnRenamed("_order", order)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _versions(table: pa.Table, tree: Tree, above: dict) -> pa.Table:
    path = _path(above)
    rest = "".join(d for _, others in path for d in others)
    proofs, folded = [], []
    unchanged = fold(tree.digests[tree.root], path)
    for i, new in enumerate(table["_new"].to_pylist()):
        proofs.append(digest([*[d for _, others in tree.siblings(i) for d in others], rest]))
        folded.append(unchanged if new is None else fold(tree.digests[tree.replaced(i, new)], path))
    n = len(table)
    return pa.table(
        {
            "_order": table["_order"],
            "leaf": table["_digest"],
            "subroot": pa.array([above["subroot"]] * n, pa.string()),
            "root": pa.array([above["root"]] * n, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(folded, pa.string()),
        }
    )
