"""A Merkle manifest of a dataset: a digest of every row, a tree for each source, a tree of the sources' roots, and a proof for every row.

Rows are numbered in order inside their tree by ranges: rows are dealt by range and sorted, and a row's number is its
place in its range after the counts of the ranges before. Aligned blocks of BRANCH ** HEIGHT nodes are then traversed
apart, each by a recursion in postorder that returns a subtree's digest and, while it unwinds, appends the siblings of
each child to the leaves under it. A block's root is a node of the next traversal, until each tree has one node. On
the way down a block takes the siblings that its own root met above, and completes its leaves' proofs.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_side, stash

#: Nodes of a run; levels of a block.
BRANCH, HEIGHT = 16, 2
#: What a row's digest covers, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def digest(texts: list[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values, each `-` if null, else its UTF-8 byte count, `:` and itself."""
    said = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said)).cast("binary"), 256)


def numbered(nodes: DataFrame, tree: str, *order: str) -> DataFrame:
    """nodes, stashed, with `at`: their number in their tree by `order`, from 0. No tree has to fit one task."""
    placed = stash(nodes.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("__place", F.monotonically_increasing_id()))
    parts = stash(placed.groupBy(tree, F.shiftright("__place", 33).alias("__part")).agg(F.min("__place").alias("__least"), F.count(F.lit(1)).alias("__n")))
    before = Window.partitionBy(tree).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = parts.select(tree, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__least")).alias("__shift"))
    return placed.withColumn("__part", F.shiftright("__place", 33)).join(small_side(stash(first)), [tree, "__part"]).withColumn("at", F.col("__place") + F.col("__shift")).drop("__part", "__place", "__shift")


class Block:
    """The nodes of an aligned block, traversed: its root, and for each leaf the runs of siblings that it meets, with its place in each."""

    def __init__(self, leaves: list[str], levels: int, branch: int = BRANCH):
        self.branch, self.leaves = branch, leaves
        self.met: list[list[tuple[list[str], int]]] = [[] for _ in leaves]
        self.root = self._visit(0, len(leaves), levels)

    def _visit(self, first: int, after: int, level: int) -> str:
        if not level:
            return self.leaves[first]
        width = self.branch ** (level - 1)
        starts = range(first, after, width)
        run = [self._visit(i, min(i + width, after), level - 1) for i in starts]
        for k, i in enumerate(starts):
            siblings = run[:k] + run[k + 1 :]
            for leaf in range(i, min(i + width, after)):
                self.met[leaf].append((siblings, k))
        return digest(run)


def fold(node: str, met: list[tuple[list[str], int]]) -> str:
    """The root above node, from the siblings that it meets and its place among them."""
    for siblings, k in met:
        node = digest([*siblings[:k], node, *siblings[k:]])
    return node


def levels_of(n: int, height: int = HEIGHT, branch: int = BRANCH) -> int:
    """Levels of a block in a tree of n nodes: height, or fewer if the tree is one block."""
    levels = 0
    while levels < height and branch**levels < n:
        levels += 1
    return levels if n <= branch**height else height


_MET = "array<struct<siblings: array<string>, place: int>>"
_MET_TYPE = pa.list_(pa.struct([("siblings", pa.list_(pa.string())), ("place", pa.int32())]))


def _traversed(table: pa.Table, height: int) -> tuple[pa.Table, Block]:
    """A group's rows in order of `at`, and their block, which takes its number of levels from its tree's number of nodes."""
    table = table.sort_by("at")
    return table, Block(table.column("node").to_pylist(), levels_of(table.column("n")[0].as_py(), height))


def block_roots(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """tree, at, node, n: the root of every block of nodes(tree, at, node, n), at the block's number; n is the number of blocks."""
    size = BRANCH**height

    def one(table: pa.Table) -> pa.Table:
        table, block = _traversed(table, height)
        at, n = table.column("at")[0].as_py() // size, -(-table.column("n")[0].as_py() // size)
        return pa.table({"tree": [table.column("tree")[0].as_py()], "at": [at], "node": [block.root], "n": [n]})

    return nodes.groupBy("tree", F.floor(F.col("at") / size).alias("block")).applyInArrow(one, "tree string, at long, node string, n long")


def ascend(nodes: DataFrame, height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """The layers of traversals over nodes(tree, at, node, n), each of the block roots of the one before, and every tree's root (tree, root)."""
    size, layers, ended = BRANCH**height, [nodes], []
    while True:
        above = stash(block_roots(layers[-1], height))
        ended.append(above.filter("n = 1").select("tree", F.col("node").alias("root")))
        more = above.filter("n > 1")
        if not more.limit(1).count():
            break
        layers.append(more)
    out = ended[0]
    for other in ended[1:]:
        out = out.unionByName(other)
    return layers, out


def complete(layer: DataFrame, above: DataFrame, out, schema: str, height: int = HEIGHT) -> DataFrame:
    """Every block of layer with its row of above(tree, block, met); out(rows in order, what each meets up to the top, that row or None) makes the result."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out(left, [], None)
        table, block = _traversed(left, height)
        up = right.to_pylist()[0] if right.num_rows else None
        further = [(m["siblings"], m["place"]) for m in (up["met"] if up else [])]
        return out(table, [own + further for own in block.met], up)

    blocks = layer.withColumn("block", F.floor(F.col("at") / BRANCH**height))
    return blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(one, schema)


def descend(layers: list[DataFrame], top: DataFrame, height: int = HEIGHT) -> DataFrame:
    """tree, block, met: what the root of each block of the lowest layer meets up to the top; top(tree, met) is what the trees' own roots meet."""

    def out(table: pa.Table, met: list, _) -> pa.Table:
        said = pa.array([[{"siblings": s, "place": k} for s, k in m] for m in met], _MET_TYPE)
        return pa.table({"tree": table.column("tree"), "block": table.column("at"), "met": said})

    above = None
    for k in reversed(range(len(layers))):
        ended = layers[k].filter((F.col("n") <= BRANCH**height) & (F.col("at") == 0)).select("tree", F.lit(0).cast("long").alias("block")).join(top, "tree")
        above = stash(ended if above is None else ended.unionByName(above))
        if k:
            above = complete(layers[k], above, out, f"tree string, block long, met {_MET}", height)
    return above


def manifest(docs: DataFrame, held: Column | None = None, columns: tuple = LEAF_COLUMNS, height: int = HEIGHT) -> DataFrame:
    """COLUMNS for every row of docs: its leaf, its source's root, the root of all, the digest of its proof, and whether the row as now held still folds to that root.

    columns: a row's id, its source, and what else its digest covers, in order. held: the digest of the
    row as it is held now, null where it is unchanged. Null sources are a tree of their own, the first;
    rows of equal ids stand in order of their digests, null ids first; a source of one row is that row's
    leaf; texts are hashed whole, however long; an empty table gives no rows; other columns don't matter.
    """
    doc_id, source = F.col(columns[0]), F.col(columns[1])
    leaf = leaf_digest(*(F.col(c) for c in columns))
    rows = stash(docs.select(doc_id.alias("doc_id"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("tree"), leaf.alias("node"), (F.lit(None).cast("string") if held is None else held).alias("held")))
    sizes = stash(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    layers, subroots = ascend(stash(numbered(rows, "tree", "doc_id", "node").join(small_side(sizes), "tree")), height)
    # the sources' roots are one more tree, in the order of their names
    named = numbered(stash(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node"))), "tree", "name")
    named = stash(named.withColumn("n", F.lit(named.count()).cast("long")))
    over, root = ascend(named, height)
    root = (root.first() or [None, None])[1]  # one row
    nothing = over[0].select("tree").limit(1).select("tree", F.array().cast(_MET).alias("met"))

    def of_source(table: pa.Table, met: list, _) -> pa.Table:
        said = pa.array([[{"siblings": s, "place": k} for s, k in m] for m in met], _MET_TYPE)
        return pa.table({"tree": table.column("name"), "subroot": table.column("node"), "met": said})

    up = stash(complete(over[0], descend(over, nothing, height), of_source, f"tree string, subroot string, met {_MET}", height))
    above = descend(layers, up.select("tree", "met"), height).join(small_side(up.select("tree", "subroot")), "tree")

    def of_row(table: pa.Table, met: list, block: dict | None) -> pa.Table:
        leaves, now = table.column("node").to_pylist(), table.column("held").to_pylist()
        folded = [fold(h or x, m) for x, h, m in zip(leaves, now, met)]
        proofs = [digest([s for siblings, _ in m for s in siblings]) for m in met]
        n = len(leaves)
        values = [table.column("doc_id"), pa.array(leaves, pa.string()), pa.array([block and block["subroot"]] * n, pa.string()), pa.array([root] * n, pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())]
        return pa.Table.from_arrays(values, names=list(COLUMNS))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return complete(layers[0], above, of_row, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", height)
