"""Merkle manifest of a dataset: every row's leaf, its tree's root and a proof that leads from one to the other.

H is the lowercase hex SHA-256 of its inputs written one after the other. The rows of each group (``lang``) make a
tree over their leaves in ascending order; while it has several nodes, every ``ARITY`` consecutive ones (the last run may
have fewer, even one) become their H. The groups' subroots, in order of the group, make the top tree in the same way.

Leaves get places by a range sort, so a group of any size is dealt to many tasks. Aligned blocks of
``ARITY ** HEIGHT`` leaves are subtrees. A first pass takes each block to its root by a stack of open runs; the
levels above are aggregations of runs, and every block's upper proof comes down from the root by joins. A second pass
walks each block by fractal traversal: for every layer of ``LAYER`` levels it holds the existing subtree, from which
siblings are read, and the desired one, which is built a leaf at a time while the existing one is used up and then
takes its place. So a task holds a few subtrees of ``ARITY ** LAYER`` nodes besides its block's leaves, and proofs of
successive leaves come out one after the other; each is hashed, with its block's upper proof at the end, and folded.

Defined cases: a null value is ``-`` in its leaf; null groups make a tree of their own, the first; null identifiers
come first in their tree; rows of one identifier are ordered by their leaves, so repeated rows are leaves like any
other, next to each other; a lone leaf is its tree's subroot and a lone subroot the root; a proof without siblings is
H of nothing; texts of any length are hashed whole where they are and never moved; an empty table gives an empty result;
columns other than ``fields`` are not part of the manifest and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspark.llm.common import LOWER, UPPER
from pointspark.operators.ranks import numbered
from pointspark.shared import materialize

#: Nodes of a run, levels of a block, levels of a layer in it.
ARITY, HEIGHT, LAYER = 8, 4, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _part(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[_part(v.cast("string")) for v in values]), 256)


def h(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Runs:
    """Open runs of each level: takes nodes of the lowest level in order and makes each node above as soon as its run is full."""

    def __init__(self, height: int):
        self.open: list[list[bytes]] = [[] for _ in range(height)]
        self.nodes: list[list[bytes]] = [[] for _ in range(height + 1)]

    def add(self, node: bytes, level: int = 0, keep: int = 0) -> None:
        """``node`` at ``level``; nodes below level ``keep`` are not held once they have been hashed."""
        if level >= keep:
            self.nodes[level].append(node)
        if level < len(self.open):
            run = self.open[level]
            run.append(node)
            if len(run) == ARITY:
                self.open[level] = []
                self.add(h(*run), level + 1, keep)

    def close(self, keep: int = 0) -> None:
        """The runs that the last node left open, lowest level first."""
        for level in range(len(self.open)):
            if run := self.open[level]:
                self.open[level] = []
                self.add(h(*run), level + 1, keep)


def block_root(leaves: list[bytes], height: int) -> bytes:
    runs = Runs(height)
    for x in leaves:
        runs.add(x, keep=height)
    runs.close(keep=height)
    return runs.nodes[height][0]


def traverse(leaves: list[bytes], height: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """For each leaf in turn, level by level: its node's place in its run and the run's other nodes."""
    tops = [min(height, at + LAYER) for at in range(0, height, LAYER)]  # level above each layer, lowest layer first
    lows = list(range(0, height, LAYER))
    spans = [ARITY**top for top in tops]  # leaves below a subtree of the layer

    def subtree(layer: int, first: int) -> Runs:
        runs = Runs(tops[layer])
        for x in leaves[first : first + spans[layer]]:
            runs.add(x, keep=lows[layer])
        runs.close(keep=lows[layer])
        return runs

    exist = [subtree(layer, 0) for layer in range(len(tops))]
    desired = [Runs(top) for top in tops]
    for at in range(len(leaves)):
        path = []
        for layer, low in enumerate(lows):
            nodes, inner = exist[layer].nodes, at % spans[layer]
            for level in range(low, tops[layer]):
                place = inner // ARITY**level
                run = place - place % ARITY
                siblings = nodes[level][run : run + ARITY]
                del siblings[place - run]
                path.append((place - run, siblings))
        yield path
        for layer, span in enumerate(spans):
            ahead = at + span
            if ahead < len(leaves):
                desired[layer].add(leaves[ahead], keep=lows[layer])
            if (at + 1) % span == 0:
                desired[layer].close(keep=lows[layer])
                exist[layer], desired[layer] = desired[layer], Runs(tops[layer])


def fold(node: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    for place, siblings in path:
        node = h(*siblings[:place], node, *siblings[place:])
    return node


def height_of(n: int) -> int:
    """Levels above ``n`` leaves, those inside of a block."""
    height = 0
    while n > 1 and height < HEIGHT:
        n, height = -(-n // ARITY), height + 1
    return height


def upper_proofs(nodes: DataFrame) -> DataFrame:
    """``tree, at, root, places, siblings``: from each node (``tree, at, node, n``, n nodes in its tree) to its tree's root.

    ``places`` has the node's place in its run for each level, lowest first; ``siblings`` the others of these runs.
    Each level is one aggregation of runs on the way up and one join on the way down.
    """
    run = F.floor(F.col("at") / ARITY).cast("long")
    levels = [materialize(nodes.select("tree", "at", "node", "n"), "level")]
    while not levels[-1].filter("n > 1").isEmpty():
        runs = levels[-1].filter("n > 1").groupBy("tree", run.alias("at"), "n").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("run"))
        up = runs.select("tree", "at", F.sha2(F.array_join("run.node", ""), 256).alias("node"), F.ceil(F.col("n") / ARITY).cast("long").alias("n"))
        levels.append(materialize(up, "level"))
    none = F.array().cast("array<int>"), F.array().cast("array<array<string>>")
    tops = lambda level: level.filter("n = 1").select("tree", "at", F.col("node").alias("root"), none[0].alias("places"), none[1].alias("siblings"))
    proofs = tops(levels[-1])
    for level in reversed(levels[:-1]):
        many = level.filter("n > 1").withColumn("up", run)
        runs = many.groupBy("tree", "up").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("run"))
        above = proofs.select("tree", F.col("at").alias("up"), "root", "places", "siblings")
        others = F.transform(F.filter("run", lambda r: r["at"] != F.col("at")), lambda r: r["node"])
        down = many.join(runs, ["tree", "up"]).join(above, ["tree", "up"])
        place = F.pmod(F.col("at"), F.lit(ARITY)).cast("int")
        down = down.select("tree", "at", "root", F.concat(F.array(place), "places").alias("places"), F.concat(F.array(others), "siblings").alias("siblings"))
        proofs = materialize(down.unionByName(tops(level)), "proofs")
    return proofs


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, text: str = "text") -> DataFrame:
    """``key, group, at, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row; ``at``: place in its tree.

    A row is verified by folding its leaf, taken anew from the row as it is found, up its proof. The row is found
    tampered where 3 divides the unsigned crc32 of its decimal ``key``: A-Z of ``text`` in lower case.
    """
    found = F.when(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 0, F.translate(text, UPPER, LOWER)).otherwise(F.col(text))
    leaves = rows.select(F.col(key).alias("key"), F.col(group).alias("grp"), leaf(*[F.col(f) for f in fields]).alias("leaf"), leaf(*[found if f == text else F.col(f) for f in fields]).alias("met"))
    tie = leaves.withColumn("_tie", F.monotonically_increasing_id())  # only rows with the same leaf are dealt by it
    placed = materialize(numbered(tie, "grp", "key", "leaf", "_tie", name="g").drop("_tie"), "leaves")
    groups = placed.groupBy("grp").agg(F.min("g").alias("first"), F.count("*").alias("size"))
    groups = materialize(numbered(groups, "first", name="tree").withColumnRenamed("grp", "_grp"), "groups")
    at = F.col("g") - F.col("first")
    placed = placed.join(groups, F.col("grp").eqNullSafe(F.col("_grp"))).select("key", "grp", "leaf", "met", "tree", "size", at.alias("at"), F.floor(at / ARITY**HEIGHT).cast("long").alias("block"))
    placed = materialize(placed, "placed-leaves")

    def in_order(t: pa.Table) -> pa.Table:
        return t.sort_by("at")

    def raise_block(t: pa.Table) -> pa.Table:
        t = in_order(t)
        node = block_root([x.encode() for x in t.column("leaf").to_pylist()], height_of(t.column("size")[0].as_py()))
        return pa.table({"tree": t.column("tree")[:1], "at": t.column("block")[:1], "node": pa.array([node.decode()])})

    blocks = placed.select("tree", "block", "at", "leaf", "size").groupBy("tree", "block").applyInArrow(raise_block, "tree long, at long, node string")
    blocks = materialize(blocks, "block-roots")
    # levels above a block follow only where its tree has several blocks
    counts = blocks.groupBy("tree").agg(F.count("*").alias("n"))
    inner = materialize(upper_proofs(blocks.join(counts, "tree")), "inner-proofs")
    subroots = materialize(inner.groupBy("tree").agg(F.first("root").alias("subroot")), "subroots")
    total = subroots.agg(F.count("*").alias("n"))
    outer = upper_proofs(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("subroot").alias("node")).crossJoin(F.broadcast(total)))  # with a single row
    outer = outer.select(F.col("at").alias("tree"), "root", F.col("places").alias("p2"), F.col("siblings").alias("s2"))
    proofs = inner.join(outer.join(subroots, "tree"), "tree").select("tree", F.col("at").alias("block"), inner["root"].alias("subroot"), outer["root"].alias("root"), F.concat("places", "p2").alias("places"), F.concat("siblings", "s2").alias("siblings"))
    proofs = materialize(proofs, "upper-proofs")

    def walk(mine: pa.Table, above: pa.Table) -> pa.Table:
        mine = in_order(mine)
        leaves, met = ([x.encode() for x in mine.column(c).to_pylist()] for c in ("leaf", "met"))
        upper = [(p, [x.encode() for x in s]) for p, s in zip(above.column("places")[0].as_py(), above.column("siblings")[0].as_py(), strict=True)]
        end = b"".join(x for _, s in upper for x in s)
        subroot, root = (above.column(c)[0].as_py() for c in ("subroot", "root"))
        proof, folded = [], []
        for found, path in zip(met, traverse(leaves, height_of(mine.column("size")[0].as_py())), strict=True):
            proof.append(h(*[x for _, s in path for x in s], end).decode())
            folded.append(fold(found, path + upper).decode())
        n = len(leaves)
        return pa.table({"key": mine.column("key"), "grp": mine.column("grp"), "at": mine.column("at"), "leaf": mine.column("leaf"), "subroot": pa.array([subroot] * n), "root": pa.array([root] * n), "proof_sha256": pa.array(proof), "folded_root": pa.array(folded)})

    kinds = {c: placed.schema[c].dataType.simpleString() for c in ("key", "grp")}
    out = placed.groupBy("tree", "block").cogroup(proofs.groupBy("tree", "block")).applyInArrow(walk, f"key {kinds['key']}, grp {kinds['grp']}, at long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.select(F.col("key").alias(key), F.col("grp").alias(group), "at", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
