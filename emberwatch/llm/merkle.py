"""Merkle manifest of a dataset: a tree per group of rows, one over the groups, and a proof for every row.

A row's leaf is the SHA-256 of its columns; per group, leaves in order are joined eight by eight, level by
level, until one is left, the group's subroot; subroots are joined likewise into the root.

The tree is built over blocks of ``BLOCK`` leaves: a task joins a block up to its own top, and the tops are
the leaves of the next round. Proofs are made by an octopus multiproof: a partition of the leaves works out the
coordinates of all nodes that its proofs need and that it cannot derive from its own leaves (the
union of what the single proofs lack, each once), fetches them in one join, derives the interior nodes that
its proofs share, and expands the single proofs on the spot. A proof is then folded back to the root, with the
row's leaf or a changed one.

Defined results: null values count as ``-``, an empty text as ``0:``; null keys and null groups come first; rows of one
key are ordered by their leaf, so repeated rows have places of their own; a group of one row is its own subroot, and a
single group's subroot the root; an empty table gives no rows; columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocked import running
from .shared import written

FAN = 8
#: levels that one task joins, and the leaves it takes for that
LEVELS = 4
BLOCK = FAN**LEVELS
#: nodes that many partitions ask for are kept in so many copies, to be fetched side by side
COPIES = 64
#: levels above a block from which nodes are kept in copies; there is one in 8^3 blocks
SPREAD = 3


def _h(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its length in bytes of UTF-8, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def placed(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows with ``at``, their place in their group from 0, by a scan over ranges of rows."""
    return running(df, group, order, sums={"at": F.lit(1).cast("bigint")}).withColumn("at", F.col("at") - 1)


def _join_blocks(blocks: DataFrame) -> DataFrame:
    """Nodes above the leaves of each block: tree, level, at, h. ``blocks``: tree, base (level of its leaves), n (leaves of the whole tree on that level), block, leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                row, at, n = [x["h"] for x in r["leaves"]], r["block"] * BLOCK, r["n"]
                for step in range(1, LEVELS + 1):
                    if n <= 1:
                        break
                    row, at, n = [_h(row[i : i + FAN]) for i in range(0, len(row), FAN)], at // FAN, -(-n // FAN)
                    out.extend((r["tree"], r["base"] + step, at + i, h, n) for i, h in enumerate(row))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()))], names=["tree", "level", "at", "h", "n"])

    return blocks.mapInArrow(run, "tree bigint, level int, at bigint, h string, n bigint")


def build(leaves: DataFrame) -> DataFrame:
    """All nodes of all trees: tree, level, at, h, n (nodes of that tree on that level). ``leaves``: tree, at, h, n.

    Rounds grow with the logarithm, to the base 4,096, of the largest tree.
    """
    nodes = written(leaves.select("tree", F.lit(0).alias("level"), "at", "h", "n"), "merkle-nodes")
    level, found = nodes, [nodes]
    base = 0
    while not (todo := level.filter("n > 1")).isEmpty():
        blocks = todo.groupBy("tree", "n", F.expr(f"at div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("leaves"))
        made = written(_join_blocks(blocks.select("tree", F.lit(base).alias("base"), "n", "block", "leaves")), "merkle-nodes", small=True)
        found.append(made)
        base += LEVELS
        level = made.filter(F.col("level") == base)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def missing(at: Sequence[int], n: int) -> list[tuple[int, int]]:
    """(level, place) of the nodes that proofs of the leaves ``at`` need and that these leaves do not give, each once. ``n``: leaves of the tree."""
    known, out, level = sorted(set(at)), [], 0
    while n > 1:
        parents = sorted({i // FAN for i in known})
        held = set(known)
        out += [(level, i) for p in parents for i in range(p * FAN, min(n, (p + 1) * FAN)) if i not in held]
        known, n, level = parents, -(-n // FAN), level + 1
    return out


class Partition:
    """The part of a tree that a partition of its leaves can see: its leaves, what it fetched, and what follows from them."""

    def __init__(self, leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int):
        self.rows: list[dict[int, str]] = [dict(leaves)]
        level, known, self.sizes = 0, sorted(leaves), [n]
        while n > 1:
            row = self.rows[level]
            row.update({i: h for (at, i), h in fetched.items() if at == level})
            parents, above = sorted({i // FAN for i in known}), -(-n // FAN)
            self.rows.append({p: _h([row[i] for i in range(p * FAN, min(n, (p + 1) * FAN))]) for p in parents})
            known, n, level = parents, above, level + 1
            self.sizes.append(n)
        self.top = self.rows[-1][0]

    def proof(self, at: int) -> list[tuple[list[str], list[str]]]:
        """Siblings to the left and to the right, level by level."""
        out = []
        for row, n in zip(self.rows[:-1], self.sizes):
            first = at // FAN * FAN
            out.append(([row[i] for i in range(first, at)], [row[i] for i in range(at + 1, min(n, first + FAN))]))
            at //= FAN
        return out


def fold(h: str, proof: Sequence[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf leads to with the siblings of a proof."""
    for left, right in proof:
        h = _h([*left, h, *right])
    return h


def _needs(parts: DataFrame) -> DataFrame:
    """part, tree, level, at of every node that a partition must fetch, in its own tree and in the tree over the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                out += [(r["tree"], r["block"], r["tree"], level, i) for level, i in missing(range(r["lo"], r["hi"] + 1), r["n"])]
                out += [(r["tree"], r["block"], TOP, level, i) for level, i in missing([r["tree"]], r["trees"])]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["part_tree", "block", "tree", "level", "at"])

    return parts.mapInArrow(run, "part_tree bigint, block bigint, tree bigint, level int, at bigint")


#: number of the tree over the subroots
TOP = -1


def proofs(leaves: DataFrame, nodes: DataFrame, trees: int) -> DataFrame:
    """key, h, changed, subroot, root, proof_sha256, folded_root for every leaf. ``leaves``: tree, at, n, h, changed, key; ``nodes``: of all trees, ``TOP`` included."""
    block = F.expr(f"at div {BLOCK}").alias("block")
    parts = leaves.groupBy("tree", "n", block).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    needs = written(_needs(parts.withColumn("trees", F.lit(trees))), "merkle-needs", small=True)
    # nodes far up are asked for by many partitions
    many = (F.col("tree") == TOP) | (F.col("level") >= LEVELS + SPREAD)
    asked = needs.withColumn("copy", F.when(many, F.pmod(F.xxhash64("part_tree", "block"), F.lit(COPIES))).otherwise(0))
    zero, last = F.lit(0).cast("bigint"), F.lit(COPIES - 1).cast("bigint")
    copies = F.explode(F.when(many, F.sequence(zero, last)).otherwise(F.array(zero))).alias("copy")
    held = nodes.select("tree", "level", "at", "h", copies)
    got = asked.join(held, ["tree", "level", "at", "copy"]).groupBy(F.col("part_tree").alias("tree"), "block").agg(
        F.collect_list(F.struct((F.col("tree") == TOP).alias("top"), "level", "at", "h")).alias("fetched"))
    # a block has at most BLOCK leaves, and fetches at most seven nodes a level
    rows = leaves.groupBy("tree", "n", block).agg(F.collect_list(F.struct("at", "h", "changed", "key")).alias("leaves"))
    work = rows.join(got, ["tree", "block"], "left").withColumn("trees", F.lit(trees))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(len(batch)):
                r = batch.slice(one, 1).to_pylist()[0]
                fetched = r["fetched"] or []
                mine = {(x["level"], x["at"]): x["h"] for x in fetched if not x["top"]}
                tree = Partition({x["at"]: x["h"] for x in r["leaves"]}, mine, r["n"])
                over = Partition({r["tree"]: tree.top}, {(x["level"], x["at"]): x["h"] for x in fetched if x["top"]}, r["trees"])
                above, out = over.proof(r["tree"]), []
                for x in r["leaves"]:
                    proof = tree.proof(x["at"]) + above
                    siblings = _h([h for left, right in proof for h in (*left, *right)])
                    folded = fold(x["h"] if x["changed"] is None else x["changed"], proof)
                    out.append((x["key"], x["h"], tree.top, over.top, siblings, folded))
                types = (pa.int64(), *[pa.string()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    return work.mapInArrow(run, "key bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def manifest(df: DataFrame, key: str, group: str, fields: Sequence[str], changed: Sequence[Column] | None = None, tampered: Column | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``key`` (whole numbers) orders the rows of a group; ``fields`` make the leaf. Where ``tampered`` holds, the
    proof is folded from the leaf of ``changed``, the fields after a change, and must then fail if they differ.
    """
    other = F.when(tampered, leaf(changed)) if tampered is not None else F.lit(None).cast("string")
    names = [F.col(f"`{f}`") for f in fields]
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{group}`").cast("string").alias("group"), leaf(names).alias("h"), other.alias("changed"))
    rows = written(rows, "merkle-leaves")
    ordered = written(placed(rows, ["group"], ["key", "h"]), "merkle-placed")
    sizes = written(ordered.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "merkle-groups", small=True)
    trees = sizes.count()
    # groups in order: null first, then by bytes of UTF-8
    tree = running(sizes.withColumn("name", F.col("group").cast("binary")), [], ["name"], sums={"tree": F.lit(1).cast("bigint")}).select("group", (F.col("tree") - 1).alias("tree"), "n")
    tree = written(tree.withColumnRenamed("group", "name"), "merkle-groups", small=True)
    leaves = written(ordered.join(tree, ordered["group"].eqNullSafe(tree["name"])).select("tree", "at", "n", "h", "changed", "key"), "merkle-leaves")
    nodes = build(leaves)
    subroots = nodes.filter("n = 1").select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("at"), "h", F.lit(trees).cast("bigint").alias("n"))
    out = proofs(leaves, nodes.unionByName(build(subroots)), trees)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
