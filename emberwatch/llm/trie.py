"""Prefix trie of conversations by adaptive radix trees.

A turn has an id of 16 bytes, the first half of the SHA-256 of its role and text, and a conversation is the big-endian
string of its turns' ids. A task puts the distinct strings of a range of keys into an adaptive radix tree, whose nodes
have one of four layouts by their number of children and whose paths without a branch are compressed. Branches may
stand at any byte; only depths at the end of a turn give nodes of the trie. What trees of different
ranges say of one node is added up.

No task holds a whole conversation: strings are cut into segments of ``SEGMENT`` turns, and the key of a
segment starts with the fingerprint (128 bits) of all turns before it, so that equal segments after equal turns meet.
Equal segments are counted before they enter a tree. Sums over subtrees are not carried up level by level:
a node belongs to its smallest member, the nodes of one owner are the end of that conversation's path, so a
subtree's sum is a running sum along the owner's path plus the totals of all owners whose path comes off below.

Defined results: rows of no conversation (null id) are left out; a null role or text is empty; turns of one number are
ordered by their id, so repeated rows are turns of their own; a conversation without turns ends at the root; an
empty table has no nodes, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocked import ranged, running
from .shared import columns, written

#: bytes of a turn's id, and of the fingerprint in front of a segment
WIDTH = 16
#: turns in a segment
SEGMENT = 32
#: segments in one tree; a task that has more gives the tree's nodes and starts another
TREE_KEYS = 50_000
#: turns of a conversation, or children of a node, that one task brings together with a single row
PIECE = 1 << 16
PIECES = 1024
#: ids in one text on the way to a digest
RUN = 512


class Node:
    """A node of a radix tree. Layouts by number of children: 4 and 16 (list of bytes beside list of children), 48 (a table of 256 places into a list), 256 (a child per byte)."""

    __slots__ = ("path", "kind", "index", "kids", "held")

    def __init__(self, path: bytes):
        self.path, self.kind, self.index, self.kids, self.held = path, 4, bytearray(), [], None

    def find(self, byte: int) -> Node | None:
        if self.kind <= 16:
            i = self.index.find(byte)
            return None if i < 0 else self.kids[i]
        if self.kind == 48:
            i = self.index[byte]
            return self.kids[i - 1] if i else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Sets the child at a byte; a full node gets the next layout."""
        if self.kind <= 16:
            if (i := self.index.find(byte)) >= 0:
                self.kids[i] = kid
                return
            if len(self.kids) < self.kind:
                self.index.append(byte)
                self.kids.append(kid)
                return
            if self.kind == 4:
                self.kind = 16
            else:
                table = bytearray(256)
                for i, b in enumerate(self.index, 1):
                    table[b] = i
                self.kind, self.index = 48, table
            self.put(byte, kid)
        elif self.kind == 48:
            if i := self.index[byte]:
                self.kids[i - 1] = kid
            elif len(self.kids) < 48:
                self.kids.append(kid)
                self.index[byte] = len(self.kids)
            else:
                self.kids = [self.kids[i - 1] if i else None for i in self.index]
                self.kind, self.index = 256, None
                self.put(byte, kid)
        else:
            self.kids[byte] = kid

    def children(self) -> list[Node]:
        return [k for k in self.kids if k is not None] if self.kind == 256 else self.kids


class RadixTree:
    """Keys with a count, a least member and a value each; equal keys are added up."""

    def __init__(self):
        self.root, self.size = None, 0

    def add(self, key: bytes, n: int, least: int, value) -> None:
        self.size += 1
        new = (n, least, value)
        if self.root is None:
            self.root = Node(key)
            self.root.held = new
            return
        node, above, at = self.root, None, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                # the path ends where key and path part: a node goes in between
                m = next(i for i in range(len(path)) if at + i >= len(key) or key[at + i] != path[i])
                between = Node(path[:m])
                node.path = path[m + 1 :]
                between.put(path[m], node)
                if above is None:
                    self.root = between
                else:
                    above.put(key[at - 1], between)
                node = between
                path = node.path
            at += len(path)
            if at == len(key):
                old = node.held
                node.held = new if old is None else (old[0] + n, min(old[1], least), old[2])
                return
            kid = node.find(key[at])
            if kid is None:
                kid = Node(key[at + 1 :])
                kid.held = new
                node.put(key[at], kid)
                return
            node, above, at = kid, node, at + 1

    def nodes(self, start: int, width: int) -> Iterator[tuple[int, int, int, object]]:
        """(turns, count, least member, a value below) for each depth that is ``start`` and whole turns of ``width`` bytes, every path that ends there once."""
        if self.root is None:
            return
        order = [(self.root, -1, 0)]  # node, place of the node above, depth at which its edge starts
        ends = []
        for node, _, begin in order:
            end = begin + len(node.path)
            ends.append(end)
            order.extend((kid, len(ends) - 1, end + 1) for kid in node.children())
        sums = [node.held for node, _, _ in order]
        for i in range(len(order) - 1, -1, -1):
            node, up, begin = order[i]
            n, least, value = sums[i]
            # depths on this edge: all have the members of the node at its end
            above = -1 if up < 0 else ends[up]
            first = max(1, (above - start) // width + 1)
            for k in range(first, (ends[i] - start) // width + 1):
                yield k, n, least, value
            if up >= 0:
                old = sums[up]
                sums[up] = sums[i] if old is None else (old[0] + n, min(old[1], least), old[2])


def turn_id(role: Column, text: Column) -> Column:
    """First 16 bytes of the SHA-256 of role and text, as 32 hex digits; the role's length tells where the text begins."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)


def share(conv: Column) -> Column:
    """Turns that a conversation takes over from the first one of its hundred."""
    return F.crc32(conv.cast("string").cast("binary")) % 6


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with their shared beginnings: rows (conv, d, id, chars), d from 1, and all conversations (conv, length)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.filter(F.col("conv").isNotNull()).select("conv", "turn", turn_id(role, text).alias("id"), F.length(text).cast("bigint").alias("chars"))
    own = written(running(rows, ["conv"], ["turn", "id"], sums={"pos": F.lit(1).cast("bigint")}).select("conv", "pos", "id", "chars"), "trie-turns")
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.col("conv") - F.col("conv") % 100).withColumn("h", share(F.col("conv")))
    bases = convs.filter("conv = base").select("base", F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0).cast("bigint"))))
    convs = written(convs.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("bigint"))), "trie-conversations")
    # at most five turns of a base, for at most a hundred conversations
    begins = own.filter("conv % 100 = 0 AND pos <= 5").select(F.col("conv").alias("base"), "pos", "id", "chars")
    heads = convs.filter("head > 0").join(begins, "base").filter("pos <= head").select("conv", F.col("pos").alias("d"), "id", "chars")
    # a long conversation meets its row in pieces
    piece = (F.col("pos") / PIECE).cast("bigint")
    spread = convs.select("conv", "h", "head", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("n") / PIECE).cast("bigint"))).alias("piece"))
    tails = own.withColumn("piece", piece).join(spread, ["conv", "piece"]).filter("pos > h").select("conv", (F.col("head") + F.col("pos") - F.col("h")).alias("d"), "id", "chars")
    return heads.unionByName(tails), convs.select("conv", "length")


def _partial_nodes(segments: DataFrame) -> DataFrame:
    """Nodes as the trees of each range of segments see them. ``segments``: key, n, least, chars, fa, fb, pa, pb, depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fa", "fb", "depth", "up_a", "up_b", "n", "conv", "chars"]

        def given(tree: RadixTree) -> pa.RecordBatch:
            out = []
            for k, n, least, (chars, fa, fb, up_a, up_b, depth) in tree.nodes(WIDTH, WIDTH):
                up = (up_a, up_b) if k == 1 else (fa[k - 2], fb[k - 2])
                out.append((fa[k - 1], fb[k - 1], depth + k, *up, n, least, chars[k - 1]))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

        tree = RadixTree()
        for batch in batches:
            for key, n, least, *value in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "least", "chars", "fa", "fb", "pa", "pb", "depth"))):
                tree.add(key, n, least, value)
                if tree.size >= TREE_KEYS:
                    yield given(tree)
                    tree = RadixTree()
        if tree.size:
            yield given(tree)

    return segments.mapInArrow(run, "fa bigint, fb bigint, depth bigint, up_a bigint, up_b bigint, n bigint, conv bigint, chars bigint")


def nodes(rows: DataFrame) -> DataFrame:
    """Trie nodes below the root: fa, fb (fingerprint), depth, up_a, up_b (of the parent), n, conv (smallest member), chars. ``rows``: conv, d, id, chars, ha, hb, fa, fb."""
    item = F.struct("d", "id", "chars", "fa", "fb", "ha", "hb")
    cut = rows.groupBy("conv", F.expr(f"(d - 1) div {SEGMENT}").alias("segment")).agg(F.array_sort(F.collect_list(item)).alias("t"))  # at most SEGMENT turns
    first = F.col("t")[0]
    before = [first["fa"].bitwiseXOR(first["ha"]), first["fb"].bitwiseXOR(first["hb"])]
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    keyed = cut.select(
        "conv", F.unhex(F.concat(*map(hexed, before), F.array_join(F.col("t.id"), ""))).alias("key"), before[0].alias("pa"), before[1].alias("pb"),
        (F.col("segment") * SEGMENT).alias("depth"), F.col("t.chars").alias("chars"), F.col("t.fa").alias("fa"), F.col("t.fb").alias("fb"))
    distinct = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"), *[F.any_value(c).alias(c) for c in ("chars", "fa", "fb", "pa", "pb", "depth")])
    parts = _partial_nodes(distinct.repartitionByRange("key"))
    return parts.groupBy("fa", "fb", "depth", "up_a", "up_b").agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("chars").alias("chars"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """fa, fb, ends_sha256: SHA-256 of the ids, ascending and joined by commas, of all conversations that end at a node. ``ends``: fa, fb, conv.

    Ids sorted within ranges become texts of up to ``RUN`` ids; only these meet in the task of their node, and
    are read as a stream.
    """
    dealt = ranged(ends, ["fa", "fb"], ["conv"]).sortWithinPartitions("_part", "fa", "fb", "conv")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in ("fa", "fb", "conv"))):
                if not out or out[-1][:2] != [a, b] or len(out[-1][3]) == RUN:
                    out.append([a, b, c, []])
                out[-1][3].append(str(c))
            if out:
                yield pa.RecordBatch.from_arrays([*[pa.array([o[i] for o in out], pa.int64()) for i in range(3)], pa.array([",".join(o[3]) for o in out])], names=["fa", "fb", "first", "ids"])

    texts = dealt.select("fa", "fb", "conv").mapInArrow(pack, "fa bigint, fb bigint, first bigint, ids string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def given(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["fa", "fb", "ends_sha256"])

        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(x).to_pylist() for x in ("fa", "fb", "ids"))):
                if (a, b) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256(ids.encode())
            if done:
                yield given(done)
        if node is not None:
            yield given([(*node, state.hexdigest())])

    return texts.repartition("fa", "fb").sortWithinPartitions("fa", "fb", "first").mapInArrow(digest, "fa bigint, fb bigint, ends_sha256 string")


EMPTY = hashlib.sha256(b"").hexdigest()


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = columns(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col).withColumn("conv", F.col("conv").cast("bigint"))
    path, convs = rebuilt(turns)
    path = path.withColumns({"ha": F.xxhash64("d", "id"), "hb": F.xxhash64(F.lit("b"), "d", "id")})
    rows = written(running(path, ["conv"], ["d"], xors={"fa": F.col("ha"), "fb": F.col("hb")}), "trie-rows")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv")).filter("n > 0").select(
        zero.alias("fa"), zero.alias("fb"), zero.alias("depth"), none.alias("up_a"), none.alias("up_b"), "n", "conv", zero.alias("chars"))
    found = written(nodes(rows).unionByName(root), "trie-nodes")

    # children per node, counted in pieces of a node's children
    piece = F.pmod(F.col("fa"), F.lit(PIECES)).alias("piece")
    groups = written(found.filter("up_a IS NOT NULL").groupBy("up_a", "up_b", piece).agg(F.count(F.lit(1)).alias("kids")), "trie-children")
    kids = groups.groupBy(F.col("up_a").alias("fa"), F.col("up_b").alias("fb")).agg(F.sum("kids").alias("n_children"))
    found = written(found.join(kids, ["fa", "fb"], "left").withColumns({
        "n_children": F.coalesce("n_children", zero), "saved": (F.col("n") - 1) * F.col("chars"), "leaf": F.col("n_children").isNull().cast("bigint")}), "trie-nodes")
    parents = groups.join(found.select(F.col("fa").alias("up_a"), F.col("fb").alias("up_b"), F.col("conv").alias("up_conv")), ["up_a", "up_b"]).select("up_a", "up_b", "piece", "up_conv")

    # sums along the path of the owner, from its end
    along = running(found.withColumn("_up", -F.col("depth")), ["conv"], ["_up"], sums={"saved_own": F.col("saved"), "leaves_own": F.col("leaf")})
    owners = written(found.groupBy("conv").agg(F.min("depth").alias("top"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves")), "trie-owners")
    # owners whose path comes off below a node add all they have
    spread = owners.filter("top > 1").select("conv", "top", "saved", "leaves", F.explode(F.sequence(zero, ((F.col("top") - 1) / PIECE).cast("bigint"))).alias("piece"))
    off = rows.select("conv", "d", "fa", "fb", (F.col("d") / PIECE).cast("bigint").alias("piece")).join(spread, ["conv", "piece"]).filter("d < top")
    off = off.select("fa", "fb", "saved", "leaves").unionByName(owners.filter("top > 0").select(zero.alias("fa"), zero.alias("fb"), "saved", "leaves"))
    off = written(off.groupBy("fa", "fb").agg(F.sum("saved").alias("saved_off"), F.sum("leaves").alias("leaves_off")), "trie-sums")

    last = rows.groupBy("conv").agg(F.max_by(F.struct("fa", "fb"), "d").alias("f")).select("f.fa", "f.fb", "conv")
    ends = ends_digests(last.unionByName(convs.filter("length = 0").select(zero.alias("fa"), zero.alias("fb"), "conv")))
    out = along.withColumn("piece", piece).join(parents, ["up_a", "up_b", "piece"], "left").join(off, ["fa", "fb"], "left").join(ends, ["fa", "fb"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("up_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        (F.col("leaves_own") + F.coalesce("leaves_off", zero)).alias("n_leaves"), (F.col("saved_own") + F.coalesce("saved_off", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
