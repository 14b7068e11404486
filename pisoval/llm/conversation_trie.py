"""Prefix trie of conversations: z-fast tries over ranges of them, joined where ranges meet.

A turn is a letter, told apart by 128 bits of its role and text, so a conversation is a string of 16 bytes a turn. Strings that are the same
conversation are counted first; the distinct ones are dealt by range and sorted, and each piece of a range becomes one z-fast trie: its
compacted nodes (root, ends, branchings) are hashed at their handles, the prefix whose depth is the most divisible by two between
the parent's depth and the node's. A string finds its exit node by a fat binary search over depths, asking the table for one handle a
step; then it ends there, hangs a leaf there, or splits the edge. Batches are inserted one after another, and in the end edges are
expanded into the nodes of single turns.

A node that strings of several pieces start with lies on the border of pieces, so it is a prefix of a piece's first or last string. Such
open nodes come with what their piece holds below them; each piece counts only what no piece before it counts, so sums over pieces are right.
"""
from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.lookup import look_up, measure
from ..session import cut_lineage

#: Bytes of a turn; strings and bytes of one trie; strings inserted together; bytes of a chunk of listed ids.
TURN, STRINGS, BYTES, BATCH, CHUNK = 16, 20_000, 1 << 22, 1024, 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def fattest(a: int, b: int) -> int:
    """The number in (a, b] that the highest power of two divides."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


def common(x: bytes, y: bytes, start: int, most: int) -> int:
    """Depth up to which x and y agree, if they do up to start; not beyond most."""
    while start < most and x[start * TURN:(start + 1) * TURN] == y[start * TURN:(start + 1) * TURN]:
        start += 1
    return start


class Node:
    """A compacted node: its edge has the depths from above + 1 to depth of string."""
    __slots__ = ("parent", "above", "depth", "string", "sizes", "children", "end", "convs", "least", "leaves", "saved", "own")

    def __init__(self, parent: "Node | None", above: int, depth: int, string: bytes, sizes: array):
        self.parent, self.above, self.depth, self.string, self.sizes = parent, above, depth, string, sizes
        self.children: dict[bytes, Node] = {}
        self.end = None


class ZFastTrie:
    """Strings of turns with what ends there: (conversations, least id, digest of ids)."""

    def __init__(self):
        self.root = Node(None, 0, 0, b"", array("i"))
        self.handles: dict[bytes, Node] = {}
        self.nodes = [self.root]

    def exit(self, string: bytes) -> tuple[Node, int]:
        """The node whose edge (or place) the string leaves the trie from, and the depth up to which they agree."""
        n = len(string) // TURN
        node, a, b = self.root, 0, n
        while a < b:
            f = fattest(a, b)
            met = self.handles.get(string[:f * TURN])
            if met is None:
                b = f - 1
                continue
            agree = common(string, met.string, f, min(met.depth, n))
            if agree < met.depth:
                return met, agree
            node, a = met, met.depth
        child = node.children.get(string[node.depth * TURN:(node.depth + 1) * TURN]) if node.depth < n else None
        return (child, common(string, child.string, node.depth, min(child.depth, n))) if child else (node, node.depth)

    def insert_batch(self, batch: list[tuple[bytes, array, tuple]]) -> None:
        for string, sizes, end in batch:
            node, agree = self.exit(string)
            if agree < node.depth:
                node = self._split(node, agree)
            if agree < len(string) // TURN:
                node = self._hang(node, string, sizes)
            node.end = end

    def _handle(self, node: Node) -> None:
        self.handles[node.string[:fattest(node.above, node.depth) * TURN]] = node

    def _hang(self, node: Node, string: bytes, sizes: array) -> Node:
        leaf = Node(node, node.depth, len(string) // TURN, string, sizes)
        node.children[string[node.depth * TURN:(node.depth + 1) * TURN]] = leaf
        self.nodes.append(leaf)
        self._handle(leaf)
        return leaf

    def _split(self, node: Node, at: int) -> Node:
        """A new node within the edge. The part that has the handle's depth keeps the handle; the other gets its own."""
        middle = Node(node.parent, node.above, at, node.string, node.sizes)
        node.parent.children[node.string[node.above * TURN:(node.above + 1) * TURN]] = middle
        middle.children[node.string[at * TURN:(at + 1) * TURN]] = node
        node.parent, node.above = middle, at
        self.nodes.append(middle)
        self._handle(middle)
        self._handle(node)
        return middle


_KINDS = {"open": pa.bool_(), "place": pa.binary(), "parent_place": pa.binary(), "depth": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(),
          "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string()}
_SCHEMA = "open boolean, place binary, parent_place binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _place(string: bytes, depth: int) -> bytes:
    return hashlib.md5(string[:depth * TURN]).digest()


def expand(trie: ZFastTrie, first: bytes, last: bytes, before: int, after: int) -> Iterator[tuple]:
    """Rows of every node in the order of _KINDS. before and after: how deep the first string agrees with the last one of the piece
    before, and the last one with the first of the piece after; below 0 where there is no such piece. The root is always open."""
    def border(v: Node) -> tuple[int, int]:
        """Depths on the way to v up to which nodes belong to an earlier piece, and up to which they are open."""
        earlier = common(v.string, first, 0, min(before, v.depth)) if before >= 0 else -1
        later = common(v.string, last, 0, min(after, v.depth)) if after >= 0 else -1
        return earlier, max(earlier, later, 0)

    deepest = sorted(trie.nodes, key=lambda v: -v.depth)
    for v in deepest:
        v.convs, v.least, v.leaves, v.saved, v.own = (v.end[0], v.end[1], 0, 0, 0) if v.end else (0, None, 0, 0, 0)
    borders = {}
    for v in deepest:  # children come before their parents
        earlier, open_ = borders[v] = border(v)
        if not v.children and open_ < v.depth:
            v.leaves += 1
        if v.parent is None:
            continue
        p, size = v.parent, sum(v.sizes[v.above:v.depth])
        owned = sum(v.sizes[max(v.above, earlier):v.depth]) if earlier < v.depth else 0
        p.convs, p.leaves = p.convs + v.convs, p.leaves + v.leaves
        p.least = v.least if p.least is None else min(p.least, v.least)
        own_top = v.sizes[v.depth - 1] if earlier < v.depth else 0
        v.saved += v.convs * v.sizes[v.depth - 1] - own_top  # now with v itself
        p.saved += v.saved + v.convs * (size - v.sizes[v.depth - 1]) - (owned - own_top)
        p.own += earlier < v.above + 1
    for v in trie.nodes:
        earlier, open_ = borders[v]
        saved, own = v.saved, v.own
        for depth in range(v.depth, v.above if v.parent else -1, -1):
            if depth < v.depth:
                saved += v.convs * v.sizes[depth - 1] - (v.sizes[depth - 1] if depth > earlier else 0)
                own = int(depth + 1 > earlier)
            is_open, under = depth <= open_, depth > 0 and depth - 1 <= open_
            parent = None if not depth or under else v.least if depth - 1 > v.above else v.parent.least
            ends = v.end[2] if v.end and depth == v.depth else None if is_open else NOTHING
            yield (is_open, _place(v.string, depth) if is_open else None, _place(v.string, depth - 1) if under else None, depth, v.least, parent,
                   v.convs, own, v.leaves, saved, ends)


def _pieces(rows: Iterator[tuple], most: int) -> Iterator[tuple[list, bytes | None]]:
    """Sorted strings in pieces of bounded size, each with the string after it."""
    held, size = [], 0
    for row in rows:
        if held and (len(held) >= most or size + len(row[0]) > BYTES):
            yield held, row[0]
            held, size = [], 0
        held.append(row)
        size += len(row[0])
    if held:
        yield held, None


def turns_of(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, letter, size): a turn's letter is a digest of role and text, its size the code points of its text. A null role
    or text is empty; rows without a conv_id belong to no conversation and are left out; other columns are not looked at."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    letter = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return df.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"),
        letter.alias("letter"), F.length(text).alias("size"))


def sequences(turns: DataFrame, lender: Column, lent: Column, most_lent: int) -> DataFrame:
    """(conv_id, place, string, sizes): each conversation as a string, beginning with the first `lent` turns of the conversation `lender` (all,
    if it has fewer; none, if there is no such conversation) in the place of as many turns of its own.

    lender and lent are expressions over conv_id, lent at most most_lent; a lender must be its own lender. Turns go by number (null
    first), then role, then letter; repeated rows are turns like any other. A lender and its borrowers stream through one task, one
    conversation at a time; a conversation's string is one row of 20 bytes a turn.
    """
    marked = turns.withColumns({"lender": lender, "lent": lent.cast("int")})
    ordered = marked.repartition("lender").sortWithinPartitions(
        "lender", F.col("conv_id") != F.col("lender"), "conv_id", F.col("turn").asc_nulls_first(), "role", "letter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5))))
        out, held, of = [], 0, None
        for (conv, base), own in groupby(rows, key=lambda r: (r[0], r[1])):
            if base != of:
                of, head, head_sizes = base, b"", array("i")
            string, sizes, n = bytearray(), array("i"), None
            for at, (_, _, n, letter, size) in enumerate(own):
                if conv == base and at < most_lent:
                    head += letter
                    head_sizes.append(size)
                if conv == base or at >= n:
                    string += letter
                    sizes.append(size)
            if conv != base:
                string, sizes = head[:n * TURN] + bytes(string), head_sizes[:n] + sizes
            string = bytes(string)
            out.append((conv, hashlib.md5(string).digest(), string, sizes.tobytes()))
            held += len(string)
            if len(out) >= 4096 or held > 1 << 22:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)

    def _batch(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 3))], ["conv_id", "place", "string", "sizes"])
    return ordered.select("conv_id", "lender", "lent", "letter", "size").mapInArrow(run, "conv_id long, place binary, string binary, sizes binary")


def ends_of(strings: DataFrame) -> DataFrame:
    """(place, n, least, ends_sha256) of each distinct string: how many conversations are it, the least id, and the SHA-256 of their ids.

    Ids are dealt by range and written out in chunks, so a hot string's ids are sorted and formatted by many tasks; only its chunks go
    through one, as the hash is one over a text in order. They stream through it.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for place, ids in groupby(rows, key=lambda r: r[0]):
            held, size, least = [], 0, None
            for _, i in ids:
                least = i if not held else least
                held.append(str(i))
                size += len(held[-1]) + 1
                if size > CHUNK:
                    yield _chunk(place, least, held)
                    held, size = [], 0
            if held:
                yield _chunk(place, least, held)

    def _chunk(place: bytes, least: int, ids: list[str]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([place], pa.binary()), pa.array([least], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([",".join(ids)])],
                               ["place", "least", "n", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
        out = []
        for place, chunks in groupby(rows, key=lambda r: r["place"]):
            sha, n, least = hashlib.sha256(), 0, None
            for c in chunks:
                if n:
                    sha.update(b",")
                else:
                    least = c["least"]
                sha.update(c["ids"].encode())
                n += c["n"]
            out.append((place, n, least, sha.hexdigest()))
            if len(out) >= 4096:
                yield _ends(out)
                out = []
        if out:
            yield _ends(out)

    def _ends(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["place", "n", "least", "ends_sha256"])
    listed = strings.select("place", "conv_id").repartitionByRange("place", "conv_id").sortWithinPartitions("place", "conv_id")
    chunks = listed.mapInArrow(write, "place binary, least long, n long, ids string")
    return chunks.repartition("place").sortWithinPartitions("place", "least").mapInArrow(digest, "place binary, n long, least long, ends_sha256 string")


def prefix_trie(strings: DataFrame, most: int = STRINGS) -> DataFrame:
    """Nodes of the trie of `sequences`' strings: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    conv_id is the smallest member; a conversation without turns is a member of the root alone; without any conversation there is no node.
    most bounds the strings of a piece.
    """
    strings = cut_lineage(strings)
    ends = ends_of(strings)
    one = strings.select(F.col("conv_id").alias("least"), "string", "sizes").join(ends, "least").select("string", "sizes", "n", "least", "ends_sha256")
    dealt = cut_lineage(one.repartitionByRange("string").sortWithinPartitions("string").withColumn("part", F.spark_partition_id()))

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = None
        for b in batches:
            if b.num_rows:
                part, string = b.column(0), b.column(1)
                ends = [part[0].as_py(), ends[1] if ends else string[0].as_py(), string[-1].as_py()]
        if ends:
            yield pa.record_batch([pa.array([ends[0]], pa.int32()), pa.array([ends[1]], pa.binary()), pa.array([ends[2]], pa.binary())], ["part", "first", "last"])
    edges = dealt.select("part", "string").mapInArrow(outer, "part int, first binary, last binary").orderBy("part")
    before, after, last = {}, {}, None
    for r in edges.toLocalIterator():  # one row a range; two strings are held
        if last is not None:
            before[r["part"]] = after[last[0]] = common(last[1], bytes(r["first"]), 0, min(len(last[1]), len(r["first"])) // TURN)
        last = r["part"], bytes(r["last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None

        def rows():
            nonlocal part
            for b in batches:
                for at in range(0, b.num_rows, BATCH):
                    c = b.slice(at, BATCH)
                    part = c.column(5)[0].as_py()
                    for string, sizes, n, least, sha in zip(*(c.column(i).to_pylist() for i in range(5))):
                        yield string, array("i", sizes), (n, least, sha)
        agree = None
        for held, next_ in _pieces(rows(), most):
            trie = ZFastTrie()
            for at in range(0, len(held), BATCH):
                trie.insert_batch(held[at:at + BATCH])
            first, last = held[0][0], held[-1][0]
            ahead = common(last, next_, 0, min(len(last), len(next_)) // TURN) if next_ is not None else after.get(part, -1)
            found = expand(trie, first, last, before.get(part, -1) if agree is None else agree, ahead)
            agree = ahead
            out = []
            for row in found:
                out.append(row)
                if len(out) >= 8192:
                    yield _nodes(out)
                    out = []
            if out:
                yield _nodes(out)

    def _nodes(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS.values())], list(_KINDS))
    nodes = cut_lineage(dealt.select("string", "sizes", "n", "least", "ends_sha256", "part").mapInArrow(run, _SCHEMA))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = cut_lineage(nodes.where("open").groupBy("place").agg(
        F.max("parent_place").alias("parent_place"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.coalesce(F.max("ends_sha256"), F.lit(NOTHING)).alias("ends_sha256"))
                        # Of open nodes only a root alone has no child.
                        .withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))))
    names = measure(shared.select(F.col("place").alias("parent_place"), F.col("conv_id").alias("parent_conv_id")), ["parent_place"])
    # Children of open nodes learn their parent's least id here; deeper ones know it.
    below = nodes.where("not open and parent_place is not null").drop("parent_conv_id")
    return (look_up(shared, names).select(columns).union(look_up(below, names).select(columns))
            .union(nodes.where("not open and parent_place is null").select(columns)))
