"""The trie of conversations: splitter skeleton, local sorted shards, partial aggregates reduced.

Method. A conversation is its path: one mark (a digest of role and text) per turn. Rows (path, conv_id) are dealt to ranges of their
order, cut by splitters from a bounded sample. A node's conversations lie side by side in that order, so a node that a cut goes through
is a beginning of that splitter's path. The trie of all splitter paths, the skeleton, is handed to every task. Each range is sorted
and read once, with the open path on a stack: nodes off the skeleton are whole in their range and finished there; for nodes of the skeleton
it leaves partial aggregates, which are added up by node, and the sums are carried from children to parents along the skeleton.

Scale. One shuffle of narrow rows (32 characters and a number a turn). Conversations that are all alike are still cut, by
their identifiers. The skeleton has a bound: ``SKELETON`` nodes; where splitter paths would need more, all are cut at the
depth that fits (``CUT`` turns at most), which only makes ranges coarser. The identifiers that end in a node of the
skeleton are hashed from chunks of ``CHUNK``, in order, in constant memory. Turns of one conversation are put
together in one row.

Defined results. Turns are taken by number (null first), then role, then the turn's digest; a null role or text is empty. Rows without
conversation take no part. Of a path without turns the end is the root. No conversations give no rows; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import WHITE_SPACE, batches, column
from .ranges import splitters

MARK = 32
CUT = 1024
SKELETON = 1 << 18
SAMPLED_PER_RANGE = 16
CHUNK = 4096


def paths(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, turns: array of (mark, words), in order; one row per conversation."""
    role, text = F.coalesce(column(role_col), F.lit("")), F.coalesce(column(text_col), F.lit(""))
    told = rows.select(
        column(conv_col).cast("long").alias("conv_id"),
        column(turn_col).alias("turn"),
        role.alias("role"),
        F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary")).alias("mark"),
        F.size(F.array_remove(F.split(text, WHITE_SPACE + "+"), "")).alias("words"),
    ).filter("conv_id is not null")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "mark", "words")))
    grouped = told.groupBy("conv_id").agg(turns.alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["mark"].alias("mark"), t["words"].alias("words"))).alias("turns"))


def with_shared_openings(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Paths whose first h turns are those of conversation c - c % ``every``; h is the checksum of the decimal c, modulo ``most``."""
    known = written(conversations, "paths")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    opened = known.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    first = known.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("opening")
    )
    none = F.slice("turns", 1, 0)
    opening = F.slice(F.coalesce("opening", none), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return opened.join(first, "base", "left").select("conv_id", F.concat(opening, own).alias("turns"))


# --- splitters and their trie ------------------------------------------------------------


def _marks(path: str) -> list[str]:
    return [path[i : i + MARK] for i in range(0, len(path), MARK)]


class Skeleton:
    """Trie of splitter paths; node 0 is the root, and a parent comes before its children."""

    def __init__(self, cuts: list[tuple[str, int]], most: int = SKELETON):
        self.ways: list[dict[str, int]] = [{}]
        self.parent = [-1]
        level = {path: 0 for path, _ in cuts}  # node that each path has reached
        depth = 0
        while level:
            deeper, made = {}, len(self.ways)
            for path, node in level.items():
                if len(path) <= depth * MARK:
                    continue
                mark = path[depth * MARK : (depth + 1) * MARK]
                if mark not in self.ways[node]:
                    self.ways[node][mark] = len(self.ways)
                    self.ways.append({})
                    self.parent.append(node)
                deeper[path] = self.ways[node][mark]
            if len(self.ways) > most:  # this depth does not fit: taken back
                for node in range(made, len(self.ways)):
                    held = self.ways[self.parent[node]]
                    held.clear()
                del self.ways[made:], self.parent[made:]
                break
            level, depth = deeper, depth + 1
        self.cuts = sorted({(path[: depth * MARK], conv) for path, conv in cuts})


# --- one range, in order -----------------------------------------------------------------

NODE, PARTIAL, ENDS = range(3)
_ROW = {
    "kind": pa.int32(),
    "skeleton": pa.int64(),  # the node's own number; of a finished node its parent's, if that is on the skeleton
    "conv_id": pa.int64(),
    "depth": pa.int64(),
    "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(),
    "n_children": pa.int64(),
    "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(),
    "words": pa.int64(),
    "range": pa.int64(),
    "chunk": pa.int64(),
    "ends": pa.string(),  # digest, or a chunk of identifiers
}
_ROWS = (
    "kind int, skeleton long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, words long, range long, chunk long, ends string"
)


class _Node:
    __slots__ = ("mark", "skeleton", "words", "least", "n", "children", "leaves", "saved", "ends", "digest", "chunks", "below")

    def __init__(self, mark: str, skeleton: int, words: int):
        self.mark, self.skeleton, self.words = mark, skeleton, words
        self.least: int | None = None
        self.n = self.children = self.leaves = self.saved = self.chunks = 0
        self.ends: list[int] = []
        self.digest = None
        self.below: list[tuple] = []  # finished children, which wait for this node's identifier

    def meets(self, least: int, n: int) -> None:
        self.n += n
        if self.least is None or least < self.least:
            self.least = least


class Shard:
    """Walks the sorted conversations of ranges; rows gather in ``rows``."""

    def __init__(self, ways: list[dict[str, int]]):
        self.ways = ways
        self.rows: list[tuple] = []
        self.range: int | None = None
        self.open: list[_Node] = []

    def add(self, of: int, conv: int, path: str, words: list[int]) -> None:
        if of != self.range:
            self.finish()
            self.range, self.open = of, [_Node("", 0, 0)]
        marks = _marks(path)
        depth, most = 0, min(len(marks), len(self.open) - 1)
        while depth < most and self.open[depth + 1].mark == marks[depth]:
            depth += 1
        while len(self.open) - 1 > depth:
            self._close()
        for mark, n in zip(marks[depth:], words[depth:], strict=True):
            top = self.open[-1].skeleton
            self.open.append(_Node(mark, self.ways[top].get(mark, -1) if top >= 0 else -1, n))
        last = self.open[-1]
        last.meets(conv, 1)
        last.ends.append(conv)
        if len(last.ends) == CHUNK:
            self._drain(last)

    def finish(self) -> None:
        while self.open:
            self._close()

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def _drain(self, node: _Node) -> None:
        """Hand on the identifiers that have ended in a node: to its digest, or as a chunk for a node that others share."""
        text = ",".join(map(str, node.ends))
        if node.skeleton >= 0:
            blank = (None,) * 8
            self.rows.append((ENDS, node.skeleton, *blank, self.range, node.chunks, text))
        else:
            node.digest = node.digest or hashlib.sha256()
            node.digest.update((("," if node.chunks else "") + text).encode())
        node.chunks += 1
        node.ends = []

    def _close(self) -> None:
        node = self.open.pop()
        depth = len(self.open)
        above = self.open[-1] if self.open else None
        if node.ends:
            self._drain(node)
        if above is not None:
            above.meets(node.least, node.n)
        if node.skeleton >= 0:
            self.rows.append(
                (PARTIAL, node.skeleton, node.least, depth, None, node.n, node.children, node.leaves, node.saved, node.words, None, None, None)
            )
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.words
        digest = (node.digest or hashlib.sha256()).hexdigest()
        for conv, *rest in node.below:
            self._tell(conv, None, node.least, rest)
        told = (node.least, depth, node.n, node.children, leaves, saved, digest)
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        if above.skeleton >= 0:
            self._tell(node.least, above.skeleton, None, list(told[1:]))
        else:
            above.below.append(told)

    def _tell(self, conv: int, skeleton: int | None, parent: int | None, rest: list) -> None:
        depth, n, children, leaves, saved, digest = rest
        self.rows.append((NODE, skeleton, conv, depth, parent, n, children, leaves, saved, None, None, None, digest))


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _ROW]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ROW.values(), strict=True)], list(_ROW))


def _dealt(cuts: list[tuple[str, int]]) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            keys = zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)
            of = pa.array([max(bisect_right(cuts, key) - 1, 0) for key in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, of], [*batch.schema.names, "range"])

    return run


def _walked(ways: list[dict[str, int]]) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(ways)
        for batch in batches(source):
            for conv, path, words, of in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shard.add(of, conv, path, words)
                if len(shard.rows) >= CHUNK:
                    yield _record(shard.taken())
        shard.finish()
        yield _record(shard.taken())

    return run


# --- the skeleton's nodes ----------------------------------------------------------------

_SUMS = (
    "skeleton long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
)


def _carried_up(parent: list[int]) -> Callable:
    """Sums of the skeleton's nodes, children before parents; as many rows as the skeleton has nodes."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {r["skeleton"]: r for batch in batches(source) for r in batch.to_pylist()}
        for node in sorted(held, reverse=True):
            r = held[node]
            r["n_leaves"] = r["n_leaves"] if r["n_children"] else 1
            r["saved_tokens"] += (r["n_convs"] - 1) * r.pop("words")
            above = held.get(parent[node])
            r["parent_conv_id"] = above and above["conv_id"]
            if above:
                above["n_children"] += 1
                above["n_leaves"] += r["n_leaves"]
                above["saved_tokens"] += r["saved_tokens"]
        names = [part.split()[0] for part in _SUMS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in held.values()], pa.int64()) for c in names], names)

    return run


def _hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's chunks, which come in order."""
    node, digest = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([digest.hexdigest()])], ["skeleton", "digest"])

    for batch in batches(source):
        for of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if of == node:
                digest.update(b",")
            else:
                if digest is not None:
                    yield told()
                node, digest = of, hashlib.sha256()
            digest.update(text.encode())
    if digest is not None:
        yield told()


def prefix_trie(conversations: DataFrame, parts: int | None = None, most: int = SKELETON) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations``: conv_id (unique) and turns, as ``paths`` gives them. ``saved_tokens`` are the words that need not be read again
    when a shared beginning is read once: each node's words for all its conversations but one, over the node's subtree.
    """
    turns = conversations.select(
        "conv_id", F.array_join("turns.mark", "").alias("path"), F.col("turns.words").alias("words")
    )
    turns = written(turns, "turns")
    parts = parts or int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = turns.select(F.substring("path", 1, CUT * MARK).alias("path"), "conv_id")
    skeleton = Skeleton(splitters(keys, F.xxhash64("conv_id"), parts, SAMPLED_PER_RANGE), most)
    rows = (
        turns.mapInArrow(_dealt(skeleton.cuts), "conv_id long, path string, words array<int>, range int")
        .repartitionById(max(len(skeleton.cuts), 1), F.col("range"))
        .sortWithinPartitions("range", "path", "conv_id")
        .mapInArrow(_walked(skeleton.ways), _ROWS)
    )
    rows = written(rows, "trie")
    sums = (
        rows.filter(F.col("kind") == PARTIAL)
        .groupBy("skeleton")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.min("depth").alias("depth"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.max("words").alias("words"),
        )
        .coalesce(1)  # of the skeleton, whose size has a bound
        .mapInArrow(_carried_up(skeleton.parent), _SUMS)
    )
    sums = written(sums, "skeleton")
    digests = (
        rows.filter(F.col("kind") == ENDS)
        .repartition("skeleton")
        .sortWithinPartitions("skeleton", "range", "chunk")
        .select("skeleton", "ends")
        .mapInArrow(_hashed, "skeleton long, digest string")
    )
    shared = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    digest = F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    above = sums.join(F.broadcast(digests), "skeleton", "left").select(*shared, digest)
    parents = F.broadcast(sums.select("skeleton", F.col("conv_id").alias("from_skeleton")))
    finished = rows.filter(F.col("kind") == NODE).join(parents, "skeleton", "left")
    finished = finished.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "from_skeleton"))
    return finished.select(*shared, F.col("ends").alias("ends_sha256")).unionByName(above)
