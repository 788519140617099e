"""Prefix trie of conversations, built as burst tries on Spark.

A conversation is a row of turn ids (128-bit digests of role and text) and turn sizes; texts are not carried along. Equal
conversations become one row with a count. Such rows wait in *containers*: a container hangs below a trie head and holds
the suffixes of all rows that begin with the head's turns. A container with more than ``BURST`` rows is burst: its head
becomes an inner node, and its rows move to containers keyed by their next turn id. Counts are combined before each
shuffle, so a head that a third of all rows share costs one row per task.

What is left are containers of at most ``BURST`` rows. They are dealt to shards by head, sorted there by suffix and swept once:
a stack holds the nodes of the current suffix, a node is closed when the next suffix leaves it. Totals of burst heads are
sums over the containers below them. The sweep holds one path and the rows of one container.

The digest over the ids that end at a node is sequential by nature: ids are sorted by ranges, packed into pieces of about 4 KB,
and one task hashes the pieces of a node in order as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitspark.plans.scale import attach, join_hot, stored

BURST = 512
PIECE = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, path array<binary>"
)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``turns`` (array of ``id``, ``bytes``), ordered by turn, null first.

    A null role or text is empty; turns of equal number are ordered by role and text. Rows without ``conv_id`` belong to
    no conversation and are left out. A conversation's turn digests (24 bytes a turn) are one row.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # the length keeps role and text apart
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    order = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), order.alias("o"), digest.alias("id"))
    # texts only break ties, so they are replaced by their rank among turns of equal number
    tie = Window.partitionBy("conv_id", "o.given", "o.turn").orderBy("o.role", "o.text")
    light = rows.select(
        "conv_id",
        F.struct("o.given", "o.turn", F.row_number().over(tie).alias("rank"), "id", F.octet_length("o.text").cast("long").alias("bytes")).alias("t"),
    )
    sorted_turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes")))
    return light.groupBy("conv_id").agg(sorted_turns.alias("turns"))


def replayed(turns: DataFrame, group: int = 5, modulus: int = 9) -> DataFrame:
    """Rebuild every conversation: the first h turns of conversation c - c % group, then its own after its first h.

    h is the crc32 of the decimal id modulo ``modulus``; a conversation that is absent gives no turns.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    # at most 2 * group - 1 conversations share a base, so the window is small
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, modulus - 1))).over(Window.partitionBy("base"))
    empty = F.slice("turns", 1, 0)
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("first", empty), F.lit(1), F.col("h"))).otherwise(empty)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return turns.withColumns({"base": base, "h": h}).withColumn("first", first).select("conv_id", F.concat(head, own).alias("turns"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, conv_id) as pieces (key, first, text) of comma-joined ids."""
    key, ids, held = None, [], 0
    done: list[tuple] = []
    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key or held > PIECE:
                if ids:
                    done.append((key, ids[0], ",".join(map(str, ids))))
                key, ids, held = k, [], 0
            ids.append(i)
            held += 12
        yield _pieces(done)
        done = []
    if ids:
        yield _pieces([(key, ids[0], ",".join(map(str, ids)))])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["key", "first", "text"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as one digest per key; the state of one digest is all that is held."""
    key, state = None, None
    for batch in batches:
        keys, digests = [], []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k != key:
                if state is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "sha"])


def id_digests(members: DataFrame) -> DataFrame:
    """SHA-256 over the ascending, comma-joined ids of each ``key``: columns ``key``, ``sha``."""
    ranges = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = members.select("key", "conv_id").repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ranged.mapInArrow(_packed, "key binary, first long, text string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, sha string")


def distinct_conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turns) with equal turns as one: smallest ``conv``, count ``n``, ``sha`` over the ids, ``turns``."""
    key = F.unhex(F.md5(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "").cast("binary")))
    keyed = stored(turns.select("conv_id", key.alias("key"), "turns"))
    counts = stored(keyed.groupBy("key").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n")))
    shared = counts.filter("n > 1").select("key")
    several = stored(id_digests(join_hot(keyed.select("key", "conv_id"), shared, ["key"], "inner")))
    kept = keyed.select(F.col("conv_id").alias("conv"), "turns").join(counts, "conv").join(several, "key", "left")
    return kept.select("conv", "n", F.coalesce("sha", F.sha2(F.col("conv").cast("string").cast("binary"), 256)).alias("sha"), "turns")


def _burst(waiting: DataFrame, limit: int) -> DataFrame:
    """Heads with more than ``limit`` rows, with the totals of their nodes."""
    counts = waiting.groupBy("head").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("n").alias("n_convs"),
        F.min("conv").alias("conv_id"),
        F.max(F.when(F.size("turns") == 0, F.col("sha"))).alias("ends_sha256"),
        F.first("depth").alias("depth"),
        F.first("parent_conv").alias("parent_conv_id"),
        F.first("bytes").alias("bytes"),
        F.first("path").alias("path"),
    )
    return counts.filter(F.col("n_rows") > limit).drop("n_rows")


def _grown(rows: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Burst containers until none is too big: burst heads and remaining rows, both by depth."""
    fresh = dict(
        head=F.lit(b""), depth=F.lit(0).cast("long"), parent_conv=F.lit(None).cast("long"), bytes=F.lit(0).cast("long"),
        path=F.array().cast("array<binary>"),
    )
    waiting = rows.withColumns(fresh)
    heads: list[DataFrame] = []
    rest: list[DataFrame] = []
    while True:
        waiting = stored(waiting)
        burst = stored(_burst(waiting, limit))
        marked = attach(waiting, burst.select("head", F.col("conv_id").alias("burst_conv")), ["head"], "left")
        rest.append(marked.filter("burst_conv is null").drop("burst_conv"))
        if burst.isEmpty():
            return heads, rest
        heads.append(burst)
        below = marked.filter((F.col("burst_conv").isNotNull()) & (F.size("turns") > 0))
        step = F.element_at("turns", 1)
        waiting = below.select(
            "conv", "n", "sha",
            F.slice("turns", F.lit(2), F.size("turns")).alias("turns"),
            F.unhex(F.md5(F.concat("head", step["id"]))).alias("head"),
            (F.col("depth") + 1).alias("depth"),
            F.col("burst_conv").alias("parent_conv"),
            step["bytes"].alias("bytes"),
            F.array_append("path", F.col("head")).alias("path"),
        )


class _Node:
    __slots__ = ("id", "depth", "bytes", "conv", "n", "children", "leaves", "saved", "sha", "closed")

    def __init__(self, turn: bytes | None, depth: int, size: int):
        self.id, self.depth, self.bytes = turn, depth, size
        self.conv, self.n, self.children, self.leaves, self.saved, self.sha = None, 0, 0, 0, 0, None
        self.closed: list[tuple] = []  # children whose row still lacks this node's smallest member

    def row(self, parent: int | None, path: list[bytes] | None) -> tuple:
        return (self.conv, self.depth, parent, self.n, self.children, self.leaves, self.saved, self.sha or EMPTY_SHA, path)


def _close(stack: list[_Node], out: list[tuple]) -> _Node:
    """Take the deepest node off the stack and add it to its parent; rows of its children are complete now."""
    node = stack.pop()
    node.leaves = node.leaves or 1
    node.saved += (node.n - 1) * node.bytes
    out += [(r[0], r[1], node.conv, *r[3:]) for r in node.closed]
    if stack:
        up = stack[-1]
        up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
        up.n += node.n
        up.children += 1
        up.leaves += node.leaves
        up.saved += node.saved
        up.closed.append(node.row(None, None))
    return node


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (head, ids, bytes of turns, ...) of whole containers as nodes; the row of a head keeps its path."""
    head, stack, top = None, [], None
    out: list[tuple] = []

    def finish() -> None:
        while stack:
            node = _close(stack, out)
        out.append(node.row(*top))

    for batch in batches:
        for r in batch.to_pylist():
            if r["head"] != head:
                if stack:
                    finish()
                head, top = r["head"], (r["parent_conv"], r["path"])
                stack = [_Node(None, r["depth"], r["bytes"])]
            ids, sizes = r["ids"], r["sizes"]
            same = 0
            while same < len(ids) and same + 1 < len(stack) and stack[same + 1].id == ids[same]:
                same += 1
            while len(stack) > same + 1:
                _close(stack, out)
            for k in range(same, len(ids)):
                stack.append(_Node(ids[k], r["depth"] + k + 1, sizes[k]))
            end = stack[-1]
            end.conv = r["conv"] if end.conv is None else min(end.conv, r["conv"])
            end.n += r["n"]
            end.sha = r["sha"]
        yield _nodes(out)
        out.clear()
    if stack:
        finish()
        yield _nodes(out)


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "path"]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.list_(pa.binary())]
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _sweep(rest: list[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, rest).select(
        "head", F.col("turns.id").alias("ids"), F.col("turns.bytes").alias("sizes"), "conv", "n", "sha", "depth", "parent_conv", "bytes", "path"
    )
    return rows.repartition("head").sortWithinPartitions("head", "ids").mapInArrow(_swept, NODE)


def _head_nodes(heads: list[DataFrame], nodes: DataFrame) -> DataFrame:
    """Burst heads with their children, leaves and savings, summed over what hangs below them."""
    tops = nodes.filter("path is not null").select("path", "n_leaves", "saved_tokens")
    burst = reduce(DataFrame.unionByName, heads)
    own = (F.col("n_convs") - 1) * F.col("bytes")
    inner = burst.select("path", F.lit(0).cast("long").alias("n_leaves"), own.alias("saved_tokens"))
    below = tops.unionByName(inner).select("n_leaves", "saved_tokens", F.size("path").alias("steps"), F.posexplode("path").alias("at", "head"))
    sums = below.groupBy("head").agg(
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_below"),
        F.count_if(F.col("at") == F.col("steps") - 1).alias("n_children"),
    )
    return burst.join(sums, "head").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("saved_below") + own).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def trie_nodes(turns: DataFrame, burst: int = BURST) -> DataFrame:
    """All nodes of the prefix trie of ``turns`` (``conv_id``, array ``turns`` of ``id`` and ``bytes``).

    Columns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``. Ids must be distinct. An empty table has no nodes, not even a root; a conversation without turns ends at
    the root. ``burst`` only moves work between shards. Bursting takes as many rounds as more than ``burst`` different
    conversations stay together.
    """
    heads, rest = _grown(distinct_conversations(turns), burst)
    nodes = stored(_sweep(rest))
    found = nodes.drop("path")
    return found.unionByName(_head_nodes(heads, nodes)) if heads else found


def conversation_trie(conversations: DataFrame, burst: int = BURST) -> DataFrame:
    """Nodes of the trie over rebuilt conversations, see ``ordered_turns``, ``replayed`` and ``trie_nodes``.

    Reads ``conv_id``, ``turn``, ``role``, ``text``; other columns are ignored. Repeated rows are turns of their own.
    """
    return trie_nodes(replayed(ordered_turns(conversations)), burst)
