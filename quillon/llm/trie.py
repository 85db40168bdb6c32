"""The prefix trie of conversations: who shares which first turns, and what that saves.

A conversation is an array of turns, a turn a digest of 16 bytes and a length, so that
neither sort nor sweep carries texts. The arrays are range-sorted over all tasks;
then conversations that share a prefix are neighbours, and a node is a run of rows.
Each task sweeps its rows once: the turns that a row has in common with the row
before (their LCP) stay on a stack, deeper nodes are closed, the row's own opened.

Nodes that hold a task's first or last row may go on in another task. They are left
open, known by a digest of their prefix, and stitched by grouping: a few rows a task.
What lies below a stitched node is a range of the order of nodes, so that its sums
are differences of two running totals, within tasks and over the totals of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import stored

DIGEST = 16
EMPTY = hashlib.sha256(b"").hexdigest()
#: Rows of a batch that the sweep hands on.
HANDED = 4096
SWEPT = pa.schema([("pid", pa.int32()), ("seq", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("open", pa.bool_()), ("prefix", pa.binary()), ("above", pa.binary()),
                   ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("size", pa.int64()),
                   ("first", pa.int64()), ("last", pa.int64()), ("ends", pa.string())])
SWEPT_DDL = "pid int, seq long, parent long, depth int, open boolean, prefix binary, above binary, conv_id long, n_convs long, n_children long, n_leaves long, saved long, size long, first long, last long, ends string"


def turn_arrays(turns: DataFrame) -> DataFrame:
    """conv_id, turns (digest, n): the turns of each conversation in order, null
    first, those of one number by digest. Null roles and texts are empty. Rows
    without conv_id belong to no conversation."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.length(text).cast("long").alias("n")).alias("_x"))
    in_order = F.sort_array(F.collect_list("_x"))
    return rows.groupBy("conv_id").agg(F.transform(in_order, lambda x: F.struct(x["digest"].alias("digest"), x["n"].alias("n"))).alias("turns"))


def grafted(arrays: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first h turns are those of the conversation at the last
    multiple of ``every`` (all if fewer, none if there is no such), followed by
    their own from the (h+1)-th on; h = crc32 of the id as text, modulo ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = arrays.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    both = arrays.join(base, F.col("conv_id") - F.col("conv_id") % every == F.col("_base"), "left")
    head = F.coalesce(F.slice("_head", F.lit(1), h), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common, by halving."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[:high * DIGEST] == b[:high * DIGEST]:
        return high
    while low < high:  # common up to low, not beyond high
        mid = (low + high + 1) // 2
        if a[low * DIGEST:mid * DIGEST] == b[low * DIGEST:mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


def _chained(key: bytes) -> list[bytes]:
    """A digest for each prefix of a key, from the empty one on."""
    out = [b"\0" * DIGEST]
    for at in range(0, len(key), DIGEST):
        out.append(hashlib.md5(out[-1] + key[at:at + DIGEST]).digest())
    return out


class _Node:
    __slots__ = ("children", "conv_id", "ends", "first", "leaves", "left", "saved", "seq", "size")

    def __init__(self, seq: int, size: int, first: int, left: bool):
        self.seq, self.size, self.first, self.left = seq, size, first, left
        self.conv_id, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, bytearray()


def sweep(rows: Iterator[tuple[bytes, int, list[int]]], pid: int) -> Iterator[tuple]:
    """Rows of SWEPT for rows (key, conv_id, lengths) in order of key and id. Open
    nodes hold the first or the last row; their counts are of what was closed
    here below them, and ``ends`` lists ids. Others are whole and ``ends`` is a digest."""
    stack: list[_Node] = []
    first = last = None
    at, seq = 0, 0

    def closed(depth: int, chain: list[bytes] | None) -> tuple:
        x = stack.pop()
        up = stack[-1] if stack else None
        if up is not None and (up.conv_id is None or x.conv_id < up.conv_id):
            up.conv_id = x.conv_id
        n, parent = at - x.first, up.seq if up else None
        if chain is not None:
            ends = x.ends.decode() if x.ends else None
            return pid, x.seq, parent, depth, True, chain[depth], chain[depth - 1] if depth else None, x.conv_id, n, x.children, x.leaves, x.saved, x.size, x.first, at, ends
        leaves, saved = x.leaves if x.children else 1, x.saved + (n - 1) * x.size
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
        ends = hashlib.sha256(x.ends).hexdigest()
        return pid, x.seq, parent, depth, False, None, None, x.conv_id, n, x.children, leaves, saved, x.size, x.first, at, ends

    for key, conv_id, sizes in rows:
        if last is None:
            first, shared = _chained(key), 0
            stack.append(_Node(0, 0, 0, True))
            seq = 1
        else:
            shared = _common(last, key)
        while len(stack) > shared + 1:
            yield closed(len(stack) - 1, first if stack[-1].left else None)
        for size in sizes[shared:]:
            stack.append(_Node(seq, size, at, last is None))
            seq += 1
        top = stack[-1]
        if top.ends:
            top.ends += b","
        top.ends += str(conv_id).encode()
        if top.conv_id is None or conv_id < top.conv_id:
            top.conv_id = conv_id
        at, last = at + 1, key
    if last is not None:
        chain = _chained(last)
        while stack:
            yield closed(len(stack) - 1, chain)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("key", "conv_id", "sizes")), strict=True))
    held = []
    for node in sweep(rows, TaskContext.get().partitionId()):
        held.append(node)
        if len(held) == HANDED:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), SWEPT, strict=True)], schema=SWEPT)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), SWEPT, strict=True)], schema=SWEPT)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """prefix, ends_sha256 of lists that are cut into pieces: rows (prefix, ends) in order."""
    schema = pa.schema([("prefix", pa.binary()), ("ends_sha256", pa.string())])
    now, digest = None, None
    for b in batches:
        done = []
        for prefix, ends in zip(b.column("prefix").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if prefix != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = prefix, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([{"prefix": now, "ends_sha256": digest.hexdigest()}], schema=schema)


def _stitched(edges: DataFrame) -> DataFrame:
    """The open nodes, each once and whole: prefix, above, depth, and the counts."""
    total = lambda c: F.sum(c).alias(c)
    whole = edges.groupBy("prefix").agg(F.first("above").alias("above"), F.first("depth").alias("depth"), F.first("size").alias("size"), F.min("conv_id").alias("conv_id"), *[total(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
                                        F.min(F.struct("pid", "first")).alias("from"), F.max(F.struct("pid", "last")).alias("upto"))
    below = whole.filter("above IS NOT NULL").groupBy(F.col("above").alias("prefix")).agg(F.count(F.lit(1)).alias("_open"))
    whole = whole.join(below, "prefix", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_open", F.lit(0)))
    whole = stored(whole.select("prefix", "above", "depth", "conv_id", "n_convs", "n_children", "from", "upto", (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved")))
    # in the order of nodes (place, depth) what lies below a node ends where its rows end
    none = F.lit(0).cast("long")
    events = whole.select("prefix", F.lit(False).alias("end"), F.col("from.pid").alias("pid"), F.col("from.first").alias("at"), "depth", "leaves", "saved")
    events = stored(events.unionByName(whole.select("prefix", F.lit(True).alias("end"), F.col("upto.pid").alias("pid"), F.col("upto.last").alias("at"), F.lit(-1).alias("depth"), none.alias("leaves"), none.alias("saved"))))
    tasks = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    before = events.groupBy("pid").agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s")).select("pid", *[F.coalesce(F.sum(c).over(tasks), none).alias(c) for c in ("_l", "_s")])
    inside = Window.partitionBy("pid").orderBy("at", "depth").rowsBetween(Window.unboundedPreceding, -1)
    run = events.select("prefix", "end", "pid", *[F.coalesce(F.sum(c).over(inside), none).alias(c) for c in ("leaves", "saved")]).join(before, "pid")
    sign = F.when(F.col("end"), 1).otherwise(-1)
    sums = run.groupBy("prefix").agg(F.sum(sign * (F.col("leaves") + F.col("_l"))).alias("n_leaves"), F.sum(sign * (F.col("saved") + F.col("_s"))).alias("saved_tokens"))
    pieces = edges.filter("ends IS NOT NULL").select("prefix", "pid", "ends").repartition("prefix").sortWithinPartitions("prefix", "pid").select("prefix", "ends")
    digests = pieces.mapInArrow(_digested, "prefix binary, ends_sha256 string")
    up = whole.select(F.col("prefix").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return whole.select("prefix", "above", "depth", "conv_id", "n_convs", "n_children").join(sums, "prefix").join(digests, "prefix", "left").join(up, "above", "left")


def nodes(arrays: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of the conversations
    (conv_id, turns), the textless root first of all; see the columns below.

    conv_id is a node's smallest member, parent_conv_id its parent's (root: null),
    n_leaves and saved_tokens are over its subtree, itself included: a node saves the
    characters of its last text for each member but one. ends_sha256 digests the ids
    of the members that end there, ascending and comma-joined. A conversation without
    turns is a member of the root. Equal conversations are one path, however many
    tasks their rows are in. An empty table has no node, not even a root. A digest of a turn has
    128 bits, so different turns count as different. A task holds one conversation's
    digests and the open nodes along one path, whose ids are listed.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), ""))
    rows = arrays.select(key.alias("key"), "conv_id", F.transform("turns", lambda x: x["n"]).alias("sizes"))
    found = stored(rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_swept, SWEPT_DDL))
    edges = found.filter("open")
    whole = stored(_stitched(edges))
    names = found.filter("NOT open").select("pid", F.col("seq").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    names = names.unionByName(edges.select("pid", F.col("seq").alias("parent"), "prefix").join(whole.select("prefix", F.col("conv_id").alias("parent_conv_id")), "prefix").drop("prefix"))
    inner = found.filter("NOT open").join(names, ["pid", "parent"])
    out = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves"]
    return inner.select(*out, F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")).unionByName(whole.select(*out, "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))
