"""Prefix trie of conversations: ternary search trees over dictionary-encoded turns, one per range shard, merged at their borders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm.ranks import in_order
from gradeline.session import checkpointed

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_ROOT_KEY = bytes(16)
_CHUNK_CHARS = 1 << 16

NODES = ("border boolean, key binary, up binary, depth long, parent_low long, low long, n long, kids long, leaves long, saved long, "
         "size long, ends string")


def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, sizes: every conversation as the dictionary numbers of its turns, and the UTF-8 bytes of their texts.

    A turn is its (role, text), null counting as empty; equal turns get equal numbers, taken from the sorted distinct SHA-256
    digests, so no text leaves the scan. Turns stand in the order of ``turn`` (null first), equal ones in the order of their
    numbers. Rows without conv_id belong to no conversation. One conversation's numbers (24 bytes a turn) meet in one row; its
    texts do not. Other columns are ignored; an empty table gives an empty one.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    marked = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(marked, 256)).alias("turn_key"),
        F.octet_length(text).cast("long").alias("size"))
    words = in_order(checkpointed(turns.select("turn_key").distinct()), ["turn_key"])
    numbered = turns.join(words, "turn_key").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.col("position").alias("id"), "size"))).alias("t"))
    return numbered.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def with_shared_heads(sequences: DataFrame, period: int = 5, heads: int = 9) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % ``period``, h = crc32(c) % ``heads``.

    Shorter conversations give all they have and absent ones nothing; ``sequences`` is read twice.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = sequences.where(F.col("conv_id") % period == 0).select(
        F.col("conv_id").alias("base"), *[F.slice(c, 1, heads - 1).alias(f"head_{c}") for c in ("ids", "sizes")])
    joined = sequences.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % period).join(first, "base", "left")

    def mixed(c: str) -> Column:
        rest = F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))
        return F.concat(F.slice(F.coalesce(F.col(f"head_{c}"), F.array().cast("array<bigint>")), F.lit(1), F.col("h")), rest).alias(c)

    return joined.select("conv_id", mixed("ids"), mixed("sizes"))


def _joined_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one sequence's conversations, in order, as texts of bounded length."""
    seq, first, parts, length = None, None, [], 0
    out: list[tuple] = []
    for batch in batches:
        for key, conv in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if key != seq or length > _CHUNK_CHARS:
                if seq is not None:
                    out.append((seq, first, ",".join(parts)))
                seq, first, parts, length = key, conv, [], 0
            parts.append(str(conv))
            length += len(parts[-1]) + 1
        if len(out) > 4096:
            yield _records(out, _CHUNKS)
            out = []
    if seq is not None:
        out.append((seq, first, ",".join(parts)))
    yield _records(out, _CHUNKS)


def _hashed_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's conversations from its runs in order; only one digest's state is held."""
    seq, state, out = None, None, []
    for batch in batches:
        for key, text in zip(batch.column("seq").to_pylist(), batch.column("part").to_pylist(), strict=True):
            if key == seq:
                state.update(b"," + text.encode())
                continue
            if seq is not None:
                out.append((seq, state.hexdigest()))
            seq, state = key, hashlib.sha256(text.encode())
        if len(out) > 4096:
            yield _records(out, _ENDS)
            out = []
    if seq is not None:
        out.append((seq, state.hexdigest()))
    yield _records(out, _ENDS)


_CHUNKS = pa.schema([("seq", pa.binary()), ("first", pa.int64()), ("part", pa.string())])
_ENDS = pa.schema([("seq", pa.binary()), ("ends", pa.string())])
_NODES = pa.schema([("border", pa.bool_()), ("key", pa.binary()), ("up", pa.binary()), *[
    (c, pa.int64()) for c in ("depth", "parent_low", "low", "n", "kids", "leaves", "saved", "size")], ("ends", pa.string())])


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class TernaryTree:
    """Sorted distinct sequences of numbers; node 0 is the root, links of 0 lead nowhere."""

    def __init__(self) -> None:
        self.key, self.less, self.equal, self.more = [-1], [0], [0], [0]
        self.parent, self.depth, self.size, self.kids = [-1], [0], [0], [0]
        self.members, self.low, self.ends = [0], [None], [None]

    def _new(self, key: int, size: int, parent: int) -> int:
        for column, value in ((self.key, key), (self.less, 0), (self.equal, 0), (self.more, 0), (self.parent, parent),
                              (self.depth, self.depth[parent] + 1), (self.size, size), (self.kids, 0), (self.members, 0),
                              (self.low, None), (self.ends, None)):
            column.append(value)
        return len(self.key) - 1

    def insert(self, ids: list[int], sizes: list[int]) -> int:
        """The node of the sequence, made where it is not there yet."""
        key, above = self.key, 0
        for turn, size in zip(ids, sizes, strict=True):
            at, links = self.equal[above], self.equal
            holder = above
            while at and key[at] != turn:
                links, holder = (self.less if turn < key[at] else self.more), at
                at = links[holder]
            if not at:
                at = links[holder] = self._new(turn, size, above)
            above = at
        return above

    def visited(self) -> list[int]:
        """All nodes but the root, every one before those below it."""
        order, stack = [], [self.equal[0]]
        while stack:
            at = stack.pop()
            if at:
                order.append(at)
                stack += (self.less[at], self.more[at], self.equal[at])
        return order

    def path(self, at: int) -> list[int]:
        found = []
        while at >= 0:
            found.append(at)
            at = self.parent[at]
        return found[::-1]


def shard_nodes(rows: list[tuple]) -> list[tuple]:
    """Nodes of one shard of sorted distinct (ids, sizes, n, low, ends). Those on the paths of the first and last sequence may go on
    in other shards: their sums leave out what hangs on other border nodes, for the merge to add."""
    tree, ranges, places = TernaryTree(), [(0, len(rows))], [0] * len(rows)
    while ranges:  # medians first, so that siblings hang in balance
        a, b = ranges.pop()
        if a < b:
            mid = (a + b) // 2
            places[mid] = tree.insert(rows[mid][0], rows[mid][1])
            ranges += ((a, mid), (mid + 1, b))
    for at, (_, _, n, low, ends) in zip(places, rows, strict=True):
        tree.members[at], tree.low[at], tree.ends[at] = n, low, ends
    keys: dict[int, bytes] = {}
    for end in (places[0], places[-1]):
        above = _ROOT_KEY
        for at in tree.path(end):
            if at:
                above = hashlib.blake2b(above + tree.key[at].to_bytes(8, "little", signed=True), digest_size=16).digest()
            keys[at] = above
    order = tree.visited()
    leaves, saved = [0] * len(tree.key), [0] * len(tree.key)
    members, low, kids, parent, size = tree.members, tree.low, tree.kids, tree.parent, tree.size
    for at in reversed(order):
        above = parent[at]
        members[above] += members[at]
        if low[above] is None or low[at] < low[above]:
            low[above] = low[at]
        if at not in keys:
            leaves[at] += not kids[at]
            saved[at] += (members[at] - 1) * size[at]
            kids[above] += 1
            leaves[above] += leaves[at]
            saved[above] += saved[at]
    out = []
    for at in [0, *order]:
        above = parent[at]
        inside = above >= 0 and above not in keys
        out.append((at in keys, keys.get(at), None if inside or above < 0 else keys[above], tree.depth[at], low[above] if inside else None,
                    low[at], members[at], kids[at], leaves[at], saved[at], size[at], tree.ends[at]))
    return out


def _shards(turns_per_shard: int):
    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("ids", "sizes", "n", "low", "ends")], strict=True):
                held.append(row)
                turns += len(row[0]) + 1
                if turns >= turns_per_shard:
                    yield _records(shard_nodes(held), _NODES)
                    held, turns = [], 0
        if held:
            yield _records(shard_nodes(held), _NODES)

    return shards


def _subtree_sums(tree: DataFrame) -> DataFrame:
    """``tree`` (key, up, leaves, saved, ...) with ``leaves`` and ``saved`` summed over all nodes below, as many rounds as the depth has bits."""
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    state = tree.select("key", "up", "leaves", "saved")
    for _ in range(int(deepest).bit_length()):
        below = state.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        higher = state.select(F.col("key").alias("up"), F.col("up").alias("next"))
        state = checkpointed(state.join(below, "key", "left").join(higher, "up", "left").select(
            "key", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
    return tree.drop("leaves", "saved").join(state.select("key", "leaves", "saved"), "key")


def prefix_nodes(sequences: DataFrame, turns_per_shard: int = 100_000) -> DataFrame:
    """One row for every distinct prefix of the sequences (conv_id unique, ids, sizes): conv_id (the least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256, the SHA-256 of the members that end there.

    Equal sequences meet in partial counts first. The distinct ones are sorted into ranges, and every run of about
    ``turns_per_shard`` turns builds a ternary search tree of its own, medians first. Only nodes on a shard's first and last path
    can also stand in another shard; these are summed by a chained 128-bit digest of their turns, and what lies below them is added
    up by doubling steps. The members of a sequence are written as runs of numbers in many tasks, and hashed run after run with
    constant memory. The empty sequence is a member of the root alone; no sequences give no rows.
    """
    seq = F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)).alias("seq")
    rows = checkpointed(sequences.select("conv_id", "ids", "sizes", seq))
    runs = rows.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(
        _joined_ids, "seq binary, first long, part string")
    ends = runs.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(_hashed_ids, "seq binary, ends string")
    distinct = rows.groupBy("seq").agg(F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"),
                                       F.min("conv_id").alias("low"))
    sorted_rows = checkpointed(distinct.join(ends, "seq").drop("seq")).repartitionByRange("ids").sortWithinPartitions("ids")
    nodes = checkpointed(sorted_rows.mapInArrow(_shards(turns_per_shard), NODES))
    border = checkpointed(nodes.where("border").groupBy("key").agg(
        F.max("up").alias("up"), F.max("depth").alias("depth"), F.min("low").alias("low"), F.max("size").alias("size"), F.max("ends").alias("ends"),
        *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]))
    below = border.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    kids = F.col("kids") + F.coalesce("more", F.lit(0))
    tree = checkpointed(border.join(below, "key", "left").select(
        "key", "up", "depth", "low", "n", kids.alias("kids"), (F.col("leaves") + (kids == 0).cast("long")).alias("leaves"),
        (F.col("saved") + (F.col("n") - 1) * F.col("size")).alias("saved"), "ends"))
    lows = tree.select(F.col("key").alias("up"), F.col("low").alias("up_low"))
    inner = nodes.where("not border")
    columns = ["depth", "low", "n", "kids", "leaves", "saved", "ends"]
    whole = inner.where("up is null").select(*columns, F.col("parent_low").alias("up_low")).unionByName(
        inner.where("up is not null").join(lows, "up").select(*columns, "up_low")).unionByName(
        _subtree_sums(tree).join(lows, "up", "left").select(*columns, "up_low"))
    return whole.select(
        F.col("low").alias("conv_id"), "depth", F.col("up_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
