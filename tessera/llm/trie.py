"""Prefix trie of conversations, built family by family and merged by nodes.

A family is the conversations of one base id. Its rows meet in one stream, ordered by
position, in which every conversation is rebuilt (the first turns of the base, then its
own) and a running hash of its turns names the trie node it has come to; a state for
each conversation of the family is all that is held. The nodes of a family, with the
conversations that pass them, are what is shuffled: families are merged by node.

What is summed over subtrees needs no walk of the tree. A node is owned by its smallest
member, and what a member owns is the end of its path. A member other than the smallest
adds to each node it passes the length of the path up to what it owns, less the length
of the path up to the node; these numbers are summed by family and then by node, and so
are the leaves that members own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import BATCH_ROWS, bound_batches, materialize, partitions

#: Conversations of a family: base id and offsets from it below this, on both sides of 0.
FAMILY = 100
#: Longest head that a rebuilt conversation takes from its base.
HEAD = 5
_MASK = (1 << 64) - 1


def head_size(conv_id: int) -> int:
    """How many turns conv_id takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % (HEAD + 1)


def _step(key: tuple[int, int], h1: int, h2: int) -> tuple[int, int]:
    """The node's key after one more turn."""
    a = ((key[0] ^ h1) * 0x9E3779B97F4A7C15 + h2) & _MASK
    b = ((key[1] ^ h2) * 0xC2B2AE3D27D4EB4F + h1) & _MASK
    a ^= a >> 29
    b ^= b >> 31
    return (a * 0xBF58476D1CE4E5B9 + b) & _MASK, (b * 0x94D049BB133111EB ^ a) & _MASK


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


NODE = "base long, k1 long, k2 long, p1 long, p2 long, depth long, prefix long, total long, members array<int>, ends boolean"
_NODE = pa.schema([("base", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("depth", pa.int64()), ("prefix", pa.int64()), ("total", pa.int64()), ("members", pa.list_(pa.int32())), ("ends", pa.bool_())])
_ROOT = (0, 0)


class _Family:
    """The paths of one family so far; rows come by position, so heads are known before what follows them."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.heads: dict[int, list[tuple[int, int, int]]] = {}  # the first turns of each conversation
        self.paths: dict[int, list] = {}  # conversation: key, depth, characters
        self.sizes: dict[int, int] = {}
        self.begun = False
        self.nodes: dict[tuple, list[int]] = {}

    def _go(self, conv: int, turn: tuple[int, int, int]) -> None:
        path = self.paths[conv]
        key, depth, chars = path
        path[:] = _step(key, turn[0], turn[1]), depth + 1, chars + turn[2]
        self.nodes.setdefault((path[0], key, depth + 1, chars, path[2]), []).append(conv - self.base)

    def _begin(self) -> None:
        self.begun = True
        given = self.heads.get(self.base, [])
        for conv, own in self.heads.items():
            self.paths[conv] = [_ROOT, 0, 0]
            self.nodes.setdefault((_ROOT, None, 0, 0, 0), []).append(conv - self.base)
            h = head_size(conv)
            for turn in (*given[:h], *own[h:]):
                self._go(conv, turn)

    def add(self, conv: int, place: int, turn: tuple[int, int, int]) -> None:
        if place <= HEAD:
            self.heads.setdefault(conv, []).append(turn)
            return
        if not self.begun:
            self._begin()
        self._go(conv, turn)

    def flush(self, rows: list[tuple]) -> None:
        """Nodes since the last time; one that comes again is merged like those of other families."""
        for (key, up, depth, prefix, total), members in self.nodes.items():
            rows.append((self.base, *map(_long, key), *(map(_long, up) if up else (None, None)), depth, prefix, total, sorted(members), False))
        self.nodes = {}

    def end(self, rows: list[tuple]) -> None:
        if not self.begun:
            self._begin()
        self.flush(rows)
        ends: dict[tuple, list[int]] = {}
        for conv, (key, depth, chars) in self.paths.items():
            ends.setdefault((key, depth, chars), []).append(conv - self.base)
        for (key, depth, chars), members in ends.items():
            rows.append((self.base, *map(_long, key), None, None, depth, None, chars, sorted(members), True))


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family: _Family | None = None
    for b in batches:
        rows: list[tuple] = []
        bases = b.column("base").to_pylist()
        each = zip(bases, *(b.column(c).to_pylist() for c in ("conv", "place", "h1", "h2", "chars")), strict=True)
        for base, turns in groupby(each, lambda r: r[0]):
            if family is None or family.base != base:
                if family is not None:
                    family.end(rows)
                family = _Family(base)
            for _, conv, place, h1, h2, chars in turns:
                family.add(conv, place, (h1 & _MASK, h2 & _MASK, chars))
        family.flush(rows)
        yield from _batches(rows)
    if family is not None:
        rows = []
        family.end(rows)
        yield from _batches(rows)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _NODE, strict=True)], schema=_NODE)


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of every family's trie: keys of node and parent, depth, characters before and with its last turn, and members, as offsets from the base; and a row with `ends` for those that end in a node."""
    spark = conversations.sparkSession
    parts = partitions(spark)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"), F.char_length(text).cast("long").alias("chars")
    )
    turns = turns.withColumn("base", F.expr(f"conv - conv % {FAMILY}L"))
    bound_batches(spark)
    # One shuffle by base holds both for the places within conversations and for the order by place.
    placed = turns.repartition(parts, "base").withColumn("place", F.row_number().over(Window.partitionBy("base", "conv").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2")))
    return placed.select("base", "conv", "place", "h1", "h2", "chars").sortWithinPartitions("base", "place", "conv").mapInArrow(_families, NODE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, which come by node and base; one digest is open at a time."""
    kinds = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    key, digest = None, hashlib.sha256()
    for b in batches:
        out = []
        for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (k1, k2), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=kinds)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], schema=kinds)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the prefix trie of the rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Turns are ordered by turn, null first; those with the same number by a hash of role
    and text, so the order of rows doesn't matter, and repeated rows are turns of their
    own. Null roles and texts count as empty. A conversation c takes the first h turns of
    c - c % 100 (all if that has fewer, none if it isn't there), h = crc32(c) % 6, and
    goes on with its own from number h + 1; one without any of these ends in the root.
    Rows with a null conv_id belong to no conversation. An empty table has no node. Texts
    count whole, by 128-bit hashes of the paths that lead to a node. Other columns are not
    read.

    A family of at most 199 conversations is one stream of hashes, however long its
    conversations are; the ids that end in one node are hashed in order in one stream.
    """
    spark = conversations.sparkSession
    found = materialize(family_nodes(conversations), "family")
    inner = found.where("NOT ends")
    least = (F.col("base") + F.array_min("members")).alias("least")
    parts = inner.select("base", "k1", "k2", "p1", "p2", "depth", "prefix", "total", F.size("members").cast("long").alias("n"), least)
    nodes = parts.groupBy("k1", "k2").agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("depth").alias("depth"), F.min("prefix").alias("prefix"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"))
    nodes = materialize(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    counted = materialize(nodes.join(children, ["k1", "k2"], "left").fillna(0, ["n_children"]), "counted")

    # What each member owns begins after `shared` characters; it owns a leaf or none.
    owned = counted.groupBy(F.col("conv_id").alias("conv")).agg(F.min("prefix").alias("shared"), F.max(F.expr("IF(n_children = 0, 1L, 0L)")).alias("leaf"))
    ended = found.where("ends")
    paths = ended.select("base", F.explode("members").alias("slot"), "total").withColumn("conv", F.expr("base + slot"))
    values = paths.join(owned, "conv", "left").select("base", F.struct("slot", F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")).alias("v"))
    # At most 199 a base, by what a base is.
    values = values.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("v.slot", F.struct("v.shared", "v.leaf")))).alias("of"))
    over = lambda name: F.aggregate("members", F.lit(0).cast("long"), lambda acc, m: acc + F.col("of")[m][name])
    sums = inner.select("base", "k1", "k2", "members").join(values, "base").select("k1", "k2", over("shared").alias("shared"), over("leaf").alias("leaves"))
    sums = sums.groupBy("k1", "k2").agg(F.sum("shared").alias("shared"), F.sum("leaves").alias("n_leaves"))

    ids = ended.select("k1", "k2", "base", F.array_join(F.transform("members", lambda m: (F.col("base") + m).cast("string")), ",").alias("ids"))
    digests = ids.repartition(partitions(spark), "k1", "k2").sortWithinPartitions("k1", "k2", "base").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")

    # The smallest member owns the node; the others' paths are shared from the node to what they own.
    own = owned.select(F.col("conv").alias("conv_id"), F.col("shared").alias("own_shared"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    all_ = counted.join(sums, ["k1", "k2"]).join(digests, ["k1", "k2"], "left").join(own, "conv_id").join(parents, ["p1", "p2"], "left")
    return all_.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("shared") - F.col("own_shared") - (F.col("n_convs") - 1) * F.col("prefix")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
