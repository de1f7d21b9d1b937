"""Conversations as prefix tries: succinct level-order tries of shards in numpy, heavy upper levels merged by Spark.

A turn is coded in CODE bytes (the MD5 of role and text, then its words), a conversation is the string of its codes,
and a prefix of d turns is the first d * CODE bytes. Equal conversations are one row with a weight. A prefix that
more than ``shard`` different conversations share is heavy: it becomes a node of the upper levels, and its
conversations are dealt to shards by a longer prefix. A shard's trie is a LOUDS bit vector (for each node in
level order a one for each child, then a zero) and an array of labels; parents follow from its ranks and roll-ups
are made from the last level to the first. Upper nodes add up the tops of the shards below them.

Defined cases: a row without a conv_id belongs to no conversation and is left out; null roles and texts are empty;
equal turns are ordered by the turn's code; repeated rows are turns like others; the remainder of a negative conv_id is
negative, as in SQL; an empty table has no conversation and so no node. A conversation's codes (20 bytes a turn)
are held together, as a text is. Other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, join_hot, lean, settle

CODE = 20
#: Different conversations below a prefix, beyond which the prefix is an upper node.
SHARD = 256
#: Turns whose tries are built at once, about.
TURNS = 200_000
#: Ids in a block of a list of ids.
BLOCK = 10_000
#: Conversations that share the opening of one of them, and how many turns an opening has at most.
FAMILY, OPENING = 20, 3
NOBODY = hashlib.sha256(b"").digest()
NODE = "prefix binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"


def coded(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as a string of codes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 8, "0")
    code = F.concat(F.upper(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))), words)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", code.alias("code"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "code")))
    return turns.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda t: t["code"]), "")).alias("seq"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and seq, with the first h turns of the family's first conversation in place of its own; h = crc32 % 4."""
    own = settle(coded(conversations), "trie-own")
    opening = own.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("family"), F.substring("seq", 1, OPENING * CODE).alias("opening"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (OPENING + 1)
    rows = own.withColumn("family", F.expr(f"conv_id - conv_id % {FAMILY}")).withColumn("h", (h * CODE).cast("int")).join(opening, "family", "left")
    return rows.select("conv_id", F.expr("concat(coalesce(substring(opening, 1, h), X''), substring(seq, h + 1, octet_length(seq)))").alias("seq"))


def ends(rows: DataFrame) -> DataFrame:
    """key, ends: the SHA-256 of the ascending ids of each key, comma-joined.

    Ids are ordered over all partitions and joined in blocks there, so a key with very many is dealt too; what
    goes to one task is the digest's stream of blocks, one of them held at a time.
    """

    def blocks(batches):
        key, ids = None, []
        out = ([], [], [])

        def put():
            if ids:
                for column, value in zip(out, (key, ids[0], ",".join(map(str, ids))), strict=True):
                    column.append(value)
                ids.clear()

        for batch in batches:
            for k, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key or len(ids) >= BLOCK:
                    put()
                key = k
                ids.append(i)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["key", "first", "ids"])
                out = ([], [], [])
        put()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["key", "first", "ids"])

    def digests(batches):
        key, state = None, None
        for batch in batches:
            keys, found = [], []
            for k, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                else:
                    if state:
                        keys.append(key)
                        found.append(state.digest())
                    key, state = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["key", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.digest()], pa.binary())], ["key", "ends"])

    listed = rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(blocks, "key binary, first long, ids string")
    return listed.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends binary")


class Louds:
    """A forest in level order: its first ``roots`` nodes, then the children of each node in turn."""

    def __init__(self, roots: int, parents: np.ndarray, labels: np.ndarray, levels: list[int]):
        degree = np.bincount(parents, minlength=roots + len(parents))
        ones = np.ones(len(parents) + len(degree), np.uint8)
        ones[np.cumsum(degree + 1) - 1] = 0
        self.bits, self.size, self.roots, self.labels, self.levels = np.packbits(ones), len(ones), roots, labels, levels

    def parents(self) -> np.ndarray:
        """Of each node but the roots: the zeros before its one."""
        at = np.flatnonzero(np.unpackbits(self.bits, count=self.size))
        return at - np.arange(len(at))

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(np.unpackbits(self.bits, count=self.size) == 0)
        return np.diff(np.concatenate([[-1], zeros])) - 1


def build(groups: np.ndarray, seqs: list[bytes]) -> tuple[Louds, np.ndarray]:
    """The tries of ``seqs``, one for each number in ``groups``, and the node where each of them ends."""
    lengths = np.array([len(s) // CODE for s in seqs])
    starts = np.cumsum(lengths) - lengths
    labels, codes = np.unique(np.frombuffer(b"".join(seqs), f"S{CODE}"), return_inverse=True)
    roots = int(groups.max()) + 1
    at, active, parents, own, levels, known, depth = groups.astype(np.int64), np.arange(len(seqs)), [], [], [roots], roots, 0
    while len(active := active[lengths[active] > depth]):
        pairs, inverse = np.unique(at[active] * len(labels) + codes[starts[active] + depth], return_inverse=True)
        parents.append(pairs // len(labels))
        own.append(pairs % len(labels))
        at[active] = known + inverse
        known += len(pairs)
        levels.append(known)
        depth += 1
    return Louds(roots, np.concatenate(parents), labels[np.concatenate(own)], levels), at


def rolled_up(trie: Louds, at: np.ndarray, weight: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """What the nodes but the roots hold, from the last level to the first."""
    total, parents = trie.levels[-1], trie.parents()
    parent = np.concatenate([np.full(trie.roots, -1), parents])
    words = np.zeros(total, np.int64)
    words[trie.roots :] = np.frombuffer(trie.labels.tobytes(), np.uint8).reshape(-1, CODE)[:, 16:].astype(np.int64) @ (256 ** np.arange(3, -1, -1))
    n, least, saved = np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max), np.zeros(total, np.int64)
    degree = trie.degrees()
    leaves = (degree == 0).astype(np.int64)
    np.add.at(n, at, weight)
    np.minimum.at(least, at, first)
    for lo, hi in zip(trie.levels[-2::-1], trie.levels[:0:-1], strict=True):
        saved[lo:hi] += (n[lo:hi] - 1) * words[lo:hi]
        for into, add in ((n, np.add), (saved, np.add), (leaves, np.add), (least, np.minimum)):
            add.at(into, parent[lo:hi], into[lo:hi])
    level = np.repeat(np.arange(len(trie.levels)), np.diff([0, *trie.levels]))
    return {"parent": parent, "level": level, "n": n, "least": least, "leaves": leaves, "degree": degree, "saved": saved}


def _shards(batches):
    """Nodes of the shards: rows come by shard, with the depth of its prefix."""
    shards, seqs, more, names = [], [], ([], [], [], []), {}
    turns, last = 0, None

    def flush():
        depth, weight, first, digest = (list(x) for x in more)
        trie, at = build(np.array(shards), seqs)
        r = rolled_up(trie, at, np.array(weight), np.array(first))
        own = slice(trie.roots, None)
        parent, level = r["parent"][own], r["level"][own]
        above = np.where(level > 1, r["least"][parent], 0)
        root = np.arange(trie.levels[-1])  # the shard a node belongs to
        for lo, hi in zip(trie.levels[:-1], trie.levels[1:], strict=True):
            root[lo:hi] = root[r["parent"][lo:hi]]
        deep = np.zeros(trie.roots, np.int64)
        deep[shards] = depth
        closed = [None] * (trie.levels[-1] - trie.roots)
        for node, x in zip(at.tolist(), digest, strict=True):
            closed[node - trie.roots] = x
        top = level == 1
        prefixes = [None] * len(level)
        for node in np.flatnonzero(top).tolist():
            prefixes[node] = names[parent[node]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(prefixes, pa.binary()), pa.array(r["least"][own]), pa.array(deep[root[own]] + level - 1), pa.array(above, mask=top), pa.array(r["n"][own]), pa.array(r["degree"][own], pa.int64()),
                pa.array(r["leaves"][own]), pa.array(r["saved"][own]), pa.array([x or NOBODY for x in closed], pa.binary()),
            ],
            ["prefix", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"],
        )
        for x in (shards, seqs, *more, names):
            x.clear()

    for batch in batches:
        for shard, depth, seq, n, conv, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != last and turns >= TURNS:
                yield from flush()
                turns = 0
            if shard != last or not shards:
                names[len(names)] = seq[: depth * CODE]
                last = shard
            shards.append(len(names) - 1)
            seqs.append(seq[(depth - 1) * CODE :])
            for column, value in zip(more, (depth, n, conv, digest), strict=True):
                column.append(value)
            turns += len(seq) // CODE - depth + 1
    if shards:
        yield from flush()


def _prefix(depth) -> str:
    return f"substring(seq, 1, {depth} * {CODE})"


def nodes(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations."""
    rows = settle(rebuilt(conversations).withColumn("key", F.unhex(F.md5("seq"))), "trie-rebuilt")
    sorts = rows.groupBy("key").agg(F.min("seq").alias("seq"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    sorts = settle(sorts.join(ends(rows), "key").withColumn("turns", F.expr(f"octet_length(seq) div {CODE}")), "trie-sorts")

    # Upper levels: at each depth the prefixes that many different conversations share; the rest goes to shards.
    depth, open_, light, heavy, closing = 1, sorts, [], [], [sorts.where("turns = 0")]
    gone = [rows]
    while True:
        at = open_.where(f"turns >= {depth}").withColumn("prefix", F.expr(_prefix(depth)))
        many = settle(at.groupBy("prefix").agg(F.count("*").alias("sorts")).where(F.col("sorts") > shard).select("prefix"), "trie-heavy")
        n = many.count()
        marked = join_hot(at, many.withColumn("heavy", F.lit(True)), ["prefix"], n, "left")
        light.append(marked.where("heavy is null").select(F.unhex(F.md5("prefix")).alias("shard"), F.lit(depth).alias("depth"), "seq", "n", "conv_id", "ends"))
        if not n:
            break
        heavy.append(many)
        open_ = settle(marked.where("heavy").drop("prefix", "heavy"), "trie-open")
        closing.append(open_.where(f"turns = {depth}"))
        gone.append(open_)
        depth += 1

    def union(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    low = settle(union(light).repartition("shard", "depth").sortWithinPartitions("depth", "shard").mapInArrow(lean(_shards), NODE), "trie-nodes")
    closed = settle(union(closing).select(F.col("seq").alias("prefix"), "n", "conv_id", "ends"), "trie-closed")

    # Every top and every conversation that ends at an upper node counts for the upper nodes above it.
    above = F.expr(f"explode(transform(sequence(0, octet_length(prefix) div {CODE} - lesser), d -> substring(prefix, 1, d * {CODE})))")
    tops = low.where("prefix is not null").select("prefix", F.col("n_convs").alias("n"), "conv_id", "n_leaves", F.col("saved_tokens").alias("saved"), F.lit(1).alias("lesser"))
    there = closed.select("prefix", "n", "conv_id", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"), F.lit(0).alias("lesser"))
    child = F.when((F.col("lesser") == 1) & (F.octet_length("prefix") == F.octet_length("node") + CODE), 1).otherwise(0)
    parts = tops.unionByName(there).withColumn("node", above).select("node", "n", "conv_id", "n_leaves", "saved", child.cast("long").alias("child"))
    zero = F.lit(0).cast("long")
    for many in heavy:
        parts = parts.unionByName(many.select(F.expr(f"substring(prefix, 1, octet_length(prefix) - {CODE})").alias("node"), zero.alias("n"), F.lit(None).cast("long").alias("conv_id"), zero.alias("n_leaves"), zero.alias("saved"), F.lit(1).cast("long").alias("child")))
    upper = parts.groupBy("node").agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.sum("child").alias("n_children"))
    upper = settle(upper, "trie-upper")
    words = F.conv(F.hex(F.expr("substring(node, -4, 4)")), 16, 10).cast("long")
    own = upper.where("octet_length(node) > 0").select("node", ((F.col("n_convs") - 1) * words).alias("own"))
    own = own.withColumn("node", F.expr(f"explode(transform(sequence(0, octet_length(node) div {CODE}), d -> substring(node, 1, d * {CODE})))")).groupBy("node").agg(F.sum("own").alias("own"))
    parent = upper.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    high = upper.join(own, "node", "left").join(closed.select(F.col("prefix").alias("node"), "ends"), "node", "left")
    high = high.withColumn("up", F.expr(f"if(octet_length(node) > 0, substring(node, 1, octet_length(node) - {CODE}), null)")).join(parent, "up", "left")
    high = high.select(
        "conv_id", F.expr(f"cast(octet_length(node) div {CODE} as long)").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"), (F.col("saved") + F.coalesce("own", zero)).alias("saved_tokens"), F.coalesce("ends", F.lit(NOBODY)).alias("ends"),
    )
    known = low.where("prefix is not null").drop("parent_conv_id").withColumn("up", F.expr(f"substring(prefix, 1, octet_length(prefix) - {CODE})"))
    known = join_hot(known, parent, ["up"], upper.count())
    discard(*gone)
    return union([part.select(*high.columns) for part in (high, known, low.where("prefix is null"))])
