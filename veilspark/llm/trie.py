"""The trie of shared beginnings of conversations, found by digests of blocks of turns.

A conversation is a sequence of turns (role, text). Every distinct sequence of its first d turns is a
node of depth d; conversations that begin with it are its members. The method:

1. One pass over the ordered turns cuts each conversation into blocks of ``BLOCK`` turns, the last may be
   shorter. The node of a block is a digest of the digest before it and of its turns, so
   conversations meet in a block if and only if they agree in everything up to its end. The pass
   holds one block at a time, whatever the length of a conversation.
2. Equal blocks are grouped (with partial sums): the variants that follow a parent node, each with the number of its
   members and the smallest one. A group of copies is one variant from here on.
3. Where a parent has one variant, no sibling diverges: all turn boundaries inside the block have the
   members of the variant. Only where a parent has several, digests of the turn prefixes inside the block are grouped.
4. A node is named by (smallest member, depth). Nodes of one smallest member form a chain downwards, so the trie
   is a tree of chains. Sums over subtrees are those of chains, added up by pointer doubling
   (a number of rounds that grows with the logarithm of the depth of branching), then suffix sums along each chain.
5. Digests of the members that end in a node stream through sorted partitions; no list is held.

Turns travel as 16-byte digests and at most 64 code points that order ties; texts are never exchanged.

Defined results: turns are ordered by their number (null first), then role, then the first 64 code points of the
text, then a digest; null role or text is empty; equal rows are turns of their own; rows without a conv_id take no
part; an empty table has no node, not even the root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.llm.shared import Stored, salted_join, store

BLOCK = 4
ROOT = bytes(16)
TIE_CHARS = 64
_NO_ENDS = hashlib.sha256(b"").hexdigest()

_BLOCKS = "conv_id long, k int, parent binary, node binary, prints array<binary>, sizes array<long>, last boolean"
_BLOCKS_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("k", pa.int32()),
        ("parent", pa.binary()),
        ("node", pa.binary()),
        ("prints", pa.list_(pa.binary())),
        ("sizes", pa.list_(pa.int64())),
        ("last", pa.bool_()),
    ]
)


@dataclass(frozen=True)
class Forks:
    """Conversation c begins with the first ``crc32(c) % reach`` turns of conversation ``c - c % family``
    in place of as many of its own (all if that has fewer, none if it is absent)."""

    family: int = 5
    reach: int = 9


def _digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


# ---- blocks of turns ----


def _cut(reach: int, block: int):
    """The task function: ordered turns in, blocks out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        family = conv = None
        head: list[tuple[bytes, int]] = []
        now: list[tuple[bytes, int]] = []
        waiting: tuple | None = None
        k = place = skipped = 0
        node = ROOT

        def push(turn: tuple[bytes, int]) -> None:
            nonlocal k, node, waiting, now
            now.append(turn)
            if len(now) == block:
                close()

        def close() -> None:
            nonlocal k, node, waiting, now
            if waiting is not None:
                out.append((*waiting, False))
            prints = [p for p, _ in now]
            parent, node = node, hashlib.sha256(node + b"".join(prints)).digest()[:16]
            waiting = (conv, k, parent, node, prints, [n for _, n in now])
            k, now = k + 1, []

        def finish() -> None:
            nonlocal waiting
            if conv is None:
                return
            if now:
                close()
            out.append((*(waiting or (conv, 0, None, ROOT, [], [])), True))
            waiting = None

        def table() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(column, f.type) for column, f in zip(zip(*out, strict=True), _BLOCKS_ARROW, strict=True)],
                schema=_BLOCKS_ARROW,
            )
            out.clear()
            return batch

        for batch in batches:
            for fam, c, borrowed, print_, size in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if c != conv:
                    finish()
                    if fam != family:
                        family, head = fam, []
                    conv, k, place, node = c, 0, 0, ROOT
                    skipped = 0 if c == fam else borrowed
                    for turn in head[:skipped]:
                        push(turn)
                if c == fam and len(head) < reach:
                    head.append((print_, size))
                if place >= skipped:
                    push((print_, size))
                place += 1
            if len(out) >= 4096:
                yield table()
        finish()
        if out:
            yield table()

    return run


def conversation_blocks(conversations: DataFrame, forks: Forks | None = None, block: int = BLOCK) -> DataFrame:
    """Blocks of the conversations: conv_id, k (number of the block), parent, node, prints and sizes of its turns,
    last. A conversation without turns has one block without turns."""
    conv = F.col("conv_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    size = F.octet_length(text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        (conv - conv % F.lit(forks.family) if forks else conv).alias("family"),
        conv.alias("conv_id"),
        (F.crc32(conv.cast("string")) % F.lit(forks.reach) if forks else F.lit(0)).cast("int").alias("borrowed"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        F.substring(text, 1, TIE_CHARS).alias("tie"),
        _digest(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role.cast("binary"), text.cast("binary")).alias("print"),
        size.cast("long").alias("size"),
    )
    # the conversation that others borrow from comes first in its family
    ordered = turns.repartition("family").sortWithinPartitions(
        "family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "role", "tie", "print"
    )
    cut = _cut(forks.reach if forks else 0, block)
    return ordered.select("family", "conv_id", "borrowed", "print", "size").mapInArrow(cut, _BLOCKS)


# ---- variants of blocks and the nodes inside them ----


def _variants(blocks: DataFrame) -> DataFrame:
    """Distinct blocks with the number of members and the smallest one."""
    return (
        blocks.where(F.size("prints") > 0)
        .groupBy("k", "parent", "node", "prints", "sizes")
        .agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    )


def _refined(variants: DataFrame, root: DataFrame) -> DataFrame:
    """Variants with the smallest member before them (``up``) and, for each turn boundary inside, the smallest
    member and the number of members (``leasts``, ``counts``)."""
    siblings = variants.groupBy("parent").agg(F.count("*").alias("siblings"))
    borders = variants.select(F.col("node").alias("parent"), F.col("least").alias("up")).unionByName(
        root.select(F.lit(ROOT).alias("parent"), F.col("least").alias("up"))
    )
    known = salted_join(variants, siblings.join(borders, "parent"), "parent")
    kept = store(known, "trie-known")
    known = kept.frame
    alone = known.where("siblings = 1").select(
        "k", "node", "sizes", "least", "up",
        F.transform("prints", lambda _: F.col("least")).alias("leasts"),
        F.transform("prints", lambda _: F.col("n")).alias("counts"),
    )
    # siblings diverge: digests of the turn prefixes within the block
    prefix = F.aggregate(F.slice("prints", 1, F.col("t")), F.col("parent"), lambda a, p: F.concat(a, p))
    inner = known.where("siblings > 1").select("*", F.explode(F.sequence(F.lit(1), F.size("prints"))).alias("t"))
    inner = store(inner.select("k", "node", "sizes", "least", "up", "n", "t", _digest(prefix).alias("prefix")), "trie-inner")
    groups = inner.frame.groupBy("prefix").agg(F.min("least").alias("of_least"), F.sum("n").alias("of_n"))
    found = salted_join(inner.frame, groups, "prefix")
    step = F.struct("t", "of_least", "of_n")
    apart = found.groupBy("k", "node", "sizes", "least", "up").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    apart = apart.select("k", "node", "sizes", "least", "up", F.col("steps.of_least").alias("leasts"), F.col("steps.of_n").alias("counts"))
    return alone.unionByName(apart)


def _nodes(variants: DataFrame, root: DataFrame, block: int) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, size. The variant with the smallest member makes it."""
    steps = F.transform(
        "leasts",
        lambda least, i: F.struct(
            least.alias("conv_id"),
            (F.col("k") * F.lit(block) + i + F.lit(1)).cast("long").alias("depth"),
            F.when(i == 0, F.col("up")).otherwise(F.get("leasts", i - F.lit(1))).alias("parent_conv_id"),
            F.get("counts", i).alias("n_convs"),
            F.get("sizes", i).alias("size"),
        ),
    )
    own = F.filter(steps, lambda s: s["conv_id"] == F.col("least"))
    top = root.select(
        F.col("least").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.lit(0).cast("long").alias("size"),
    )
    return variants.select(F.inline(own)).unionByName(top)


# ---- sums over subtrees ----


def _chain_totals(chains: DataFrame) -> Stored:
    """Chains (conv_id, above, leaves, saved) with the sums over all chains below them, by pointer doubling."""
    now = store(chains, "trie-chains")
    while now.frame.where("above IS NOT NULL").limit(1).count():
        below = now.frame.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        grown = now.frame.join(below, "conv_id", "left").select(
            "conv_id",
            "above",
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        over = now.frame.select(F.col("conv_id").alias("above"), F.col("above").alias("next")).where("next IS NOT NULL")
        jumped = salted_join(grown, over, "above", "left")
        before, now = now, store(jumped.select("conv_id", F.col("next").alias("above"), "leaves", "saved"), "trie-chains")
        before.drop()
    return now


def _member_digests(ends: DataFrame) -> DataFrame:
    """For each node the digest of its members' ids, ascending and comma-joined; streamed, never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        out: list[tuple[bytes, str]] = []

        def table() -> pa.RecordBatch:
            nodes, digests = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])

        for batch in batches:
            for n, conv in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if n != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            if len(out) >= 4096:
                yield table()
        if state is not None:
            out.append((node, state.hexdigest()))
            yield table()

    ordered = ends.repartition("node").sortWithinPartitions("node", "conv_id")
    return ordered.select("node", "conv_id").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, forks: Forks | None = None, block: int = BLOCK) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    blocks = store(conversation_blocks(conversations, forks, block), "trie-blocks").frame
    root = blocks.where("k = 0").agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).where("n > 0")
    variants = store(_variants(blocks), "trie-variants").frame
    refined = store(_refined(variants, root), "trie-refined").frame
    nodes = store(_nodes(refined, root, block), "trie-nodes").frame

    tops = nodes.where("parent_conv_id <> conv_id")
    joints = tops.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("joined"))
    chain = Window.partitionBy("conv_id").orderBy("depth")
    on_chain = F.lead("depth").over(chain).isNotNull().cast("long")
    counted = nodes.join(joints, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("joined", F.lit(0)) + on_chain)
    counted = store(
        counted.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            (F.col("n_children") == 0).cast("long").alias("leaf"),
            ((F.col("n_convs") - 1) * F.col("size")).alias("saves"),
        ),
        "trie-counted",
    ).frame

    above = F.max(F.when(F.col("parent_conv_id") != F.col("conv_id"), F.col("parent_conv_id")))
    chains = counted.groupBy("conv_id").agg(above.alias("above"), F.sum("leaf").alias("leaves"), F.sum("saves").alias("saved"))
    totals = _chain_totals(chains).frame.select("conv_id", "leaves", "saved")
    hung = (
        tops.select("conv_id", "depth", "parent_conv_id")
        .join(totals, "conv_id")
        .groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
        .agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    )
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.join(hung, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.sum(F.col("leaf") + F.coalesce("hung_leaves", F.lit(0))).over(below).alias("n_leaves"),
        F.sum(F.col("saves") + F.coalesce("hung_saved", F.lit(0))).over(below).alias("saved_tokens"),
    )

    where = refined.select("node", F.element_at("leasts", -1).alias("conv_id"), (F.col("k") * F.lit(block) + F.size("leasts")).cast("long").alias("depth"))
    where = where.unionByName(root.select(F.lit(ROOT).alias("node"), F.col("least").alias("conv_id"), F.lit(0).cast("long").alias("depth")))
    ends = _member_digests(blocks.where("last")).join(where, "node").select("conv_id", "depth", "ends_sha256")
    return summed.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
