"""The trie of conversations' prefixes, with sums over subtrees by pointer jumping.

A node is a distinct sequence of first turns. Its key is a digest of that sequence: the exclusive or of 128-bit hashes of
(position, turn). Hashes carry their position, so the sequence is settled by the set of them, and digests add up in any
grouping: a long conversation is cut into chunks that different tasks sum. A node's parent is its key less its last turn's
hash. Subtree sums then take as many rounds as the logarithm of the greatest depth: in round r a node gives the sum over
its descendants nearer than 2^r to its ancestor at distance 2^r, and takes that ancestor's own ancestor as its next one.
Only nodes with an ancestor so far up take part in a round, so rounds shrink with the conversations that are long enough.
Texts are hashed where they are read; no shuffle carries them.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, crc32_of, forget, written
from .simhash import numbered

#: Turns of a chunk: one task sums a chunk's hashes in order.
CHUNK = 1 << 12
KEY = ["p1", "p2"]
_IN_RUN = (1 << 33) - 1


def turns_of(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> conv_id, at (from 0, by turn, null first, then by content), content, bytes.

    Rows are numbered through range partitions, so that one very long conversation lies in many tasks.
    """
    empty = F.lit("")
    role, text = (F.coalesce(F.col(c).cast("string"), empty) for c in ("role", "text"))
    content = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.substring(content, 1, 16).alias("content"), F.octet_length(text).cast("long").alias("bytes"))
    rows = numbered(rows.where("conv_id is not null"), [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("content")])
    run = F.shiftright("at", 33)
    # One row for each task of the shuffle.
    runs = rows.groupBy(run.alias("run")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.withColumn("run", run).join(F.broadcast(runs.select("run", before.alias("before"))), "run").select("conv_id", (F.col("before") + F.col("at").bitwiseAND(F.lit(_IN_RUN))).alias("at"), "content", "bytes")


def own_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, start, n; turns: conv_id, k (from 1), content, bytes), both written."""
    turns = written(turns_of(conversations), "turns")
    convs = written(turns.groupBy("conv_id").agg(F.min("at").alias("start"), F.count("*").alias("n")), "conversations")
    placed = written(turns.join(convs.select("conv_id", "start"), "conv_id").select("conv_id", (F.col("at") - F.col("start") + 1).alias("k"), "content", "bytes"), "places")
    forget(turns)
    return convs, placed


def rebuilt(convs: DataFrame, turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first h turns of conversation c - c % every in place of its own first h, h = crc32(c) % most.

    As `own_turns` has them: (conv_id, start, n, h, base, lent), n being the new length; conv_id, k, content, bytes.
    """
    c = convs.withColumns({"h": crc32_of(F.col("conv_id")) % most, "base": F.col("conv_id") - F.col("conv_id") % every})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    lent = F.least(F.col("h"), F.coalesce(F.col("base_n"), F.lit(0)))
    c = c.join(bases, "base", "left").withColumn("lent", lent).select("conv_id", "start", (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"), "h", "base", "lent")
    c = written(c, "rebuilt")
    kept = turns.join(c.select("conv_id", "h", "lent"), "conv_id").where("k > h").select("conv_id", (F.col("lent") + F.col("k") - F.col("h")).alias("k"), "content", "bytes")
    lenders = turns.where(F.col("k") < most).withColumnRenamed("conv_id", "base")
    borrowed = lenders.join(c.where("lent > 0").select("conv_id", "base", "lent"), "base").where("k <= lent").select("conv_id", "k", "content", "bytes")
    return c, kept.unionByName(borrowed)


def prefixes(convs: DataFrame, turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, k, p1, p2 (digest of the first k turns), q1, q2 (of those before), bytes of the k-th text. convs(conv_id, n), turns(conv_id, k, content, bytes)."""
    hashes = [F.xxhash64(F.lit(seed), F.col("k"), F.col("content")).alias(f"e{seed}") for seed in (1, 2)]
    rows = turns.select("conv_id", "k", "bytes", *hashes, F.floor(F.col("k") / chunk).alias("chunk"))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.bit_xor(f"e{s}").over(upto).alias(f"s{s}") for s in (1, 2)])
    # What stands before a chunk: only conversations of more than one have it, a row a chunk.
    long = turns.join(convs.where(F.col("n") >= chunk).select("conv_id"), "conv_id").select("conv_id", *hashes, F.floor(F.col("k") / chunk).alias("chunk"))
    sums = long.groupBy("conv_id", "chunk").agg(*[F.bit_xor(f"e{s}").alias(f"e{s}") for s in (1, 2)])
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conv_id", "chunk", *[F.bit_xor(f"e{s}").over(earlier).alias(f"o{s}") for s in (1, 2)])
    rows = rows.join(offsets, ["conv_id", "chunk"], "left")
    p = {f"p{s}": F.col(f"s{s}").bitwiseXOR(F.coalesce(f"o{s}", F.lit(0).cast("long"))) for s in (1, 2)}
    return rows.withColumns(p).select("conv_id", "k", *KEY, *[F.col(f"p{s}").bitwiseXOR(F.col(f"e{s}")).alias(f"q{s}") for s in (1, 2)], "bytes")


def joined_digest(ends: DataFrame) -> DataFrame:
    """ends(p1, p2, conv_id, chunk), chunk rising with conv_id -> p1, p2, ends_sha256 of the conv_ids in order, joined by commas.

    A chunk's ids are put together where they meet; a SHA-256 has to be fed in order, so the texts of a node's chunks,
    a row each, stream through one task.
    """
    bound_batches(ends.sparkSession)
    texts = ends.groupBy(*KEY, "chunk").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches):
        at, digest = None, None
        for pdf in batches:
            done = []
            for p1, p2, ids in zip(pdf["p1"], pdf["p2"], pdf["ids"], strict=True):
                if (p1, p2) == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = (p1, p2), hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, digest.hexdigest())], columns=[*KEY, "ends_sha256"])

    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").mapInPandas(run, "p1 long, p2 long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, deepest: int) -> DataFrame:
    """nodes(p1, p2, depth, q1, q2, leaves, saved), q being the parent -> p1, p2, leaves, saved summed over the subtree.

    Round r works on nodes at least 2^r deep: an aggregation by their ancestor, and a join of each to that ancestor's own.
    """
    values = ["leaves", "saved"]
    parts = [nodes.select(*KEY, *values)]
    alive = nodes.where("depth > 0").select(*KEY, "depth", F.col("q1").alias("a1"), F.col("q2").alias("a2"), *values)
    step, spent = 1, []
    while step <= deepest:
        given = written(alive.groupBy(F.col("a1").alias("p1"), F.col("a2").alias("p2")).agg(*[F.sum(v).alias(v) for v in values]), "given")
        parts.append(given)
        if 2 * step <= deepest:
            up = alive.select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
            more = given.select(*KEY, *[F.col(v).alias(f"{v}_more") for v in values])
            far = alive.where(F.col("depth") >= 2 * step).join(up, ["a1", "a2"]).join(more, KEY, "left")
            alive = written(far.select(*KEY, "depth", F.col("b1").alias("a1"), F.col("b2").alias("a2"), *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values]), "alive")
            spent.append(alive)
        step *= 2
    out = written(reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(*[F.sum(v).alias(v) for v in values]), "sums")
    forget(*spent, *parts[1:])
    return out


def _no_digest() -> Column:
    return F.lit(hashlib.sha256(b"").hexdigest())


def prefix_trie(convs: DataFrame, turns: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """convs(conv_id, start, n) and turns(conv_id, k, content, bytes) as `own_turns` or `rebuilt` give them -> a row for each node.

    conv_id (smallest member), depth, parent_conv_id (the parent's; null at the root), n_convs (members), n_children,
    n_leaves (nodes without children in the subtree), saved_tokens ((n_convs - 1) times the bytes of the last text, summed
    over the subtree), ends_sha256 (of the conv_ids of members that end here, ascending, joined by commas). The root
    stands for no turns; all conversations are its members. No conversations: no rows. Each node's subtree includes it.
    """
    steps = written(prefixes(convs, turns, chunk), "prefixes")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("p1"), zero.alias("p2"), zero.alias("depth"), *[F.lit(None).cast("long").alias(q) for q in ("q1", "q2")], "conv_id", "n_convs", zero.alias("bytes"))
    inner = steps.groupBy(*KEY, F.col("k").alias("depth")).agg(*[F.min(c).alias(c) for c in ("q1", "q2", "conv_id")], F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
    nodes = written(root.unionByName(inner.select(*root.columns)), "nodes")
    children = written(nodes.where("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children")), "children")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0

    valued = nodes.join(children, KEY, "left").select(*KEY, "depth", "q1", "q2", F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    valued = written(valued, "values")
    sums = subtree_sums(valued, deepest)

    of = convs.select("conv_id", "n", F.shiftright("start", 12).alias("chunk"))
    last = steps.join(of, "conv_id").where("k = n").select(*KEY, "conv_id", "chunk").unionByName(of.where("n = 0").select(zero.alias("p1"), zero.alias("p2"), "conv_id", "chunk"))
    ends = joined_digest(last)
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(sums, KEY).join(children, KEY, "left").join(ends, KEY, "left").join(parents, ["q1", "q2"], "left")
    out = written(full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", _no_digest()).alias("ends_sha256"),
    ), "trie")
    forget(steps, nodes, children, valued, sums)
    return out


def conversation_trie(conversations: DataFrame, *, every: int = 5, most: int = 9, chunk: int = CHUNK) -> DataFrame:
    """The `prefix_trie` of conversations(conv_id, turn, role, text, ...), each rebuilt on a shared start by `rebuilt`.

    Turns go in order of turn, null first; those of one turn in order of a digest of their content; repeated rows are
    turns of their own. Null roles and texts count as empty. Rows without conv_id belong to no conversation and are left
    out. Further columns are ignored, whatever their names; an empty table gives no rows.
    """
    convs, turns = own_turns(conversations)
    made, steps = rebuilt(convs, turns, every, most)
    out = prefix_trie(made, steps, chunk=chunk)
    forget(convs, turns, made)
    return out


__all__ = ["conversation_trie", "own_turns", "prefix_trie", "prefixes", "rebuilt", "subtree_sums", "turns_of"]
