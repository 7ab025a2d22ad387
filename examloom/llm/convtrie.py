"""Prefix trie of conversations by whole-sequence collapse.

Equal conversations are one weighted sequence with a list of its ends. Only one representative of each sequence (its
smallest conversation) goes on, so a conversation that is repeated a million times costs as much as one. Sequences that
are proper prefixes of others are dropped by an anti-join, which leaves the leaves; the prefixes of all sequences are
then summed with their weights into nodes.

A turn is named by a digest of role and text; texts are read once and never shuffled. A prefix is named by its length
and the XOR of one 128-bit hash for each (place, turn), so prefixes come from running XORs, which may be cut into slices:
no task holds a whole conversation. Sums over a subtree need no ancestors: the nodes that a sequence is the first to
reach are the end of its path, so their sums run up that path alone and meet at each node in one aggregate.

Defined cases: null role or text is empty; a null conversation id is no conversation; null turns come first, equal turns
in the order of their digests; repeated rows are turns of their own; a conversation without turns ends at the root; no
conversation gives no node, not even the root.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import slices
from ..session import materialize, scratch
from .mixing import words

#: Turns per slice of a long conversation, and ids per piece of an end list (as powers of two).
SLICE, PIECE = 10, 13
NODE = ["depth", "k1", "k2"]


class Trie(NamedTuple):
    """nodes: depth, k1, k2 (the node's name), p1, p2 (its parent's, null for the root), conv_id, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and end_id, the smallest conversation that ends here (else null).
    ends: end_id and conv_id, for every conversation."""

    nodes: DataFrame
    ends: DataFrame


def turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """c, i (1 to the number of turns), name and w (words) of each turn. Written, since it is read several times."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(conv).cast("long").alias("c"),
        F.col(turn).cast("long").alias("turn"),
        F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)).alias("name"),
        words(t).alias("w"),
    ).where("c is not null")
    rows = rows.withColumn("s", F.coalesce(F.shiftright("turn", SLICE), F.lit(-(1 << 62))))
    rows = materialize(rows, "conv-turns")
    ranked = slices.rank(rows, ["c"], "s", [F.col("turn").asc_nulls_first(), "name"], "i")
    return ranked.select("c", "i", "name", "w")


def rebuilt(own: DataFrame, stride: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations: c; turns: c, i, name, w): each conversation begins with the first h turns of an earlier one.

    Conversation c takes them from c - c % stride, with h = crc32(c) % most, and goes on with its own turns after h.
    """
    base = F.col("c") - F.col("c") % stride
    first = own.where((base == F.col("c")) & (F.col("i") < most)).groupBy("c")
    first = first.agg(F.array_sort(F.collect_list(F.struct("i", "name", "w"))).alias("head"))  # below `most` turns
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % most).cast("int")
    convs = own.select("c").distinct().select("c", base.alias("base"), h.alias("h"))
    convs = convs.join(first.withColumnRenamed("c", "base"), "base", "left")
    convs = convs.select("c", "h", F.slice(F.coalesce("head", F.array()), 1, F.col("h")).alias("head"))
    convs = materialize(convs, "conv-heads")
    head = convs.select("c", F.inline("head")).select("c", F.col("i").cast("long").alias("i"), "name", "w")
    tail = own.join(convs.select("c", "h", F.size("head").alias("n")), "c").where("i > h")
    return convs.select("c"), head.unionByName(tail.select("c", (F.col("i") - F.col("h") + F.col("n")).alias("i"), "name", "w"))


def trie(convs: DataFrame, rows: DataFrame) -> Trie:
    """The nodes and end lists of the conversations `convs` (c) with the turns `rows` (c, i, name, w)."""
    with scratch(convs.sparkSession) as keep:
        nodes, ends = _trie(convs, rows)
        return Trie(keep(nodes, "trie-nodes"), keep(ends, "trie-ends"))


def _trie(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    z = [F.xxhash64("name", "i").alias("z1"), F.xxhash64("i", F.lit("second"), "name").alias("z2")]
    rows = materialize(rows.select("c", "i", "w", *z), "trie-turns")

    # equal conversations are one sequence
    whole = rows.groupBy("c").agg(F.count("*").alias("m"), F.bit_xor("z1").alias("q1"), F.bit_xor("z2").alias("q2"))
    zero = F.lit(0).cast("long")
    whole = convs.join(whole, "c", "left").select("c", *(F.coalesce(x, zero).alias(x) for x in ("m", "q1", "q2")))
    whole = materialize(whole, "trie-whole")
    sequence = ["m", "q1", "q2"]
    seqs = materialize(whole.groupBy(*sequence).agg(F.min("c").alias("rep"), F.count("*").alias("n")), "trie-sequences")
    ends = whole.join(seqs.drop("n"), sequence).select(F.col("rep").alias("end_id"), F.col("c").alias("conv_id"))

    # prefixes of the representatives, with the root
    path = rows.join(seqs.select(F.col("rep").alias("c")), "c").withColumn("s", F.shiftright("i", SLICE))
    path = slices.running_xor(path, ["c"], "s", ["i"], {"k1": F.col("z1"), "k2": F.col("z2")})
    path = path.select(
        F.col("c").alias("rep"), F.col("i").cast("long").alias("depth"), "k1", "k2",
        F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"), "w",
    )
    none = F.lit(None).cast("long")
    root = seqs.select("rep", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("w"))
    path = materialize(path.unionByName(root).join(seqs.select("rep", "m", "n"), "rep"), "trie-paths")

    # leaves: sequences that are no proper prefix of another
    proper = path.where("depth < m").select(F.col("depth").alias("m"), F.col("k1").alias("q1"), F.col("k2").alias("q2"))
    leaves = seqs.join(proper.distinct(), sequence, "left_anti").select("rep", F.lit(1).alias("leaf"))
    nodes = path.join(leaves, "rep", "left").groupBy(*NODE).agg(
        F.min("rep").alias("conv_id"),
        F.sum("n").alias("n_convs"),
        F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"),
        F.max("w").alias("w"),
        F.max("p1").alias("p1"),
        F.max("p2").alias("p2"),
        F.max(F.when(F.col("depth") == F.col("m"), F.col("rep"))).alias("end_id"),
    )
    nodes = materialize(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("w")), "trie-nodes")

    # each node's own sum lies on the path of its first conversation and runs up that path
    first = nodes.select(F.col("conv_id").alias("rep"), "depth", "own")
    up = path.select("rep", *NODE).join(first, ["rep", "depth"], "left").withColumn("own", F.coalesce("own", zero))
    up = up.withColumn("up", -F.col("depth")).withColumn("s", F.shiftright("up", SLICE))
    up = slices.running_sum(up, ["rep"], "s", ["up"], {"below": F.col("own")})
    saved = up.groupBy(*NODE).agg(F.sum("below").alias("saved_tokens"))

    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")
    ).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(saved, NODE).join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = materialize(nodes, "trie-summed")
    # a parent with many children is a skewed join side, which adaptive execution splits
    above = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    nodes = nodes.join(above, ["depth", "p1", "p2"], "left")
    return nodes.select(
        *NODE, "p1", "p2", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_id"
    ), ends


def last_turns(nodes: DataFrame, df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The nodes of a trie over the conversations as they are, with the role and text of their last turn."""
    rows = df.where(F.col(conv).isNotNull()).withColumn("s", F.coalesce(F.shiftright(F.col(turn).cast("long"), SLICE), F.lit(-(1 << 62))))
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = rows.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), "s", r.alias("role"), t.alias("text"),
        F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)).alias("name"),
    )
    rows = materialize(rows, "conv-texts")
    rows = slices.rank(rows, ["conv_id"], "s", [F.col("turn").asc_nulls_first(), "name"], "depth")
    return nodes.join(rows.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left")


def end_digests(ends: DataFrame) -> DataFrame:
    """end_id and ends_sha256: SHA-256 of the decimal conv_ids that end there, ascending and joined by commas.

    Ids meet in pieces of neighbouring ids first, at most 2**13 of them; the digest, which can only be computed from the
    front, then streams over a list's pieces and holds one of them at a time.
    """
    pieces = ends.groupBy("end_id", F.shiftright("conv_id", PIECE).alias("at")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    pieces = pieces.repartition("end_id").sortWithinPartitions("end_id", "at").select("end_id", "ids")

    def digest(it):
        last, sha = None, None
        for batch in it:
            out = []
            for end, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if end != last:
                    if sha:
                        out.append((last, sha.hexdigest()))
                    last, sha = end, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string()))], ["end_id", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["end_id", "ends_sha256"])

    return pieces.mapInArrow(digest, "end_id long, ends_sha256 string")


def report(df: DataFrame, conv: str, turn: str, role: str, text: str, stride: int = 20, most: int = 4) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, with the digest of its end list."""
    with scratch(df.sparkSession) as keep:
        nodes, ends = trie(*rebuilt(turns(df, conv, turn, role, text), stride, most))
        nodes = nodes.join(end_digests(ends), "end_id", "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
        return keep(nodes, "trie-report")
