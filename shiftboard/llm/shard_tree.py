"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws ``ln(u) / weight`` with u hashed from the key and the child's name; the
largest draw wins, so a child gets keys in proportion to its weight.  A child's draw does not depend on its
siblings: when a weight grows, keys move into that child only, and when it shrinks, out of it only.  One more shard
brings a region of its own (``grown``), so it takes keys from everywhere and none moves between old shards, whatever their number.

Everything is a column expression.  Slots number the rows of a shard without a gap: rows are ordered by a hash
class and id, classes hold about ``CLASS_ROWS`` rows, and only one count per class crosses between them.

Defined results: a null or empty text has size 8; a null id is a key like any other; rows that repeat an id
follow it into one shard and get slots of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

SHARDS_PER_RACK = 4
RACKS_PER_REGION = 2
CLASS_ROWS = 4096


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def tree(shards: int, weights: dict[int, float] | None = None) -> Node:
    """Regions of two racks of four shards, filled in order; shard weights default to 1."""
    regions, racks = [], []
    for first in range(0, shards, SHARDS_PER_RACK):
        own = range(first, min(first + SHARDS_PER_RACK, shards))
        leaves = [Node(f"shard{i}", (weights or {}).get(i, 1.0), shard=i) for i in own]
        racks.append(inner(f"rack{first // SHARDS_PER_RACK}", leaves))
    for first in range(0, len(racks), RACKS_PER_REGION):
        regions.append(inner(f"region{first // RACKS_PER_REGION}", racks[first : first + RACKS_PER_REGION]))
    return inner("root", regions)


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own: no other node's weight changes."""
    regions = list(root.children)
    racks = sum(len(r.children) for r in regions)
    rack = inner(f"rack{racks}", [Node(f"shard{shard}", weight, shard=shard)])
    return inner("root", [*regions, inner(f"region{len(regions)}", [rack])])


def draw(key: Column, node: Node) -> Column:
    """ln(u) / weight with u in (0, 1] from 53 bits of the hash of the key and the node's name."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11)
    return F.log((bits + 1) / F.lit(float(1 << 53))) / F.lit(node.weight)


def descend(key: Column, node: Node) -> Column:
    """The shard of ``key`` below ``node``: one weighted draw among the children of each level."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    best = F.array_max(F.array(*[F.struct(draw(key, c).alias("draw"), F.lit(-i).alias("at")) for i, c in enumerate(node.children)]))
    # the winner is found once, by a one-element transform, and names the branch to go on with
    def branch(won: Column) -> Column:
        out = F.when(won == 0, descend(key, node.children[0]))
        for i, c in enumerate(node.children[1:], 1):
            out = out.when(won == -i, descend(key, c))
        return out

    return F.transform(F.array(best["at"]), branch)[0]


def assign(
    documents: DataFrame, shards: int = 24, *, doc_id: str = "doc_id", text: str = "text", weights: dict[int, float] | None = None
) -> DataFrame:
    """Per document row: id, size, text_crc32, shard, slot, grown_shard (with one more shard)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key, root = F.col(doc_id), tree(shards, weights)
    classes = max(1, documents.count() // (shards * CLASS_ROWS))
    placed = documents.select(
        key.alias("id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        descend(key, root).alias("shard"),
        descend(key, grown(root, shards, (weights or {}).get(shards, 1.0))).alias("grown_shard"),
        # with the text, so that rows that repeat an id, or have none, are no class of their own
        F.pmod(F.xxhash64(key, body), F.lit(classes)).alias("class"),
    )
    counts = placed.groupBy("shard", "class").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "class").orderBy("id", "text_crc32", "size")
    numbered = placed.withColumn("place", F.row_number().over(within)).join(starts, ["shard", "class"])
    slot = (F.col("first") + F.col("place") - 1).cast("long").alias("slot")
    return numbered.select("id", "size", "text_crc32", "shard", slot, "grown_shard")


def write_shards(documents: DataFrame, path: str, shards: int = 24, *, doc_id: str = "doc_id") -> None:
    """The documents as one folder per shard (``shard=N``), each of several files if it is large."""
    placed = documents.withColumn("shard", descend(F.col(doc_id), tree(shards)))
    parts = F.pmod(F.xxhash64(F.col(doc_id), F.lit("slot")), F.lit(max(1, documents.count() // (shards * CLASS_ROWS * 16))))
    placed.repartition("shard", parts).write.partitionBy("shard").parquet(path)
