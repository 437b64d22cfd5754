"""Operator 1: hierarchical weighted hash tree for sharding.

A tree has regions, racks and shards, each node weighing as much as its leaves. A row descends from the root: at every
level each child makes a draw -ln(u) / weight, u being a uniform hash of (key, child), and the smallest draw wins. A
child's draw depends on nothing but the key, its name and its weight, so a changed weight moves rows only into or out of
that child at its own level: all movement stays in the subtrees whose weights change. Growth adds a region, the only
node whose weight changes; hence an added shard takes rows only into itself.

Everything is built from Spark expressions: choosing a shard needs no shuffle. Slots number the rows of a shard without
gaps in two steps (rows per part of a shard, then positions within the part), so a shard is never sorted in one task.

Defined results: a null key is hashed as the text "null" (all such rows share a shard); a null text has size 16 and the
CRC of no bytes; repeated rows share a shard and get slots of their own; an empty table gives an empty result; input
columns named like an output column are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

PARTS = 256


@dataclass(frozen=True)
class Node:
    """A region or rack with children, or a shard with its number."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def build_tree(n_shards: int, racks: int = 4, shards: int = 5, weights: dict[int, float] | None = None) -> Node:
    """Shards 0 to n_shards - 1 in racks of `shards`, these in regions of `racks`."""
    weights = weights or {}
    regions: dict[int, dict[int, list[Node]]] = {}
    for s in range(n_shards):
        k = s // shards
        r = k // racks
        regions.setdefault(r, {}).setdefault(k, []).append(Node(f"r{r}/k{k}/s{s}", shard=s, own_weight=weights.get(s, 1.0)))
    return Node("root", tuple(Node(f"r{r}", tuple(Node(f"r{r}/k{k}", tuple(leaves)) for k, leaves in ks.items())) for r, ks in regions.items()))


def grow(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    r = f"x{shard}"
    return Node(tree.name, (*tree.children, Node(r, (Node(f"{r}/k", (Node(f"{r}/k/s{shard}", shard=shard, own_weight=weight),)),))))


def _draw(key: Column, node: Node) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / node.weight


def descend(key: Column, node: Node) -> Column:
    """The shard that `key` reaches from `node`. Only the branch taken is evaluated."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    # smallest draw wins; positive draws compare like their bits, ties go to the first child
    winner = F.least(*(F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)))["i"]
    pick = F.element_at(F.transform(F.array(winner), lambda w: _branch(key, node, w)), 1)
    return pick


def _branch(key: Column, node: Node, winner: Column) -> Column:
    out = F.when(winner == 0, descend(key, node.children[0]))
    for i, c in enumerate(node.children[1:], 1):
        out = out.when(winner == i, descend(key, c))
    return out


def hash_key(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("null"))


def assign(docs: DataFrame, tree: Node, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """Add the shard of every row; no shuffle."""
    return docs.withColumn(out, descend(hash_key(F.col(key)), tree).cast("int"))


def with_slots(df: DataFrame, order: list[str], key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """Add `slot`, gapless from 0 in every shard."""
    part = F.pmod(F.xxhash64(hash_key(F.col(key)), F.lit("slot")), F.lit(PARTS)).cast("int")
    df = df.withColumn("_ax_part", part)
    sizes = df.groupBy(shard, "_ax_part").agg(F.count("*").alias("_ax_n"))
    ahead = W.partitionBy(shard).orderBy("_ax_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col(shard).alias("_ax_shard"), F.col("_ax_part").alias("_ax_p"), F.coalesce(F.sum("_ax_n").over(ahead), F.lit(0)).alias("_ax_offset"))
    within = W.partitionBy(shard, "_ax_part").orderBy(*order)
    rows = df.withColumn("_ax_row", F.row_number().over(within))
    joined = rows.join(offsets, (F.col(shard) == F.col("_ax_shard")) & (F.col("_ax_part") == F.col("_ax_p")))
    return joined.withColumn("slot", (F.col("_ax_offset") + F.col("_ax_row") - 1).cast("long")).drop("_ax_part", "_ax_shard", "_ax_p", "_ax_offset", "_ax_row")


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 39 under law `key`, with the shard that each takes when there are 41."""
    docs = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    tree = build_tree(40)
    rows = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    rows = assign(assign(rows, tree), grow(tree, 40), out="grown_shard")
    out = with_slots(rows, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
