"""Sharding by a hierarchical weighted hash tree.

Shards hang under racks, racks under regions. A key descends from the root: on
each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the key
and the child's name, and the least draw wins, so a child is taken in proportion
to its weight. Weight that is added later stands beside the old one as an entry
of its own (an *epoch*) on every level of its path. An old entry draws as
before, so a key leaves its place only when a new entry beats all old ones, and
then it descends within what was added in that epoch. Movement is thereby
confined to the subtrees whose weight changed: one more shard takes keys only
into itself, whatever the tree.

Everything is DataFrame functions: the draws are XXH64 over literals, no join
and no shuffle is needed to place a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvlens.llm.catalog import register, table
from pvlens.llm.common import written

# Buckets that number a shard's rows side by side: at 10^10 rows in 40 shards a
# bucket holds about a million.
SLOT_BUCKETS = 256
ROW_OVERHEAD = 16
# Shards of the first tree; a larger count has grown from it one by one.
BASE_SHARDS = 40


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree and the epoch in which its weight was added."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0
    epoch: int = 0


def topology(shards: int, base: int = BASE_SHARDS, regions: int = 4, racks: int = 2) -> list[Shard]:
    """``base`` shards in equal racks; each further shard is an epoch of its
    own, dealt round the regions and racks."""
    per_rack = max(1, base // (regions * racks))
    out = []
    for s in range(shards):
        place = min(s // per_rack, regions * racks - 1) if s < base else s % (regions * racks)
        out.append(Shard(place // racks, place % racks, s, 1.0, max(0, s - base + 1)))
    return out


def _draw(key: Column, name: Column, weight: Column) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, name), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(unit) / weight


def _level(shards: list[Shard], depth: int) -> dict[tuple, dict[tuple, float]]:
    """Weight of each node of a level under its parent; a node is (epoch, region, rack, shard)[:depth + 1]."""
    out: dict[tuple, dict[tuple, float]] = {}
    for s in shards:
        path = (s.epoch, s.region, s.rack, s.shard)
        parent, node = (path[:depth] if depth > 1 else ()), path[:depth + 1]
        out.setdefault(parent, {})[node] = out.get(parent, {}).get(node, 0.0) + s.weight
    return out


def place(key: Column, shards: list[Shard]) -> Column:
    """Shard of ``key``. A null key is a key of its own; all null keys share a shard."""
    number: dict[tuple, int] = {(): 0}
    at = F.lit(0)
    for depth in (1, 2, 3):
        level = _level(shards, depth)
        below = {n: i for i, n in enumerate(n for nodes in level.values() for n in nodes)}
        rows = [F.array(*[F.struct(F.lit("/".join(map(str, node))).alias("name"),
                                   F.lit(weight).alias("weight"),
                                   F.lit(node[3] if depth == 3 else below[node]).alias("node"))
                          for node, weight in level[parent].items()])
                for parent in sorted(level, key=number.__getitem__)]
        drawn = F.transform(F.element_at(F.array(*rows), at + 1), lambda c: F.struct(
            _draw(key, c["name"], c["weight"]).alias("draw"), c["node"].alias("node")))
        at, number = F.array_min(drawn)["node"], below
    return at


def place_documents(docs: DataFrame, shards: int, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Place every row of ``docs`` and number the rows of each shard without gaps.

    Returns ``key, size, text_crc32, shard, slot, grown_shard``; other columns
    of ``docs`` are not read, whatever their names. ``size`` is the text's UTF-8
    bytes and 16 more; a null text counts as no bytes and has the CRC of none.
    Rows that repeat a key get the same shard and slots of their own. An empty
    table gives an empty one. A very long text is a row like any other; it does not
    move. Slots follow no order of the keys."""
    base = min(shards, BASE_SHARDS)
    now, grown = topology(shards, base), topology(shards + 1, base)
    placed = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        place(F.col(key), now).cast("int").alias("shard"),
        place(F.col(key), grown).cast("int").alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"))
    placed = written(placed, "shards").withColumn(
        "bucket", F.pmod(F.col("row"), F.lit(SLOT_BUCKETS)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    # at most (shards x SLOT_BUCKETS) rows
    starts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("row")
    return (placed.withColumn("nth", F.row_number().over(within))
            .join(F.broadcast(starts), ["shard", "bucket"])
            .select(F.col("key").alias(key), "size", "text_crc32", "shard",
                    (F.col("start") + F.col("nth") - 1).alias("slot"), "grown_shard"))


@register("op1_sharding")
def op1_sharding(spark, sf_dir):
    return place_documents(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
