"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A key's draw at a node is an exponential variate -ln(u) / weight, with u hashed from the key and the
node's path and the weight that of all shards below it, so the smallest draw among sisters falls to each
in proportion to its weight. A key descends from the root to the region, the rack and the shard
with the smallest draw; only the children of nodes on its path are drawn.

A changed weight changes the draws of one shard, its rack and its region: keys elsewhere keep their
place, and those that move go to or from that region, inside it that rack, inside that the shard.
A shard that is added as a region of its own (see even_tree) takes keys only into itself.

All on Spark's own functions; rows cross the network once, as five narrow columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import written


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0

    @property
    def path(self) -> tuple[int, int, int]:
        return self.region, self.rack, self.shard


def even_tree(shards: int, base: int = 16, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Shards 0..n-1 of equal weight: the first ``base`` with ``per_rack`` in a rack and ``racks`` racks in a region, each further
    one in a region of its own. So from ``base`` shards on, one more takes keys only into itself.
    """
    full = [Leaf(s // (per_rack * racks), s // per_rack, s) for s in range(min(shards, base))]
    regions, first_rack = (full[-1].region + 1, full[-1].rack + 1) if full else (0, 0)
    return full + [Leaf(regions + s - base, first_rack + s - base, s) for s in range(base, shards)]


def _nearest(key: Column, leaves: list[Leaf], path: tuple[int, ...]) -> Column:
    """The child of the node at ``path`` with the smallest draw."""
    weights: dict[int, float] = {}
    for x in leaves:
        if x.path[: len(path)] == path:
            node = x.path[len(path)]
            weights[node] = weights.get(node, 0.0) + x.weight
    if len(weights) == 1:
        return F.lit(next(iter(weights))).cast("long")
    draws = []
    for node, weight in sorted(weights.items()):
        # 53 bits of the hash as a number in (0, 1)
        bits = F.shiftrightunsigned(F.xxhash64(key, *[F.lit(v).cast("long") for v in (*path, node)]), 11)
        draw = -F.log((bits.cast("double") + 0.5) / float(2**53)) / F.lit(float(weight))
        draws.append(F.struct(draw.alias("draw"), F.lit(node).cast("long").alias("node")))
    return F.array_min(F.array(*draws))["node"]


def with_shard(df: DataFrame, key: str, tree: list[Leaf], name: str) -> DataFrame:
    """df with the shard to which column ``key`` descends. Shards of weight 0 take nothing."""
    live = [x for x in tree if x.weight > 0]
    if not live:
        raise ValueError("the tree has no shard of positive weight")

    def chain(cases: list[tuple[Column, Column]]) -> Column:
        out = F.when(*cases[0])
        for c in cases[1:]:
            out = out.when(*c)
        return out

    k = F.col(key)
    df = df.withColumn("_region", _nearest(k, live, ()))
    df = df.withColumn("_rack", chain([(F.col("_region") == r, _nearest(k, live, (r,))) for r in sorted({x.region for x in live})]))
    racks = sorted({(x.region, x.rack) for x in live})
    shard = chain([((F.col("_region") == r) & (F.col("_rack") == c), _nearest(k, live, (r, c))) for r, c in racks])
    return df.withColumn(name, shard.cast("int")).drop("_region", "_rack")


def assign(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, size, text_crc32, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1, text_crc32 that of its bytes (null: of none). The shard
    depends on id and tree alone; rows with a null id share a key. slot numbers a shard's rows from 0
    without gaps, by id (ties: any order, each row once). grown_shard is the shard under ``grown``, null
    without it. An empty table gives an empty result. Only id_col and text_col are read.
    """
    key, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(key.alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = with_shard(rows, "id", tree, "shard")
    rows = with_shard(rows, "id", grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    # Ranges of (shard, id) are shards in pieces: no shard need fit one task. The low 33 bits of the
    # increasing id are a row's place in its range; the rest follows from the rows in earlier ranges.
    sort = ["shard", "id", "text_crc32", "size"]
    rows = written(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    # one row per range and shard, of which there are at most ranges + shards
    counts = rows.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before, at, last = [], 0, None
    for r in sorted(counts.collect(), key=lambda r: (r["shard"], r["part"])):
        at = 0 if r["shard"] != last else at
        before.append((r["part"], r["shard"], at - r["first"]))
        at, last = at + r["n"], r["shard"]
    offsets = docs.sparkSession.createDataFrame(before, "part long, shard int, shift long")
    out = rows.join(F.broadcast(offsets), ["part", "shard"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard")
