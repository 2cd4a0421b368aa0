"""Sharding by weighted rendezvous hashing, with DataFrame functions only.

Every row scores each shard by -weight / ln(u), u being a uniform hash of the row's key and the
shard, and goes to the highest score. A shard that is added can only win rows for itself, and
takes its weight's share of them. Places inside a shard (`slot`) run without gaps from 0; they
come from counts by (shard, block) and a window within a block, never from a window over a shard.

Equal rows are counted before any window and dealt out again afterwards, so a repeated row is no
hot key. A null key is a key like any other. Null texts have size 1 and checksum 0. An empty
table gives no rows; other columns are dropped, so they can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.shared import checkpointed

#: Blocks by shard for the numbering; windows run within a block.
BLOCKS = 1024


def place(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, that a key falls into."""
    unit = lambda s: (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    scores = [F.struct((-F.lit(float(w)) / F.ln(unit(s))).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_max(F.array(*scores))["shard"] if len(scores) > 1 else F.lit(0)


def shard(docs: DataFrame, weights: list[float], new_weight: float = 1.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and grown_shard with one more shard of new_weight."""
    key = F.col("doc_id")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    distinct = checkpointed(
        rows.groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("n"))
        .withColumns({"shard": place(key, weights), "grown_shard": place(key, [*weights, new_weight]), "block": F.expr(f"int(pmod(xxhash64(doc_id, size, text_crc32), {BLOCKS}))")})
    )
    # at most shards x BLOCKS rows, so this is safe to broadcast
    offsets = (
        distinct.groupBy("shard", "block")
        .agg(F.sum("n").alias("m"))
        .withColumn("offset", F.coalesce(F.sum("m").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("m")
    )
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return (
        distinct.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(F.broadcast(offsets), ["shard", "block"])
        .withColumn("part", F.explode(F.expr("sequence(0L, n - 1, 1000000L)")))
        .withColumn("i", F.explode(F.expr("sequence(part, least(part + 999999, n - 1))")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("start") + F.col("i")).cast("long").alias("slot"), "grown_shard")
    )
