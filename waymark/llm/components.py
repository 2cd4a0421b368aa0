"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.shared import BROADCAST_ROWS, checkpointed, join_counted

#: Edges that a task gets at least: rounds over few edges don't write a file for each of many empty partitions.
TASK_EDGES = 50_000


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v): (node, root), root being the least id of the component; roots are left out.

    Every step keeps at most as many edges as there were; rounds grow with the logarithm of a
    component's size. Only aggregates by node and joins are used, and each round is checkpointed. A
    node with very many edges, such as the centre of a star, is joined by broadcast; so is every node while
    there are at most BROADCAST_ROWS edges. Partitions follow the number of edges left.
    """
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen, n = None, edges.count()
    while True:
        few = n // TASK_EDGES + 1
        both = edges.coalesce(few).select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("size")).select("u", F.least("u", "m").alias("m"), "size")
        large = join_counted(both.where("v > u"), least.where("size > 0"), "u", "size", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(few)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few)  # at most n rows
        hung = large.join(F.broadcast(low) if n <= BROADCAST_ROWS else low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(hung.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct().coalesce(few))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, n = now, now[0]
