"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.session import checkpointed


def _smallest(edges: DataFrame) -> DataFrame:
    """Each node's neighbours next to the smallest of them and the node itself.

    The smallest ones are combined inside tasks and written, so both sides of the join are plain shuffles, and the adaptive
    join splits the edges of a node that has very many.
    """
    low = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")))
    return edges.join(low, "u").withColumn("m", F.least("m", "u"))


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every node of ``edges(u, v)``; the component is its smallest node.

    Every round hangs the larger neighbours of a node, then the smaller ones, on the smallest, and
    keeps no more rows than there were edges. Rounds end when the edges stay the same. The edges of
    a round are checkpointed, so the lineage stays short and a lost executor costs a read. Loops and
    repeated edges do no harm.
    """
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _smallest(large)  # here v < u
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        now = checkpointed(small.distinct())
        after = _state(now)
        if after == state:
            break
        state = after
    nodes = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x
