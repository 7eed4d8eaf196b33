"""Longest-prefix lookup over chained keys, and the prefix tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def longest_prefix(chains: DataFrame, bindings: DataFrame) -> DataFrame:
    """chains(lookup_id, depth, key), depths from 0 -> lookup_id, hit_depth: the last key before the first gap; null for a miss.

    A left join and one aggregation: chains are short, so reading past a gap costs less than stopping at it.
    """
    found = chains.join(bindings.select("key", F.lit(True).alias("bound")), "key", "left")
    gap = F.coalesce(F.min(F.when(F.col("bound").isNull(), F.col("depth"))), F.max("depth") + 1)
    return found.groupBy("lookup_id").agg((gap - 1).alias("d")).select("lookup_id", F.when(F.col("d") >= 0, F.col("d")).cast("int").alias("hit_depth"))


def lookup_blocks(chains: DataFrame, bindings: DataFrame) -> DataFrame:
    """lookup_id, hit_depth, key, blocks: the blocks of that one binding, an empty list for a miss."""
    hits = longest_prefix(chains, bindings)
    at = hits.join(chains.withColumnRenamed("depth", "hit_depth"), ["lookup_id", "hit_depth"], "left")
    return at.join(bindings.select("key", "blocks"), "key", "left").select("lookup_id", "hit_depth", "key", F.coalesce("blocks", F.array().cast("array<string>")).alias("blocks"))


def child_blocks(edges: DataFrame, bindings: DataFrame) -> DataFrame:
    """key, edge_no, pos, block_id: blocks of a key's bound children in the order of their edges, repeats kept."""
    order = Window.partitionBy("parent_key").orderBy("first_log_index", "sub", "child_key")
    ranked = edges.select("parent_key", "child_key", (F.row_number().over(order) - 1).alias("edge_no"))
    return ranked.join(bindings.select(F.col("key").alias("child_key"), "blocks"), "child_key").select(F.col("parent_key").alias("key"), "edge_no", F.posexplode("blocks").alias("pos", "block_id"))


def prefetch_set(lookups: DataFrame, edges: DataFrame, bindings: DataFrame) -> DataFrame:
    """lookup_blocks() -> lookup_id, source (0 hit, 1 children), edge_no, pos, block_id: what a lookup warms, in order."""
    hit = lookups.select("lookup_id", F.lit(0).alias("source"), F.lit(0).alias("edge_no"), F.posexplode("blocks").alias("pos", "block_id"))
    ahead = lookups.where(F.col("key").isNotNull()).select("lookup_id", "key").join(child_blocks(edges, bindings), "key")
    return hit.unionByName(ahead.select("lookup_id", F.lit(1).alias("source"), "edge_no", "pos", "block_id"))


def parent_index(edges: DataFrame) -> DataFrame:
    """child_key, parent_key: of several parents the one linked last, which a child list alone leaves open."""
    return edges.groupBy("child_key").agg(F.max(F.struct("last_log_index", "parent_key")).alias("p")).select("child_key", F.col("p.parent_key").alias("parent_key"))


def lineage(edges: DataFrame, leaf_keys: DataFrame) -> DataFrame:
    """leaf, step, key: every key from each of leaf_keys(key) up to its root, by doubling.

    Hops of 1, 2, 4 .. steps are joined once each, so a chain of n keys takes log2(n) rounds, each of them settled. Links
    may form a ring, as parents are given by callers: a walk holds each key once, at its first step, and ends there.
    """
    spark = edges.sparkSession
    settled = lambda df: df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()
    hop = settled(parent_index(edges).select(F.col("child_key").alias("key"), F.col("parent_key").alias("up")))
    walked, size = settled(leaf_keys.select(F.col("key").alias("leaf"), F.lit(0).alias("step"), "key").distinct()), 1
    while True:
        # the walk holds steps 0 .. size - 1 of every leaf; a hop goes size steps up
        further = walked.join(hop, "key").select("leaf", (F.col("step") + size).alias("step"), F.col("up").alias("key"))
        grown = settled(walked.unionByName(further).groupBy("leaf", "key").agg(F.min("step").alias("step")).select("leaf", "step", "key"))
        if grown.count() == walked.count():
            return walked
        hop = settled(hop.join(hop.select(F.col("key").alias("up"), F.col("up").alias("next")), "up").select("key", F.col("next").alias("up")))
        walked, size = grown, 2 * size
