"""Synthetic load: agents that bind chains round after round, as a mutation log and as payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H


def chain_load(spark: SparkSession, agents: int, rounds: int, depth: int = 3) -> DataFrame:
    """mutations: each agent registers, then in each round binds a chain of its own, every binding holding all blocks so far."""
    first = spark.range(agents).select((F.col("id") + 1).alias("log_index"), F.lit(0).cast("bigint").alias("sub"), F.lit("register").alias("kind"), F.sha2(F.col("id").cast("string"), 256).alias("agent"), F.concat(F.lit("agent-"), F.col("id").cast("string")).alias("display_name"), F.lit(None).cast("int").alias("replicas"))
    n = spark.range(agents * rounds)
    agent = F.col("id") % agents
    tokens = F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda d: F.array(F.col("id"), d.cast("bigint")))
    keyed = n.select((F.col("id") + agents + 1).alias("log_index"), F.sha2(agent.cast("string"), 256).alias("agent"), H.chain_hashes(tokens).alias("keys"))
    each = keyed.select("log_index", "agent", "keys", F.posexplode("keys").alias("sub", "key"))
    binds = each.select("log_index", F.col("sub").cast("bigint").alias("sub"), F.lit("bind").alias("kind"), "agent", "key", F.get("keys", F.col("sub") - 1).alias("parent"), F.transform(F.slice("keys", 1, F.col("sub") + 1), lambda k: F.sha2(k, 256)).alias("blocks"))
    return first.unionByName(binds, allowMissingColumns=True)


def payload_load(spark: SparkSession, n: int, size: int) -> DataFrame:
    """pos, payload: n distinct payloads of so many bytes."""
    return spark.range(n).select(F.col("id").alias("pos"), F.encode(F.rpad(F.concat(F.col("id").cast("string"), F.lit("-")), size, "x"), "UTF-8").alias("payload"))
