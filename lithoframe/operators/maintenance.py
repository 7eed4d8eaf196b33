"""Checks of a state snapshot and upload budgets: each check gives the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

MIB = 1 << 20
UPLOAD_UNITS = 512
LEAST_UNITS = 128
BATCH_MIB = 64


def snapshot_violations(state, leases: DataFrame, last_applied: int, clock: int) -> DataFrame:
    """rule, subject of everything in a snapshot that no sequence of entries can lead to."""

    def broken(df: DataFrame, rule: str, subject: str, when: Column | str) -> DataFrame:
        return df.where(when).select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))

    low, high = S.REPLICAS
    owners = leases.join(state.agents.select("agent"), "agent", "left_anti")
    orphans = state.revisions.join(state.bindings.select("key"), "key", "left_anti")
    parts = [
        broken(state.requirements, "replicas_out_of_range", "block_id", ~F.col("replicas").between(low, high)),
        broken(state.fences, "fence_after_last_entry", "block_id", F.col("log_index") > last_applied),
        broken(orphans, "revision_without_binding", "key", F.lit(True)),
        broken(owners, "owner_not_registered", "lease", F.lit(True)),
        broken(leases, "ended_before_it_began", "lease", (F.col("cancelled_at") < F.col("created_at")) | (F.col("expired_at") < F.col("created_at"))),
        broken(leases, "two_ends", "lease", F.col("committed_key").isNotNull() & (F.col("cancelled_at").isNotNull() | F.col("expired_at").isNotNull())),
        broken(leases, "cancelled_and_expired", "lease", F.col("cancelled_at").isNotNull() & F.col("expired_at").isNotNull()),
        broken(leases, "block_count", "lease", ~F.size("blocks").between(1, S.MAX_LEASE_BLOCKS)),
        broken(leases, "time_to_live", "lease", F.col("deadline_tick").isNotNull() & (~F.col("ttl_ticks").between(1, S.MAX_TTL_TICKS) | (F.col("generation") < 1) | (F.col("deadline_tick") - F.col("ttl_ticks") > clock))),
        broken(leases, "marked_before_deadline", "lease", F.col("expired_at").isNotNull() & ~F.coalesce(F.col("deadline_tick") <= clock, F.lit(False))),
        broken(leases.join(state.revisions.withColumnRenamed("key", "committed_key"), "committed_key", "left"), "revision_not_raised", "lease", F.col("committed_key").isNotNull() & ~F.coalesce(F.col("revision") > F.col("committed_revision"), F.lit(False))),
        broken(state.requirements.agg(F.count("*").alias("n")), "requirement_capacity", "n", F.col("n") > S.MAX_REQUIREMENTS),
        broken(leases.agg(F.count("*").alias("n")), "lease_capacity", "n", F.col("n") > S.MAX_LEASES),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upload_units(max_block_bytes: Column) -> Column:
    """Units of 512 that one upload reserves: its block and a batch in MiB, 128 at least; null if over the whole budget."""
    units = F.ceil((max_block_bytes + BATCH_MIB * MIB) / F.lit(MIB)).cast("bigint")
    return F.when(units <= UPLOAD_UNITS, F.greatest(units, F.lit(LEAST_UNITS).cast("bigint")))


def concurrent_uploads(max_block_bytes: Column) -> Column:
    return F.floor(F.lit(UPLOAD_UNITS) / upload_units(max_block_bytes))


def repair_plan(candidates: DataFrame, ranked: DataFrame) -> DataFrame:
    """repair_candidates() and replica_source_rank() -> block_id, node, rank: the nodes that should hold each block."""
    return candidates.join(ranked, "block_id").where(F.col("rank") <= F.col("replicas")).select("block_id", "node", "rank")
