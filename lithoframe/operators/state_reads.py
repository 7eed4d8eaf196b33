"""Derived reads over the materialized state."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import parent_index

#: Reasons that are always given: observations are samples and never authority to release data.
STANDING_BLOCKERS = (
    "in_flight_writes_not_coordinated",
    "legacy_provenance_not_verified",
    "cluster_gc_watermark_missing",
    "linearizable_release_validation_missing",
    "restore_rollback_not_fenced",
    "physical_gc_disabled",
)
REPAIR_BATCH = EXPIRY_BATCH = 16
IN_SYNC, LAGGING = 1, 50


def agents_list(agents: DataFrame) -> DataFrame:
    return agents.orderBy("registered_at", "agent")


def agents_with_counts(agents: DataFrame, bindings: DataFrame) -> DataFrame:
    """Registered agents with their number of bindings; owners that never registered are not listed."""
    counts = bindings.groupBy("agent").agg(F.count("*").alias("n"))
    return agents.join(counts, "agent", "left").select("agent", "display_name", "registered_at", F.coalesce("n", F.lit(0)).alias("bindings"))


def bindings_of(bindings: DataFrame, agent: Column) -> DataFrame:
    return bindings.where(F.col("agent") == agent)


def with_revisions(bindings: DataFrame, revisions: DataFrame) -> DataFrame:
    return bindings.join(revisions, "key", "left").withColumn("revision", F.coalesce("revision", F.lit(0).cast("bigint")))


def with_lineage(bindings: DataFrame, revisions: DataFrame, edges: DataFrame) -> DataFrame:
    """Bindings with revision and extends, the key they continue."""
    up = parent_index(edges).select(F.col("child_key").alias("key"), F.col("parent_key").alias("extends"))
    return with_revisions(bindings, revisions).join(up, "key", "left")


def bound_blocks(bindings: DataFrame) -> DataFrame:
    """The live set: every block of any binding once."""
    return bindings.select(F.explode("blocks").alias("block_id")).distinct()


def shared_blocks(refs: DataFrame, min_refs: int = 2) -> DataFrame:
    return refs.where(F.col("refs") >= min_refs)


def pin_wanted(bound: DataFrame, refs: DataFrame, min_refs: int = 2) -> DataFrame:
    """Blocks of a bind that enough bindings share."""
    return bound.select(F.explode("blocks").alias("block_id")).distinct().join(shared_blocks(refs, min_refs), "block_id", "left_semi")


def lease_status(leases: DataFrame, clock: Column) -> DataFrame:
    """Leases with status; committed goes before cancelled, that before expired, and a passed deadline needs no marker."""
    due = F.col("expired_at").isNotNull() | F.coalesce(F.col("deadline_tick") <= clock, F.lit(False))
    status = F.when(F.col("committed_key").isNotNull(), "committed").when(F.col("cancelled_at").isNotNull(), "cancelled").when(due, "expired").otherwise("pending")
    return leases.withColumn("status", status)


def lease_counts(leases: DataFrame, clock: Column) -> DataFrame:
    kinds = ("pending", "committed", "cancelled", "expired")
    return lease_status(leases, clock).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == k).alias(k) for k in kinds], F.count("expired_at").alias("expiry_markers")).withColumn("current_tick", clock)


def expiry_work(leases: DataFrame, clock: Column) -> DataFrame:
    """The first leases, by id, whose deadline has passed and that no marker records yet."""
    due = lease_status(leases, clock).where("status = 'expired' and expired_at is null")
    return due.orderBy("lease").limit(EXPIRY_BATCH).select("lease", "generation", "deadline_tick")


def reclamation_evidence(blocks: DataFrame, refs: DataFrame, requirements: DataFrame, fences: DataFrame, leases: DataFrame) -> DataFrame:
    """blocks(block_id) -> references, required replicas, fence (null: unknown) and leases by status that hold the block."""
    kinds = ("pending", "committed", "cancelled", "expired")
    held = leases.select(F.explode(F.array_distinct("blocks")).alias("block_id"), "status").groupBy("block_id").agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds])
    out = blocks.join(refs, "block_id", "left").join(requirements, "block_id", "left").join(fences.withColumnRenamed("log_index", "block_reference_fence"), "block_id", "left").join(held, "block_id", "left")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("bigint").alias(name)
    return out.select("block_id", zero("refs", "binding_references"), zero("replicas", "required_replicas"), "block_reference_fence", *[zero(k, k) for k in kinds])


def reclamation_observation(blocks: DataFrame, refs: DataFrame, requirements: DataFrame, fences: DataFrame, leases: DataFrame, guards: DataFrame, presence: DataFrame) -> DataFrame:
    """reclamation_evidence() with the local guard's generation and what a read of the block found: ok, corrupt, not_found or unknown."""
    out = reclamation_evidence(blocks, refs, requirements, fences, leases)
    found = presence.select("block_id", F.col("status").alias("presence"))
    out = out.join(guards.select("block_id", "local_generation"), "block_id", "left").join(found, "block_id", "left")
    return out.withColumns({"guarded": F.col("local_generation").isNotNull(), "presence": F.coalesce("presence", F.lit("unknown"))})


def reclamation_blockers(observed: DataFrame) -> DataFrame:
    """observed, with want_* columns for the expected fences -> block_id, observed_fences_match, reclaimable, blockers.

    An unknown observation is never read as a harmless one.
    """
    fence = lambda have, want: F.coalesce(F.col(have) == F.col(want), F.lit(False))
    safe = lambda c: F.coalesce(c, F.lit(False))
    fences = (
        (fence("storage_generation", "want_storage_generation"), "storage_generation_mismatch"),
        (fence("local_generation", "want_local_generation"), "local_generation_unknown_or_changed"),
        (fence("block_reference_fence", "want_block_reference_fence"), "reference_fence_unknown_or_changed"),
    )
    others = (
        (safe(F.col("guarded")), "local_guard_missing"),
        (safe(~F.col("write_failed")), "journal_health_unknown_or_failed"),
        (safe(F.col("active_local_writes") == 0), "active_local_writes_present_or_unknown"),
        (safe(~F.col("local_release_check")), "local_release_check_present_or_unknown"),
        (safe(F.col("binding_references") == 0), "binding_references_present_or_unknown"),
        (safe(F.col("pending") == 0), "pending_leases_present_or_unknown"),
        (safe(F.col("required_replicas") == 0), "replica_requirement_present_or_unknown"),
    )
    match = fences[0][0] & fences[1][0] & fences[2][0]
    found = F.array_compact(F.array(*[F.when(~ok, F.lit(reason)) for ok, reason in fences + others], *map(F.lit, STANDING_BLOCKERS)))
    return observed.select("block_id", match.alias("observed_fences_match"), F.lit(False).alias("reclaimable"), found.alias("blockers"))


def repair_candidates(local: DataFrame, required: DataFrame, after: str | None = None, n: int = REPAIR_BATCH) -> DataFrame:
    """local and required (block_id, replicas) -> the next n blocks after the cursor with their larger requirement."""
    later = F.lit(True) if after is None else F.col("block_id") > after
    first = lambda df: df.where(later).orderBy("block_id").limit(n)
    return first(local.where("replicas > 1")).unionByName(first(required)).groupBy("block_id").agg(F.max("replicas").alias("replicas")).orderBy("block_id").limit(n)


def replica_source_rank(known: DataFrame, nodes: list[int]) -> DataFrame:
    """known(block_id, node) and the membership -> block_id, node, rank: nodes known to hold the block first, then by number."""
    pairs = known.groupBy("block_id").agg(F.collect_set("node").alias("holders")).select("block_id", "holders", F.explode(F.array(*[F.lit(n).cast("bigint") for n in sorted(nodes)])).alias("node"))
    order = Window.partitionBy("block_id").orderBy(~F.array_contains("holders", F.col("node")), "node")
    return pairs.select("block_id", "node", F.row_number().over(order).alias("rank"))


def peers_of(members: DataFrame, me: int) -> DataFrame:
    return members.where(F.col("node") != me)


def acknowledged(acks: DataFrame, required: int) -> DataFrame:
    """acks(request_id, block_id, addr, present, cold_verified, retained, storage_generation) -> request_id, copies, satisfied.

    A peer counts once, if all its answers for the request hold and name one valid generation; the local copy counts too.
    """
    good = F.col("present") & F.col("cold_verified") & F.col("retained") & F.col("storage_generation").rlike("^[0-9a-fA-F]{64}$")
    peers = acks.groupBy("request_id", "addr").agg((F.bool_and(F.coalesce(good, F.lit(False))) & (F.countDistinct("storage_generation") == 1)).alias("ok"))
    return peers.groupBy("request_id").agg((F.count_if("ok") + 1).alias("copies")).withColumn("satisfied", F.col("copies") >= required)


def replication_lag(matched: DataFrame, last_index: Column) -> DataFrame:
    """matched(node, matched_index) -> lag and state; a node never heard from is unknown."""
    lag = last_index - F.col("matched_index")
    state = F.when(lag.isNull(), "unknown").when(lag <= IN_SYNC, "in_sync").when(lag <= LAGGING, "lagging").otherwise("behind")
    return matched.select("node", lag.alias("lag"), state.alias("state"))


def stats_payload(parts: dict[str, DataFrame]) -> DataFrame:
    """One-row frames by section name -> one row of structs."""
    out = None
    for name, df in parts.items():
        one = df.select(F.struct(*df.columns).alias(name))
        out = one if out is None else out.join(F.broadcast(one))  # one row each
    return out


def observe_locations(observations: DataFrame, required: DataFrame, per_block: int = 16) -> DataFrame:
    """observations(at, block_id, node, generation), required(block_id) -> block_id, node, generation as known in the end.

    A node's new generation voids what it held before, for all blocks; a null one forgets the node for the block. At
    per_block nodes a new one displaces the lowest that is present. Blocks without a requirement are not recorded.
    The displacement depends on order, so a block's observations are folded in turn, over batches; what the fold keeps
    is per_block nodes.
    """
    known = observations.where("generation is not null")
    order = Window.partitionBy("node").orderBy("at", "block_id")
    turns = known.withColumn("old", F.lag("generation").over(order)).where("old <> generation").select("node", F.col("at").alias("turn"), F.col("generation").alias("new"))
    mine = observations.where(F.col("block_id").isNotNull()).join(required.select("block_id").distinct(), "block_id", "left_semi")
    spans = mine.where("generation is not null").groupBy("block_id", "node").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    voids = spans.join(turns, (spans.node == turns.node) & (turns.turn > spans["first"])).select(F.col("turn").alias("at"), F.lit(0).alias("step"), "block_id", spans.node, F.col("new").alias("generation"))
    steps = voids.unionByName(mine.select("at", F.lit(1).alias("step"), "block_id", "node", "generation")).select("block_id", "at", "step", "node", "generation")

    def run(batches):
        block, held = None, {}

        def rows():
            return [(block, n, g) for n, g in sorted(held.items())]

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["block_id", "node", "generation"])

        for b in batches:
            out = []
            for b_, step, node, generation in zip(*(b.column(c).to_pylist() for c in ("block_id", "step", "node", "generation")), strict=True):
                if b_ != block:
                    out += rows()
                    block, held = b_, {}
                if step == 0:
                    if held.get(node, generation) != generation:
                        del held[node]
                elif generation is None:
                    held.pop(node, None)
                else:
                    if node not in held and len(held) >= per_block:
                        del held[min(held)]
                    held[node] = generation
            yield table(out)
        yield table(rows())

    return steps.repartition("block_id").sortWithinPartitions("block_id", "at", "step", "node").mapInArrow(run, "block_id string, node bigint, generation string")
