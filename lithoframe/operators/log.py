"""Materialized state of an ordered mutation log.

Below the capacities every part of the state is a latest, earliest, greatest or count by key over (log_index, sub),
so each is one aggregation with partial sums before its shuffle. Leases are a fold: see operators.leases.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from . import leases as L


def place():
    """An entry's place in the log, a chain's links in their order."""
    return F.struct("log_index", "sub")


def expanded(mutations: DataFrame) -> DataFrame:
    """Chain entries, whose links array holds (key, blocks, parent), as one bind row a link."""
    links = F.posexplode("links").alias("sub", "link")
    chain = mutations.where("kind = 'bind_chain'").select("log_index", "agent", links).select("log_index", "sub", F.lit("bind").alias("kind"), "agent", "link.key", "link.blocks", "link.parent")
    return mutations.drop("links").where("kind <> 'bind_chain'").unionByName(chain, allowMissingColumns=True)


def agents(mutations: DataFrame) -> DataFrame:
    """agent, display_name, registered_at; registering again moves registered_at."""
    latest = mutations.where("kind = 'register'").groupBy("agent").agg(F.max(F.struct("log_index", "display_name")).alias("r"))
    return latest.select("agent", F.col("r.display_name").alias("display_name"), F.col("r.log_index").alias("registered_at"))


def bindings(mutations: DataFrame) -> DataFrame:
    """key, agent, blocks, log_index: the last bind of a key, its owner included."""
    last = mutations.where("kind = 'bind'").groupBy("key").agg(F.max_by(F.struct("agent", "blocks", "log_index"), place()).alias("b"))
    return last.select("key", "b.agent", "b.blocks", "b.log_index")


def edges(mutations: DataFrame) -> DataFrame:
    """parent_key, child_key, first_log_index, sub, last_log_index; edges are never removed."""
    linked = mutations.where("kind = 'bind' and parent is not null")
    first = linked.groupBy(F.col("parent").alias("parent_key"), F.col("key").alias("child_key")).agg(F.min(place()).alias("f"), F.max("log_index").alias("last_log_index"))
    return first.select("parent_key", "child_key", F.col("f.log_index").alias("first_log_index"), "f.sub", "last_log_index")


def block_refs(bound: DataFrame) -> DataFrame:
    """block_id, refs: occurrences in current bindings, repeats inside one binding included."""
    return bound.select(F.explode("blocks").alias("block_id")).groupBy("block_id").agg(F.count("*").alias("refs"))


def requirement_valid():
    return F.col("replicas").between(*S.REPLICAS) & (F.size("blocks") <= S.MAX_REQUIREMENT_BATCH)


def replica_requirements(mutations: DataFrame) -> DataFrame:
    """block_id, replicas: the largest valid requirement of a block."""
    rows = mutations.where("kind = 'require'").where(requirement_valid())
    return rows.select(F.explode("blocks").alias("block_id"), "replicas").groupBy("block_id").agg(F.max("replicas").alias("replicas"))


def revisions(mutations: DataFrame, activated_at: int | None) -> DataFrame:
    """key, revision: binds after lease activation; none before it."""
    since = F.lit(None).cast("bigint") if activated_at is None else F.lit(activated_at)
    return mutations.where("kind = 'bind'").where(F.col("log_index") > since).groupBy("key").agg(F.count("*").alias("revision"))


def block_fences(mutations: DataFrame) -> DataFrame:
    """block_id, log_index: the last accepted request that touched a block, as bound, replaced or required."""
    before = Window.partitionBy("key").orderBy("log_index", "sub").rowsBetween(Window.unboundedPreceding, -1)
    old = F.last(F.when(F.col("kind") == "bind", F.col("blocks")), ignorenulls=True).over(before)
    both = F.concat("blocks", F.coalesce(old, F.array().cast("array<string>")))
    keyed = mutations.where("kind = 'bind' or kind = 'touch' and key is not null").select("log_index", both.alias("blocks"))
    touched = mutations.where("kind = 'touch' and key is null").select("log_index", "blocks")
    bound = keyed.unionByName(touched).select("log_index", F.explode("blocks").alias("block_id"))
    required = mutations.where("kind = 'require'").where(requirement_valid()).select("log_index", F.explode("blocks").alias("block_id"))
    return bound.unionByName(required).groupBy("block_id").agg(F.max("log_index").alias("log_index"))


def responses(mutations: DataFrame) -> DataFrame:
    """A result row for each entry that needs no fold: a rejected one never fails a batch."""
    bad = (F.col("kind") == "require") & ~F.coalesce(requirement_valid(), F.lit(False))
    return mutations.select("log_index", F.when(bad, "rejected").otherwise("ok").alias("status"), F.when(bad, "invalid replica requirements").alias("reason")).distinct()


@dataclass
class State:
    agents: DataFrame
    bindings: DataFrame
    edges: DataFrame
    refs: DataFrame
    requirements: DataFrame
    revisions: DataFrame
    fences: DataFrame


def with_leases(mutations: DataFrame) -> tuple[DataFrame, int | None]:
    """The log with the effects of its accepted lease entries, and the index that activates leases; a log of one cluster."""
    if "lease" not in mutations.columns or not mutations.where(F.col("kind").isin("begin", "commit", "renew")).limit(1).count():
        return mutations, None
    found = L.effects(mutations.withColumn("cluster", F.lit("")))
    first = found.where("kind = 'activate'").agg(F.min("log_index").alias("at")).first()
    return mutations.unionByName(found.where("kind <> 'activate'"), allowMissingColumns=True), first.at


def capacity_rejections(mutations: DataFrame, most_required: int = S.MAX_REQUIREMENTS, most_fenced: int = S.MAX_BLOCK_FENCES) -> DataFrame:
    """log_index, reason of the requests that would take the fenced or required blocks over their limits, in log order.

    A request counts as a whole, a chain with all its links. The blocks that a bind replaces are fenced already, so only
    its own can be new. One task folds the log in order, over batches, and holds as many ids as the limits allow.
    Effects of lease entries (see with_leases) count as binds and touches; the lease fold has judged them before.
    """
    kinds = ("bind", "touch", "require")
    rows = mutations.where(F.col("kind").isin(*kinds)).select("log_index", "sub", "kind", "blocks", "replicas")

    def run(batches):
        fenced, required = set(), set()
        last, mine, kind, replicas = None, [], None, None

        def judged():
            new = {x for x in mine if x not in fenced}
            if len(fenced) + len(new) > most_fenced:
                return "block fence capacity exhausted"
            if kind == "require":
                if not (replicas is not None and S.REPLICAS[0] <= replicas <= S.REPLICAS[1] and len(mine) <= S.MAX_REQUIREMENT_BATCH):
                    return None  # rejected, as responses() says
                if len(required) + len({x for x in mine if x not in required}) > most_required:
                    return "replica requirement capacity exhausted"
                required.update(mine)
            fenced.update(new)
            return None

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["log_index", "reason"])

        for b in batches:
            out = []
            for at, kind_, blocks, n in zip(*(b.column(c).to_pylist() for c in ("log_index", "kind", "blocks", "replicas")), strict=True):
                if at != last:
                    if last is not None and (why := judged()):
                        out.append((last, why))
                    last, mine, kind, replicas = at, [], kind_, n
                mine += blocks or []
            yield table(out)
        if last is not None and (why := judged()):
            yield table([(last, why)])

    return rows.repartition(1).sortWithinPartitions("log_index", "sub").mapInArrow(run, "log_index bigint, reason string")


def materialize(mutations: DataFrame, activated_at: int | None = None, capped: bool = False) -> State:
    """activated_at: the log index of the first valid lease, from which revisions count; the log's own if it has leases.

    capped: count the limited parts, and where one is over its limit leave out the requests that log order rejects.
    """
    mutations, own = with_leases(mutations)
    activated_at = own if activated_at is None else activated_at

    def made(rows: DataFrame) -> State:
        bound = bindings(rows)
        return State(agents(rows), bound, edges(rows), block_refs(bound), replica_requirements(rows), revisions(rows, activated_at), block_fences(rows))

    state = made(mutations)
    few = min(S.MAX_REQUIREMENTS, S.MAX_BLOCK_FENCES)  # a log that names no more blocks than this is under every limit
    named = mutations.where(F.col("kind").isin("bind", "touch", "require")).select(F.explode("blocks").alias("block_id")).distinct()
    if capped and named.limit(few + 1).count() > few and over_capacity(state).limit(1).count():
        state = made(mutations.join(capacity_rejections(mutations).select("log_index"), "log_index", "left_anti"))
    return state


def over_capacity(state: State) -> DataFrame:
    """part, n, most for each part over its limit; then log order decides, see capacity_rejections()."""
    sizes = [(state.requirements, "requirements", S.MAX_REQUIREMENTS), (state.fences, "fences", S.MAX_BLOCK_FENCES)]
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n", F.lit(most).cast("bigint").alias("most")) for df, name, most in sizes]
    return rows[0].unionByName(rows[1]).where("n > most")
