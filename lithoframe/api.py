"""The engine as an object: one set of tables, with the verbs that clients use.

Tables are Parquet folders under a root that the cluster shares. Writes append; a single writer is assumed, and
reads take one row per block id, so a raced append stays harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .functions import hashing as H
from .operators import blocks as B
from .operators import history as Y
from .operators import leases as L
from .operators import log as G
from .operators import maintenance as X
from .operators import prefix as P
from .operators import state_reads as R

STATE = ("agents", "bindings", "edges", "refs", "requirements", "revisions", "fences")


class Engine:
    def __init__(self, spark: SparkSession, root: str, cluster: str = "main"):
        self.spark, self.root, self.cluster = spark, root.rstrip("/"), cluster

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    # Blocks

    def blocks(self) -> DataFrame:
        return self._read("blocks", S.BLOCKS)

    def put_many(self, payloads: DataFrame) -> DataFrame:
        """payloads(pos, payload): append new blocks; pos, block_id of all."""
        ids, fresh = B.put_many(payloads, self.blocks())
        fresh.drop("pos").write.mode("append").parquet(f"{self.root}/blocks")
        return ids

    def get(self, wanted: DataFrame) -> DataFrame:
        return B.get_verified(wanted, self.blocks().dropDuplicates(["block_id"]))

    def contains(self, wanted: DataFrame) -> DataFrame:
        return B.contains(wanted, self.blocks())

    def fsck(self) -> DataFrame:
        return B.verify_all(self.blocks())

    def compact(self, live: DataFrame, index: DataFrame) -> DataFrame:
        """What compaction would drop; an explicit live set is required."""
        return B.compact_stats(index, live)

    # Log

    def log(self) -> DataFrame:
        return self._read("log", S.MUTATIONS)

    def append(self, mutations: DataFrame) -> None:
        """Append entries, of which absent columns are null; answers() says what became of each.

        Chain entries hold links, an array of (key, blocks, parent), and are stored as a bind row a link.
        """
        if "links" in mutations.columns:
            mutations = G.expanded(mutations.withColumns({c: F.lit(None) for c in ("key", "blocks", "parent") if c not in mutations.columns}).withColumn("sub", F.lit(0).cast("bigint")))
        names = [c.strip().split()[0] for c in S.MUTATIONS.replace("array<string>", "list").split(",")]
        kinds = dict(self.spark.createDataFrame([], S.MUTATIONS).dtypes)
        full = mutations.select(*[(F.col(n) if n in mutations.columns else F.lit(0 if n == "sub" else None)).cast(kinds[n]).alias(n) for n in names])
        full.write.mode("append").parquet(f"{self.root}/log")

    def bind(self, mutations: DataFrame) -> DataFrame:
        """Append bind, chain and commit entries whose blocks are all stored; log_index, first_missing of the others, which are not appended."""
        links = F.col("links") if "links" in mutations.columns else F.lit(None).cast("array<struct<blocks:array<string>>>")
        own = F.col("blocks") if "blocks" in mutations.columns else F.lit(None).cast("array<string>")
        named = F.coalesce(F.concat(F.coalesce(own, F.array().cast("array<string>")), F.flatten(F.coalesce(F.transform(links, lambda x: x["blocks"]), F.array().cast("array<array<string>>")))))
        checked = B.bind_check(mutations.select(F.col("log_index").alias("bind_id"), named.alias("blocks")), self.blocks())
        bad = checked.where("not accepted").select(F.col("bind_id").alias("log_index"), "first_missing")
        bad = self.spark.createDataFrame(bad.toArrow(), "log_index bigint, first_missing string")  # entries of one call
        self.append(mutations.join(bad, "log_index", "left_anti"))
        return bad

    def _clustered(self) -> DataFrame:
        return self.log().withColumn("cluster", F.lit(self.cluster))

    def answers(self) -> DataFrame:
        """A row an entry; those on leases come from the fold."""
        mine = self.log()
        return G.responses(mine.where(~F.col("kind").isin(*L.MOVES))).unionByName(L.fold(self._clustered()).select("log_index", "status", "reason"))

    def state(self, activated_at: int | None = None) -> G.State:
        return G.materialize(self.log(), activated_at, capped=True)

    def leases(self) -> DataFrame:
        return L.leases(self._clustered()).drop("cluster")

    # Reads

    def lookup(self, chains: DataFrame) -> DataFrame:
        return P.lookup_blocks(chains, self.state().bindings)

    def prefetch(self, chains: DataFrame) -> DataFrame:
        s = self.state()
        return P.prefetch_set(P.lookup_blocks(chains, s.bindings), s.edges, s.bindings)

    def keys(self, requests: DataFrame, chunk: int = H.CHUNK_TOKENS) -> DataFrame:
        """requests(lookup_id, tokens) -> lookup_id, depth, key."""
        keys = requests.select("lookup_id", H.chain_hashes(H.chunk_tokens(F.col("tokens"), chunk)).alias("keys"))
        return keys.select("lookup_id", F.posexplode("keys").alias("depth", "key"))

    def matched_tokens(self, requests: DataFrame, chunk: int = H.CHUNK_TOKENS) -> DataFrame:
        """requests(lookup_id, tokens, computed) -> lookup_id, hit_depth, matched."""
        return Y.matched_tokens(requests.select("lookup_id", "computed"), self.keys(requests, chunk), self.state().bindings, chunk)

    def agents(self) -> DataFrame:
        s = self.state()
        return R.agents_list(R.agents_with_counts(s.agents, s.bindings))

    def bindings(self, agent: str, activated_at: int | None = None) -> DataFrame:
        s = self.state(activated_at)
        return R.bindings_of(R.with_lineage(s.bindings, s.revisions, s.edges), F.lit(agent))

    def stats(self) -> DataFrame:
        s = self.state()
        count = lambda df, name: df.agg(F.count("*").alias(name))
        return R.stats_payload({"data_plane": count(self.blocks().select("block_id").distinct(), "blocks"), "agents": count(s.agents, "agents"), "bindings": count(s.bindings, "bindings")})

    def reclamation(self, wanted: DataFrame) -> DataFrame:
        s = self.state()
        return R.reclamation_evidence(wanted, s.refs, s.requirements, s.fences, self.leases())

    def pins(self, agent: str, min_refs: int = 2) -> DataFrame:
        """Blocks of an agent's bindings that enough bindings share."""
        s = self.state()
        return R.pin_wanted(R.bindings_of(s.bindings, F.lit(agent)), s.refs, min_refs)

    def history(self, turns: DataFrame, cleared: int = 0) -> DataFrame:
        """turns(session, index, role, content) -> the chain of each session: keys, parents, blocks."""
        return Y.history_chain(turns, cleared)

    def expiry_work(self) -> DataFrame:
        return R.expiry_work(self.leases(), F.lit(self.clock()))

    def clock(self) -> int:
        last = L.leases(self._clustered()).agg(F.max("clock").alias("c")).first()
        return last.c or 0

    def snapshot(self, path: str) -> None:
        """Write every state table, parts before what refers to them, the leases and, last, the clock and the last entry."""
        s = self.state()
        for name in STATE:
            getattr(s, name).write.mode("overwrite").parquet(f"{path}/{name}")
        self.leases().write.mode("overwrite").parquet(f"{path}/leases")
        last = self.log().agg(F.max("log_index").alias("last_applied")).withColumn("clock", F.lit(self.clock()).cast("bigint"))
        last.write.mode("overwrite").parquet(f"{path}/meta")

    def restore(self, path: str) -> tuple[G.State, DataFrame]:
        """The state and leases of a snapshot; a snapshot that breaks a rule is refused."""
        meta = self.spark.read.parquet(f"{path}/meta").first()
        state = G.State(*[self.spark.read.parquet(f"{path}/{name}") for name in STATE])
        leases = self.spark.read.schema(f"clock bigint, {S.LEASES}").parquet(f"{path}/leases")
        broken = X.snapshot_violations(state, leases, meta.last_applied or 0, meta.clock).limit(1).collect()
        if broken:
            raise ValueError(f"snapshot breaks {broken[0].rule}: {broken[0].subject}")
        return state, leases
