"""Upload leases on a logical clock: the one part of the log that is a true fold.

A commit depends on revisions that earlier accepted commits have raised, and every verdict on the clock and the
lease's own past, so entries are folded in log order, a log (cluster) per group. The fold holds the lease table,
which the capacities bound, and the revisions and owners of bound keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData

from .. import schemas as S

MOVES = ("register", "bind", "begin", "commit", "cancel", "renew", "advance", "expire")
STATE = "cluster string, payload string"


def _plain(x: Any) -> Any:
    """A pandas cell as a Python value."""
    if x is None or (isinstance(x, float) and x != x) or x is pd.NaT or x is pd.NA:
        return None
    if hasattr(x, "tolist"):
        return x.tolist()
    return int(x) if isinstance(x, float) and x.is_integer() else x


class LeaseLog:
    """Folds entries (dicts by column name) into verdicts; its state is plain JSON."""

    def __init__(self, state: str | None = None):
        self.s: dict[str, Any] = json.loads(state) if state else {"agents": [], "owners": {}, "leases": {}, "revisions": {}, "clock": 0, "active": False}
        self.agents = set(self.s["agents"])
        self.reserved = sum(len(x["blocks"]) for x in self.s["leases"].values())

    def dump(self) -> str:
        self.s["agents"] = sorted(self.agents)
        return json.dumps(self.s)

    def status(self, lease: dict) -> str:
        if lease["commit"]:
            return "committed"
        if lease["cancelled_at"] is not None:
            return "cancelled"
        late = lease["deadline_tick"] is not None and lease["deadline_tick"] <= self.s["clock"]
        return "expired" if late or lease["expired_at"] is not None else "pending"

    def take(self, e: dict) -> tuple[str, str | None, int | None, int | None]:
        """status, reason, generation, deadline_tick."""
        answer = getattr(self, "_" + e["kind"], None)
        if answer is None:
            return "ok", None, None, None
        found = answer(e)
        if isinstance(found, str):
            return "rejected", found, None, None
        return ("ok", None, *found) if found else ("ok", None, None, None)

    def _register(self, e: dict) -> None:
        self.agents.add(e["agent"])

    def _bound(self, key: str, agent: str) -> None:
        self.s["owners"][key] = agent
        if self.s["active"]:
            self.s["revisions"][key] = self.s["revisions"].get(key, 0) + 1

    def _bind(self, e: dict) -> None:
        self._bound(e["key"], e["agent"])

    def _begin(self, e: dict) -> str | None:
        blocks = e["blocks"] or []
        if not 1 <= len(blocks) <= S.MAX_LEASE_BLOCKS or e["agent"] not in self.agents:
            return "needs a registered owner and 1..256 blocks"
        if not self.s["active"]:
            self.s["active"], self.s["revisions"] = True, {}
        old = self.s["leases"].get(e["lease"])
        if old:
            if (old["agent"], old["blocks"]) != (e["agent"], blocks):
                return "id belongs to a different reservation"
            now = self.status(old)
            return f"lease {now}" if now in ("expired", "cancelled") else None
        if len(self.s["leases"]) >= S.MAX_LEASES or self.reserved + len(blocks) > S.MAX_RESERVED_BLOCKS:
            return "lease capacity exhausted"
        self.reserved += len(blocks)
        self.s["leases"][e["lease"]] = {"agent": e["agent"], "blocks": blocks, "created_at": e["log_index"], "commit": None, "cancelled_at": None, "expired_at": None, "generation": 0, "deadline_tick": None, "ttl_ticks": None}
        return None

    def _commit(self, e: dict) -> str | None:
        lease = self.s["leases"].get(e["lease"])
        wanted = {"key": e["key"], "parent": e["parent"], "revision": e["expected_revision"]}
        if not lease:
            return "unknown lease"
        if lease["agent"] != e["agent"] or lease["blocks"] != (e["blocks"] or []):
            return "owner or blocks differ"
        now = self.status(lease)
        if now == "committed":
            return None if lease["commit"] == wanted else "lease already consumed"
        if now != "pending":
            return f"lease {now}"
        if self.s["owners"].get(e["key"], e["agent"]) != e["agent"]:
            return "key belongs to a different agent"
        if self.s["revisions"].get(e["key"], 0) != e["expected_revision"]:
            return "revision conflict"
        self._bound(e["key"], e["agent"])
        lease["commit"] = wanted
        return None

    def _cancel(self, e: dict) -> str | None:
        lease = self.s["leases"].get(e["lease"])
        if not lease:
            return "unknown lease"
        if lease["agent"] != e["agent"]:
            return "owner differs"
        now = self.status(lease)
        if now in ("committed", "expired"):
            return f"lease {now}"
        if now == "pending":
            lease["cancelled_at"] = e["log_index"]
        return None

    def _renew(self, e: dict) -> str | tuple[int, int]:
        lease, ttl, seen = self.s["leases"].get(e["lease"]), e["ttl_ticks"], e["expected_generation"]
        if not lease:
            return "unknown lease"
        if lease["agent"] != e["agent"] or self.status(lease) != "pending":
            return "not pending for this owner"
        if ttl is None or seen is None or not 1 <= ttl <= S.MAX_TTL_TICKS:
            return "invalid time to live or generation"
        if lease["deadline_tick"] is None or (lease["generation"], lease["ttl_ticks"]) != (seen + 1, ttl):
            deadline = self.s["clock"] + ttl
            if seen != lease["generation"]:
                return "generation conflict"
            if lease["deadline_tick"] is not None and deadline <= lease["deadline_tick"]:
                return "deadline must move"
            lease |= {"generation": seen + 1, "deadline_tick": deadline, "ttl_ticks": ttl}
        return lease["generation"], lease["deadline_tick"]

    def _advance(self, e: dict) -> str | None:
        if e["expected_tick"] > self.s["clock"]:
            return "clock conflict"
        self.s["clock"] += e["expected_tick"] == self.s["clock"]
        return None

    def _expire(self, e: dict) -> str | None:
        lease = self.s["leases"].get(e["lease"])
        if not lease or self.status(lease) != "expired" or (lease["generation"], lease["deadline_tick"]) != (e["generation"], e["deadline_tick"]):
            return "stale or premature expiry"
        if lease["expired_at"] is None:
            lease["expired_at"] = e["log_index"]
        return None

    def rows(self) -> list[tuple]:
        """The lease table, as schemas.LEASES has it."""
        out = []
        for name, x in sorted(self.s["leases"].items()):
            done = x["commit"] or {}
            has = x["deadline_tick"] is not None
            out.append((name, x["agent"], x["blocks"], x["created_at"], done.get("key"), done.get("revision"), x["cancelled_at"], x["expired_at"], x["generation"] if has else None, x["deadline_tick"], x["ttl_ticks"], self.status(x)))
        return out


def entries(frame: pd.DataFrame) -> Iterable[dict]:
    for row in frame.sort_values(["log_index", "sub"], kind="stable").to_dict("records"):
        yield {k: _plain(v) for k, v in row.items()}


def _clusters(mutations: DataFrame) -> GroupedData:
    """What leases depend on, by cluster; dealt over all partitions, as a fold's cost is not in the bytes that coalescing goes by."""
    n = int(mutations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mutations.where(mutations.kind.isin(*MOVES)).repartition(n, "cluster").groupBy("cluster")


def _in_order(log: pa.Table) -> list[dict]:
    return log.sort_by([("log_index", "ascending"), ("sub", "ascending")]).to_pylist()


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}
    fields = [c.split(" ", 1) for c in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def fold(mutations: DataFrame) -> DataFrame:
    """mutations with a cluster column -> cluster and schemas.RESPONSES, an answer for each entry that leases depend on."""
    schema = "cluster string, " + S.RESPONSES

    def run(key: tuple, log: pa.Table) -> pa.Table:
        state = LeaseLog()
        return _table([(e["cluster"], e["log_index"], *state.take(e)) for e in _in_order(log)], schema)

    return _clusters(mutations).applyInArrow(run, schema)


def leases(mutations: DataFrame) -> DataFrame:
    """mutations with a cluster column -> cluster, clock and schemas.LEASES after the whole log."""
    schema = "cluster string, clock bigint, " + S.LEASES

    def run(key: tuple, log: pa.Table) -> pa.Table:
        state = LeaseLog()
        for e in _in_order(log):
            state.take(e)
        return _table([(key[0].as_py(), state.s["clock"], *r) for r in state.rows()], schema)

    return _clusters(mutations).applyInArrow(run, schema)


def effects(mutations: DataFrame) -> DataFrame:
    """mutations with a cluster column -> what accepted lease entries do to the rest of the state, as rows of a log.

    A commit is a bind, a repeated one touches its own and its key's blocks, begin and renew touch the lease's blocks;
    the entry that activates leases is an activate row besides.
    """
    schema = "log_index bigint, sub bigint, kind string, agent string, key string, blocks array<string>, parent string"

    def run(key: tuple, log: pa.Table) -> pa.Table:
        state, out = LeaseLog(), []
        for e in _in_order(log):
            active, old = state.s["active"], state.s["leases"].get(e["lease"]) or {}
            again = bool(old.get("commit"))
            accepted = state.take(e)[0] == "ok"
            at = (e["log_index"], e["sub"])
            if state.s["active"] and not active:
                out.append((*at, "activate", None, None, None, None))
            if accepted and e["kind"] == "commit":
                out.append((*at, "touch" if again else "bind", e["agent"], e["key"], e["blocks"], e["parent"]))
            elif accepted and e["kind"] in ("begin", "renew"):
                out.append((*at, "touch", e["agent"], None, state.s["leases"][e["lease"]]["blocks"], None))
        return _table(out, schema)

    return _clusters(mutations).applyInArrow(run, schema)
