"""The materialized log against a sequential model, and the reads on top of it."""

import random
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithoframe import schemas as S
from lithoframe.operators import log as G
from lithoframe.operators import prefix as P
from lithoframe.operators import state_reads as R

COLUMNS = "log_index bigint, sub bigint, kind string, agent string, display_name string, key string, blocks array<string>, parent string, replicas int"


def model(rows, activated_at):
    agents, bound, edges, needs, fences, revisions = {}, {}, [], {}, {}, Counter()
    for i, _, kind, agent, name, key, blocks, parent, n in rows:
        if kind == "register":
            agents[agent] = (name, i)
        elif kind == "bind":
            for b in blocks + (bound[key][1] if key in bound else []):
                fences[b] = i
            bound[key] = (agent, blocks, i)
            revisions[key] += i > activated_at
            if parent is not None and (parent, key) not in edges:
                edges.append((parent, key))
        elif kind == "require" and 2 <= n <= 16:
            for b in blocks:
                needs[b] = max(n, needs.get(b, 0))
                fences[b] = i
    refs = Counter(b for _, bs, _ in bound.values() for b in bs)
    return agents, bound, edges, needs, fences, +revisions, refs


entry = st.tuples(st.sampled_from(["register", "bind", "bind", "require", "blank"]), st.sampled_from("abc"), st.sampled_from("uvwxyz"), st.lists(st.sampled_from("12345"), min_size=1, max_size=4), st.sampled_from([None, "u", "v"]), st.integers(0, 18))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(entries=st.lists(entry, max_size=30), activated_at=st.integers(0, 20))
def test_log_equals_the_model(spark, entries, activated_at):
    rows = [(i, 0, kind, agent, f"n{i}", key, blocks, parent, n) for i, (kind, agent, key, blocks, parent, n) in enumerate(entries)]
    agents, bound, edges, needs, fences, revisions, refs = model(rows, activated_at)
    random.Random(1).shuffle(rows)
    s = G.materialize(spark.createDataFrame(rows, COLUMNS), activated_at)
    assert {r.agent: (r.display_name, r.registered_at) for r in s.agents.collect()} == agents
    assert {r.key: (r.agent, r.blocks, r.log_index) for r in s.bindings.collect()} == bound
    assert [(r.parent_key, r.child_key) for r in s.edges.orderBy("first_log_index", "sub").collect()] == edges
    assert {r.block_id: r.replicas for r in s.requirements.collect()} == needs
    assert {r.block_id: r.log_index for r in s.fences.collect()} == fences
    assert {r.key: r.revision for r in s.revisions.collect()} == revisions
    assert {r.block_id: r.refs for r in s.refs.collect()} == refs


def chains(spark, rows):
    return spark.createDataFrame(rows, "lookup_id string, depth int, key string")


def bindings(spark, rows):
    return spark.createDataFrame(rows, "key string, blocks array<string>")


def test_lookup_stops_at_the_first_gap(spark):
    b = bindings(spark, [("k0", ["b0"]), ("k2", ["b2"])])
    c = chains(spark, [("gap", 0, "k0"), ("gap", 1, "k1"), ("gap", 2, "k2"), ("miss", 0, "zz"), ("hit", 0, "k0")])
    got = {r.lookup_id: (r.hit_depth, r.blocks) for r in P.lookup_blocks(c, b).collect()}
    assert got == {"gap": (0, ["b0"]), "miss": (None, []), "hit": (0, ["b0"])}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=5), min_size=1, max_size=6), bound=st.sets(st.sampled_from("abcdef")))
def test_lookup_equals_a_walk(spark, data, bound):
    rows = [(str(i), d, k) for i, c in enumerate(data) for d, k in enumerate(c)]
    want = {}
    for i, c in enumerate(data):
        n = next((d for d, k in enumerate(c) if k not in bound), len(c))
        want[str(i)] = n - 1 if n else None
    b = bindings(spark, [(k, [k]) for k in bound] or [("none", ["x"])])
    assert {r.lookup_id: r.hit_depth for r in P.longest_prefix(chains(spark, rows), b).collect()} == want


def test_prefetch_touches_hit_then_children(spark):
    b = bindings(spark, [("k0", ["b0"]), ("k1", ["b0", "b1"])])
    e = spark.createDataFrame([("k0", "k1", 1, 0, 1), ("k0", "unbound", 2, 0, 2)], "parent_key string, child_key string, first_log_index long, sub long, last_log_index long")
    hit = P.lookup_blocks(chains(spark, [("q", 0, "k0")]), b)
    got = [r.block_id for r in P.prefetch_set(hit, e, b).orderBy("source", "edge_no", "pos").collect()]
    assert got == ["b0", "b0", "b1"]


def test_refs_count_repeats_inside_a_binding(spark):
    refs = G.block_refs(bindings(spark, [("k", ["x", "y", "x"])]))
    assert {r.block_id: r.refs for r in refs.collect()} == {"x": 2, "y": 1}


def observed(spark, **changes):
    row = {"block_id": "b", "storage_generation": "s", "want_storage_generation": "s", "local_generation": 7, "want_local_generation": 7, "block_reference_fence": 11, "want_block_reference_fence": 11, "guarded": True, "write_failed": False, "active_local_writes": 0, "local_release_check": False, "binding_references": 0, "pending": 0, "required_replicas": 0} | changes
    kind = {str: "string", bool: "boolean", int: "int"}
    base = {k: type(v) for k, v in row.items() if v is not None}
    schema = ", ".join(f"{k} {kind[base.get(k, int)]}" for k in row)
    return R.reclamation_blockers(spark.createDataFrame([tuple(row.values())], schema)).first()


def test_reclamation_blockers(spark):
    assert (r := observed(spark)).observed_fences_match and len(r.blockers) == 6 and not r.reclaimable
    for fence in ("local_generation", "block_reference_fence"):
        assert not observed(spark, **{fence: None}).observed_fences_match
        assert not observed(spark, **{fence: 1}).observed_fences_match
    assert len(observed(spark, binding_references=2, pending=1, required_replicas=3).blockers) == 9
    assert "active_local_writes_present_or_unknown" in observed(spark, active_local_writes=1).blockers


def test_location_observation(spark):
    rows = [(1, "x", 1, "g1"), (2, "y", 1, "g1"), (3, "x", 1, "g2"), (4, "none", 1, "g2")] + [(10 + n, "z", n, "g") for n in range(22, 2, -1)] + [(90, "w", 50, "g"), (91, "w", 50, None), (92, "w", 51, "g")]
    got = defaultdict(dict)
    required = spark.createDataFrame([(b,) for b in "xyzw"], "block_id string")
    for r in R.observe_locations(spark.createDataFrame(rows, "at long, block_id string, node long, generation string"), required).collect():
        got[r.block_id][r.node] = r.generation
    assert got["x"] == {1: "g2"} and "y" not in got and "none" not in got and got["w"] == {51: "g"}
    held = set()
    for _, b, n, _ in sorted(r for r in rows if r[1] == "z"):
        held = (held - {min(held)} if len(held) >= 16 else held) | {n}
    assert set(got["z"]) == held and 22 in held  # a new node lower than all 16 is kept


def test_capacities_reject_in_log_order(spark):
    rows = [(1, 0, "require", ["a", "b"], 3), (2, 0, "bind", ["c"], None), (3, 0, "bind", ["d"], None), (3, 1, "bind", ["e", "f"], None), (4, 0, "require", ["a", "c"], 2), (5, 0, "require", ["z"], 99), (6, 0, "bind", ["d"], None), (7, 0, "bind", ["x"], None), (8, 0, "bind", ["a", "c"], None), (9, 0, "require", ["c", "d"], 4)]
    df = spark.createDataFrame(rows, "log_index long, sub long, kind string, blocks array<string>, replicas int")
    got = {r.log_index: r.reason for r in G.capacity_rejections(df, most_required=3, most_fenced=4).collect()}
    full = "block fence capacity exhausted"
    assert got == {3: full, 7: full, 9: "replica requirement capacity exhausted"}


def test_state_over_capacity_leaves_out_what_the_log_rejects(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_BLOCK_FENCES", 2)
    monkeypatch.setattr(G.capacity_rejections, "__defaults__", (S.MAX_REQUIREMENTS, 2))
    rows = [(1, 0, "bind", "a", None, "k", ["x"], None, None), (2, 0, "bind", "a", None, "l", ["y"], None, None), (3, 0, "bind", "a", None, "k", ["z"], None, None), (4, 0, "bind", "a", None, "m", ["y"], None, None)]
    df = spark.createDataFrame(rows, "log_index long, sub long, kind string, agent string, display_name string, key string, blocks array<string>, parent string, replicas int")
    s = G.materialize(df, capped=True)
    assert {r.key: r.blocks for r in s.bindings.collect()} == {"k": ["x"], "l": ["y"], "m": ["y"]}
    assert {r.block_id: r.log_index for r in s.fences.collect()} == {"x": 1, "y": 4}


def test_lineage_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(str(i), str(i + 1), i, 0, i) for i in range(n)], "parent_key string, child_key string, first_log_index long, sub long, last_log_index long")
    got = P.lineage(edges, spark.createDataFrame([(str(n),), ("5",), ("alone",)], "key string"))
    assert sorted((r.leaf, r.step, r.key) for r in got.collect()) == sorted([(str(n), i, str(n - i)) for i in range(n + 1)] + [("5", i, str(5 - i)) for i in range(6)] + [("alone", 0, "alone")])


def test_lineage_ends_in_a_ring(spark):
    ups = {"a": "b", "b": "c", "c": "d", "d": "b", "self": "self"}
    edges = spark.createDataFrame([(up, key, 0, 0, 0) for key, up in ups.items()], "parent_key string, child_key string, first_log_index long, sub long, last_log_index long")
    got = P.lineage(edges, spark.createDataFrame([("a",), ("a",), ("c",), ("self",)], "key string"))
    want = [("a", i, k) for i, k in enumerate("abcd")] + [("c", i, k) for i, k in enumerate("cdb")] + [("self", 0, "self")]
    assert sorted((r.leaf, r.step, r.key) for r in got.collect()) == sorted(want)


def test_lease_status_precedence(spark):
    rows = [("c", "k", 5, 6, 1), ("x", None, 5, 6, 1), ("e", None, None, 6, 1), ("d", None, None, None, 20), ("p", None, None, None, 21), ("n", None, None, None, None)]
    df = spark.createDataFrame(rows, "lease string, committed_key string, cancelled_at long, expired_at long, deadline_tick long").withColumn("generation", F.lit(1)).withColumn("blocks", F.array(F.lit("b")))
    got = {r.lease: r.status for r in R.lease_status(df, F.lit(20)).collect()}
    assert got == {"c": "committed", "x": "cancelled", "e": "expired", "d": "expired", "p": "pending", "n": "pending"}
    assert [r.lease for r in R.expiry_work(df, F.lit(20)).collect()] == ["d"]


def test_limits_are_stated():
    assert (S.MAX_LEASES, S.MAX_LEASE_BLOCKS, S.MAX_TTL_TICKS) == (4096, 256, 86400)
