"""The client workflow from end to end, and the registered queries against their SQL."""

import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lithoframe.api import Engine
from lithoframe.plans import catalog, records  # noqa: F401

DIR = "/root/testdata/sf0.001"


def test_workflow(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    payloads = spark.createDataFrame([(0, b"chunk 0"), (1, b"chunk 1"), (2, b"chunk 0")], "pos long, payload binary")
    ids = {r.pos: r.block_id for r in e.put_many(payloads).collect()}
    assert ids[0] == ids[2] and e.blocks().count() == 2
    e.put_many(payloads)
    assert e.blocks().count() == 2 and e.fsck().first().intact == 2
    requests = spark.createDataFrame([("q", [1, 2, 3, 4, 5], 0)], "lookup_id string, tokens array<bigint>, computed int")
    keys = [r.key for r in e.keys(requests, 2).orderBy("depth").collect()]
    rows = [(1, "register", "a", "Ann", None, None, None), (2, "bind", "a", None, keys[0], [ids[0]], None), (3, "bind", "a", None, keys[1], [ids[0], ids[1]], keys[0])]
    e.append(spark.createDataFrame(rows, "log_index long, kind string, agent string, display_name string, key string, blocks array<string>, parent string"))
    hit = e.lookup(e.keys(requests, 2)).first()
    assert (hit.hit_depth, hit.blocks) == (1, [ids[0], ids[1]])
    assert e.matched_tokens(requests, 2).first().matched == 4
    assert [(r.agent, r.bindings) for r in e.agents().collect()] == [("a", 2)]
    assert {r.key: r.extends for r in e.bindings("a").collect()} == {keys[0]: None, keys[1]: keys[0]}
    assert e.stats().first().data_plane.blocks == 2
    assert {r.status for r in e.answers().collect()} == {"ok"}
    evidence = e.reclamation(spark.createDataFrame([(ids[0],)], "block_id string")).first()
    assert evidence.binding_references == 2 and evidence.pending == 0
    assert e.prefetch(e.keys(requests, 2)).count() == 2
    e.snapshot(str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap/bindings")).count() == 2


def plain(v):
    if v is None or v != v:
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["longest_prefix_lookup", "lookup_blocks", "prefetch_set", "fences_state", "reclamation_blockers", "history_replay", "matched_tokens", "latency_rounded", "prometheus_lines", "compacted_index", "key_lineage", "snapshot_violations", "retention_protect", "stats_payload", "log_entries_kept", "segment_roll", "batch_frame_parse", "short_forms"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(map(repr, (tuple(map(plain, r)) for r in cur.fetchall())))
    got = catalog.queries()[name](spark, DIR).select(*[F.col(f"`{n}`") for n in names])
    assert sorted(map(repr, (tuple(map(plain, r)) for r in got.collect()))) == want


def test_chains_and_checked_binds(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    ids = {r.pos: r.block_id for r in e.put_many(spark.createDataFrame([(0, b"x"), (1, b"y")], "pos long, payload binary")).collect()}
    link = "array<struct<key:string,blocks:array<string>,parent:string>>"
    chain = [(2, "bind_chain", "a", [("k", [ids[0]], None), ("l", [ids[0], ids[1]], "k")]), (3, "bind_chain", "a", [("m", [ids[0]], None), ("n", ["gone"], "m")])]
    gone = e.bind(spark.createDataFrame(chain, f"log_index long, kind string, agent string, links {link}")).collect()
    assert [(r.log_index, r.first_missing) for r in gone] == [(3, "gone")]
    gone = e.bind(spark.createDataFrame([(4, "bind", "a", "o", [ids[1]]), (5, "bind", "a", "p", [ids[1], "none"])], "log_index long, kind string, agent string, key string, blocks array<string>")).collect()
    assert [r.log_index for r in gone] == [5]
    s = e.state()
    assert {r.key: r.blocks for r in s.bindings.collect()} == {"k": [ids[0]], "l": [ids[0], ids[1]], "o": [ids[1]]}
    assert [(r.parent_key, r.child_key) for r in s.edges.collect()] == [("k", "l")]


def test_snapshot_is_restored_or_refused(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    row = lambda i, kind, lease=None, key=None, blocks=None, revision=None, tick=None: (i, kind, "a", lease, key, blocks, revision, tick)
    rows = [row(1, "register"), row(2, "begin", "l", blocks=["y"]), row(3, "advance", tick=0), row(4, "commit", "l", "k", ["y"], 0), row(5, "begin", "m", blocks=["w"])]
    e.append(spark.createDataFrame(rows, "log_index long, kind string, agent string, lease string, key string, blocks array<string>, expected_revision long, expected_tick long"))
    path = str(tmp_path / "snap")
    e.snapshot(path)
    state, leases = e.restore(path)
    assert [(r.key, r.blocks) for r in state.bindings.collect()] == [("k", ["y"])]
    assert {r.lease: r.status for r in leases.collect()} == {"l": "committed", "m": "pending"} and leases.first().clock == 1
    spark.createDataFrame([("w", 99)], "block_id string, log_index long").write.mode("overwrite").parquet(f"{path}/fences")
    with pytest.raises(ValueError, match="fence_after_last_entry"):
        e.restore(path)


def test_rest_works_without_the_training_data_operators(tmp_path):
    root = Path(entry.__file__).parent
    for name in ("__spark_entry__.py", "lithoframe"):
        source = root / name
        copy = shutil.copytree if source.is_dir() else shutil.copy
        copy(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if source.is_dir() else {}))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(n.startswith('op1_') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": os.environ["PATH"], "PYTHONPATH": str(tmp_path)})


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["lookup_id", "hit_depth"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    has_llm = importlib.util.find_spec("lithoframe.llm") is not None
    assert has_llm == any(n.startswith("op1_") for n in entry.queries())


def test_state_has_what_lease_commits_bind(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "leased"))
    row = lambda i, kind, lease=None, key=None, blocks=None, parent=None, revision=None: (i, kind, "a", lease, key, blocks, parent, revision)
    rows = [
        row(1, "register"), row(2, "bind", key="k", blocks=["x"]), row(3, "begin", "l", blocks=["y", "z"]), row(4, "begin", "m", blocks=["w"]),
        row(5, "commit", "l", "k", ["y", "z"], "p", 0), row(6, "commit", "m", "k", ["w"], None, 0), row(7, "bind", key="k", blocks=["v"]), row(8, "commit", "l", "k", ["y", "z"], "p", 0),
    ]
    e.append(spark.createDataFrame(rows, "log_index long, kind string, agent string, lease string, key string, blocks array<string>, parent string, expected_revision long"))
    s = e.state()
    assert [(r.key, r.blocks, r.log_index) for r in s.bindings.collect()] == [("k", ["v"], 7)]
    assert [(r.parent_key, r.child_key, r.first_log_index) for r in s.edges.collect()] == [("p", "k", 5)]
    assert [(r.key, r.revision) for r in s.revisions.collect()] == [("k", 2)]
    assert {r.block_id: r.log_index for r in s.fences.collect()} == {"x": 5, "y": 8, "z": 8, "w": 4, "v": 8}
