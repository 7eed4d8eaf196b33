"""Rules of leases, one at a time and as a stream."""

import json

from pyspark.sql import functions as F

from lithoframe import schemas as S
from lithoframe.operators.leases import LeaseLog, fold, leases
from lithoframe.streaming.leases import answers

SCHEMA = "cluster string, " + S.MUTATIONS


def entry(i, kind, **k):
    base = {"cluster": "c", "log_index": i, "sub": 0, "kind": kind, "agent": "a", "lease": "L", "blocks": ["b"], "key": "k", "parent": None, "expected_revision": 0, "expected_generation": 0, "ttl_ticks": 2, "expected_tick": 0, "generation": 1, "deadline_tick": 2}
    return base | k


def run(*steps):
    log, out = LeaseLog(), []
    for i, (kind, k) in enumerate([("register", {}), *steps]):
        out.append(log.take(entry(i, kind, **k)))
        log = LeaseLog(log.dump())  # every state survives its JSON form
    return log, out[1:]


def statuses(*steps):
    return [a[0] for a in run(*steps)[1]]


def test_commit_is_atomic_and_compares_revisions():
    log, out = run(("begin", {}), ("commit", {}), ("commit", {}), ("commit", {"expected_revision": 1}))
    assert [a[0] for a in out] == ["ok", "ok", "ok", "rejected"]
    assert log.s["revisions"] == {"k": 1}  # the retry did not bind again
    assert statuses(("begin", {}), ("bind", {}), ("commit", {})) == ["ok", "ok", "rejected"]
    assert statuses(("begin", {}), ("bind", {}), ("commit", {"expected_revision": 1})) == ["ok"] * 3


def test_revisions_count_from_the_first_lease():
    log, _ = run(("bind", {}), ("begin", {}), ("bind", {}))
    assert log.s["revisions"] == {"k": 1}


def test_begin_checks_owner_blocks_and_identity():
    assert statuses(("begin", {"agent": "stranger"}), ("begin", {"blocks": []}), ("begin", {"blocks": ["b"] * 257})) == ["rejected"] * 3
    assert statuses(("begin", {}), ("begin", {}), ("begin", {"blocks": ["x"]}), ("cancel", {}), ("begin", {})) == ["ok", "ok", "rejected", "ok", "rejected"]


def test_wrong_owner_changes_nothing():
    log, out = run(("register", {"agent": "z"}), ("begin", {}), ("commit", {"agent": "z"}), ("cancel", {"agent": "z"}), ("renew", {"agent": "z"}))
    assert [a[0] for a in out[2:]] == ["rejected"] * 3 and log.rows()[0][-1] == "pending"


def test_commit_respects_the_owner_of_a_key():
    assert statuses(("bind", {"agent": "z"}), ("begin", {}), ("commit", {}))[-1] == "rejected"


def test_cancel_is_final_and_keeps_its_first_position():
    log, out = run(("begin", {}), ("cancel", {}), ("cancel", {}), ("commit", {}), ("renew", {}))
    assert [a[0] for a in out] == ["ok", "ok", "ok", "rejected", "rejected"] and log.rows()[0][6] == 2
    assert statuses(("begin", {}), ("commit", {}), ("cancel", {}))[-1] == "rejected"


def test_renewal_generations():
    log, out = run(("begin", {}), ("renew", {}), ("renew", {}), ("renew", {"expected_generation": 1}), ("advance", {}), ("renew", {"expected_generation": 1}), ("renew", {"expected_generation": 0}), ("renew", {"ttl_ticks": 86401, "expected_generation": 2}))
    assert out[1][2:] == (1, 2) and out[2][2:] == (1, 2)  # an exact retry has the old answer
    assert out[3][0] == "rejected"  # the deadline must move
    assert out[5][2:] == (2, 3) and [a[0] for a in out[6:]] == ["rejected"] * 2


def test_clock():
    log, out = run(("advance", {"expected_tick": 1}), ("advance", {}), ("advance", {}), ("advance", {"expected_tick": 1}))
    assert [a[0] for a in out] == ["rejected", "ok", "ok", "ok"] and log.s["clock"] == 2


def test_expiry_by_clock_and_marker():
    early = [("begin", {}), ("renew", {}), ("expire", {})]
    assert statuses(*early)[-1] == "rejected"
    late = [("begin", {}), ("renew", {}), ("advance", {}), ("advance", {"expected_tick": 1})]
    log, out = run(*late, ("commit", {}), ("expire", {"generation": 2}), ("expire", {}), ("expire", {}), ("cancel", {}), ("begin", {}))
    assert [a[0] for a in out[4:]] == ["rejected", "rejected", "ok", "ok", "rejected", "rejected"]
    assert log.rows()[0][7] == 7 and log.rows()[0][-1] == "expired"
    assert statuses(("begin", {}), ("renew", {}), ("commit", {}), ("advance", {}), ("advance", {"expected_tick": 1}), ("expire", {}))[-1] == "rejected"


def test_capacity(monkeypatch):
    monkeypatch.setattr(S, "MAX_LEASES", 1)
    assert statuses(("begin", {}), ("begin", {"lease": "M"})) == ["ok", "rejected"]


STEPS = [("register", {}), ("begin", {}), ("renew", {}), ("advance", {}), ("commit", {}), ("commit", {"expected_revision": 5})]


def frame(spark, steps, cluster="c"):
    rows = [entry(i, kind, **k) | {"cluster": cluster} for i, (kind, k) in enumerate(steps)]
    names = [x.strip().split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA)


def test_fold_by_cluster(spark):
    both = frame(spark, STEPS).unionByName(frame(spark, STEPS[:3], "d"))
    got = {(r.cluster, r.log_index): r.status for r in fold(both).collect()}
    assert got[("c", 4)] == "ok" and got[("c", 5)] == "rejected" and len(got) == 9
    table = {r.cluster: (r.status, r.clock, r.deadline_tick) for r in leases(both).collect()}
    assert table == {"c": ("committed", 1, 2), "d": ("pending", 0, 2)}


def test_stream_equals_the_fold(spark, tmp_path):
    src = tmp_path / "in"
    for i in range(0, len(STEPS), 2):
        part = frame(spark, STEPS).where((F.col("log_index") >= i) & (F.col("log_index") < i + 2))
        part.coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = str(tmp_path / "out")
    q = answers(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = sorted((r.log_index, r.status, r.generation, r.deadline_tick) for r in spark.read.parquet(out).collect())
    want = sorted((r.log_index, r.status, r.generation, r.deadline_tick) for r in fold(frame(spark, STEPS)).collect())
    assert json.dumps(got) == json.dumps(want)
