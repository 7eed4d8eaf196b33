"""Histories, planning, tiers and figures."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from lithoframe.functions import metrics as M
from lithoframe.operators import history as Y
from lithoframe.operators import maintenance as X
from lithoframe.operators import tiers as T


def turns(spark, *rows):
    return spark.createDataFrame(rows, "session string, index long, role string, content string")


def test_history_replays_in_order_and_shares_blocks(spark):
    t = turns(spark, ("s", 0, "user", "What is the capital of France?"), ("s", 1, "assistant", "Paris."), ("s", 2, "user", "And of Italy?"), ("z", 0, "user", "What is the capital of France?"))
    chain = Y.history_chain(t)
    tip = {r.session: r.turns for r in Y.replay(chain).collect()}
    assert tip == {"s": 3, "z": 1}
    said = [r.content for r in Y.messages(Y.replay(chain), Y.turn_blocks(t)).where("session = 's'").orderBy("position").collect()]
    assert said == ["What is the capital of France?", "Paris.", "And of Italy?"]
    assert Y.turn_dedup(t).where("sessions = 2").count() == 1
    roots = {r.key for r in chain.where("depth = 0").collect()} | {r.key for r in Y.history_chain(t, 1).where("depth = 0").collect()}
    assert len(roots) == 4
    cut = chain.where("not (session = 's' and depth = 2)")
    assert {r.session: r.turns for r in Y.replay(cut).collect()} == {"s": 1, "z": 1}


def test_roles(spark):
    r = spark.range(1).select(*[Y.role_in(F.lit(x)) for x in ("human", "ai", "tool")], *[Y.role_out(F.lit(x)) for x in ("assistant", "tool")]).first()
    assert list(r) == ["user", "assistant", "tool", "ai", "human"]


def test_planner(spark):
    chains = spark.createDataFrame([("q", d, f"k{d}") for d in range(4)], "lookup_id string, depth int, key string")
    bound = spark.createDataFrame([("k0", ["b"]), ("k1", ["b"])], "key string, blocks array<string>")
    for computed, want in ((0, 512), (256, 256), (768, 0)):
        q = spark.createDataFrame([("q", computed)], "lookup_id string, computed int")
        assert Y.matched_tokens(q, chains, bound).first().matched == want
    plan = Y.save_plan(chains, 2).orderBy("depth").collect()
    assert [(r.key, r.parent) for r in plan] == [("k0", None), ("k1", "k0")]
    saved = Y.save_plan(chains, 3).withColumn("block_id", F.concat(F.lit("b"), F.col("depth").cast("string")))
    assert [r.blocks for r in Y.cumulative_bind(saved).orderBy("depth").collect()] == [["b0"], ["b0", "b1"], ["b0", "b1", "b2"]]


def test_payload_and_pages(spark):
    r = turns(spark, ("s", 0, "user", "hi")).select(Y.turn_payload("role", "content", "index").alias("p"), Y.pseudo_tokens(F.lit(b"x")).alias("t"), Y.encode_pages(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0)))).alias("e")).first()
    assert r.p.startswith('{"role":"user","content":"hi","index":0,"chain":[') and len(r.t) == 2
    assert Y.decode_pages(bytes(r.e), [2, 1]) == [[1.0, 2.0], [3.0]]


def test_pins_and_warm_tier(spark):
    c = spark.createDataFrame([("t", 0, "a", 3000), ("t", 1, "b", 3000), ("t", 2, "c", 1000), ("t", 3, "a", 3000)], "tier string, pos long, block_id string, payload_len long")
    assert [r.fits for r in T.pin_greedy(c, 16384).orderBy("pos").collect()] == [True, False, True, True]
    a = spark.createDataFrame([("t", i, b, n, False, q) for i, (b, n, q) in enumerate([("x", 1000, False), ("y", 1000, False), ("z", 1000, False), ("z", 1000, False), ("x", 1000, False), ("big", 5000, False), ("big", 5000, False), ("z", 1000, True)])], "tier string, pos long, block_id string, payload_len long, pinned boolean, quarantined boolean")
    out = T.simulate(a, 2500)
    assert [r.outcome for r in out.orderBy("pos").collect()] == ["miss", "miss", "miss", "hit", "miss", "miss", "miss", "error"]
    assert T.tier_stats(out).first().hits == 1


def test_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in (4, 1, 3, 2)], "x double")
    x = F.col("x")
    assert df.agg(M.percentile_linear(x, 0.5)).first()[0] == 2.5
    assert list(M.ranked(df, "x", [], {"r": M.rounded_place(0.5), "t": M.truncated_place(0.99)}).first()) == [3.0, 3.0]
    assert M.ranked(df.where("x = 1"), "x", [], {"t": M.truncated_place(0.99)}).first().t == 1.0


def test_metric_lines(spark):
    lines = [r.line for r in M.metric_lines(spark.range(1).select(F.lit(3).alias("blocks")), "p").orderBy("position").collect()]
    assert lines == ["# HELP p_blocks Stored blocks", "# TYPE p_blocks gauge", "p_blocks 3"]
    assert list(spark.range(1).select(M.hit_rate(F.lit(3), F.lit(1)), M.hit_rate(F.lit(0), F.lit(0))).first()) == [0.75, None]


def test_upload_budget(spark):
    mib = 1 << 20
    r = spark.range(1).select(*[X.concurrent_uploads(F.lit(n)) for n in (256 * mib, 1, 449 * mib)]).first()
    assert list(r) == [1, 4, None]


def test_snapshot_violations(spark):
    make = spark.createDataFrame
    state = SimpleNamespace(agents=make([("a",)], "agent string"), bindings=make([("k",)], "key string"), revisions=make([("k", 1), ("lost", 1)], "key string, revision long"), requirements=make([("b", 1)], "block_id string, replicas int"), fences=make([("b", 99)], "block_id string, log_index long"))
    rows = [("ok", "a", ["b"], 1, "k", 0, None, None, None, None, None), ("bad", "z", [], 5, None, None, 3, None, 1, 9, 2)]
    leases = make(rows, "lease string, agent string, blocks array<string>, created_at long, committed_key string, committed_revision long, cancelled_at long, expired_at long, generation long, deadline_tick long, ttl_ticks long")
    got = {(r.rule, r.subject) for r in X.snapshot_violations(state, leases, 10, 3).collect()}
    assert got == {("replicas_out_of_range", "b"), ("fence_after_last_entry", "b"), ("revision_without_binding", "lost"), ("owner_not_registered", "bad"), ("ended_before_it_began", "bad"), ("block_count", "bad"), ("time_to_live", "bad")}
