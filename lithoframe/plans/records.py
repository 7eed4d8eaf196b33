"""Queries on line and frame formats, signed messages, limits, snapshots and orderings, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import hashing as H
from ..functions import metrics as M
from ..operators import blocks as B
from ..operators import log as G
from ..operators import maintenance as X
from ..operators import state_reads as R
from ..operators import tiers as T
from ..sources import journals as J
from ..sources import segments as Z
from . import inputs as I
from .catalog import query


def fingerprint(name="m"):
    model = F.lit(name) if isinstance(name, str) else name
    return F.struct(model.alias("model_id"), F.lit("t").alias("tokenizer_hash"), F.lit("l").alias("kv_layout"))


def no_key():
    return F.lit(None).cast("struct<fingerprint:struct<model_id:string,tokenizer_hash:string,kv_layout:string>,prefix_hash:string>")


# Ids, keys and messages


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN upper(sha256(text)) WHEN 2 THEN sha256(text)[1:63] ELSE 'g' || sha256(text)[2:64] END AS raw FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN lower(raw) END AS id, coalesce(doc_id % 4 < 2 AND raw IS NOT NULL, FALSE) AS valid FROM t""")
def parsed_ids(spark, d) -> DataFrame:
    h, n = F.sha2("text", 256), F.col("doc_id") % 4
    raw = F.when(n == 0, h).when(n == 1, F.upper(h)).when(n == 2, F.substring(h, 1, 63)).otherwise(F.concat(F.lit("g"), F.substring(h, 2, 63)))
    return I.table(spark, d, "documents").select("doc_id", H.parse_id(raw).alias("id"), H.valid_generation(raw).alias("valid"))


@query("""SELECT doc_id, '{"fingerprint":{"model_id":"m","tokenizer_hash":"t","kv_layout":"l"},"prefix_hash":"' || sha256(text) || '"}' AS key FROM documents""")
def binding_keys(spark, d) -> DataFrame:
    return I.table(spark, d, "documents").where("text is not null").select("doc_id", H.binding_key(H.cache_key(fingerprint(), F.sha2("text", 256))).alias("key"))


@query("SELECT doc_id, octet_length(encode(repeat(text, 2))) <= 1024 AND doc_id % 3 <> 0 AS valid FROM documents WHERE text IS NOT NULL")
def valid_bindings(spark, d) -> DataFrame:
    key = H.cache_key(fingerprint(F.concat("text", "text")), F.lit("h"))
    other = H.cache_key(fingerprint(F.concat("text", "text", F.lit("x"))), F.lit("h"))
    parent = F.when(F.col("doc_id") % 3 == 0, other).when(F.col("doc_id") % 3 == 1, key)
    return I.table(spark, d, "documents").where("text is not null").select("doc_id", H.valid_binding(key, parent).alias("valid"))


@query("SELECT event_id, event_id * 1000 // 4096 * 4096 AS down, (event_id * 1000 + 4095) // 4096 * 4096 AS up FROM events")
def aligned(spark, d) -> DataFrame:
    n = F.col("event_id") * 1000
    return I.table(spark, d, "events").select("event_id", H.align_down(n).alias("down"), H.align_up(n).alias("up"))


_LINK = "encode('m') || unhex('00') || encode('t') || unhex('00') || encode('l') || unhex('00') || unhex(h)"


@query(f"""WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents)
SELECT doc_id, sha256(encode('KLPK/chain/v1') || unhex('00') || unhex(h) || unhex('02000000') || {_LINK} || unhex('01000000') || unhex(h) || unhex('00') || {_LINK} || unhex('02000000') || unhex(h) || unhex(h) || unhex('01') || unhex(h)) AS digest FROM b""")
def bind_chain_message(spark, d) -> DataFrame:
    h = F.sha2("text", 256)
    key = H.cache_key(fingerprint(), h)
    link = lambda blocks, parent: F.struct(key.alias("key"), blocks.alias("blocks"), parent.alias("parent"))
    links = F.array(link(F.array(h), no_key()), link(F.array(h, h), key))
    return I.table(spark, d, "documents").select("doc_id", F.sha2(H.chain_message(h, links), 256).alias("digest"))


@query("""WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents), k AS (SELECT *, unhex('0100000000000000') AS one, unhex('00') AS zero FROM b)
SELECT doc_id, sha256(encode('KLPK/lease/begin/v1') || zero || unhex(h) || unhex(h) || unhex('0200000000000000') || unhex(h) || unhex(h)) AS begun,
sha256(encode('KLPK/lease/cancel/v1') || zero || unhex(h) || unhex(h)) AS cancelled,
sha256(encode('KLPK/lease/commit/v1') || zero || unhex(h) || unhex(h) || unhex('0700000000000000') || one || encode('m') || one || encode('t') || one || encode('l') || unhex(h) || one || unhex(h) || unhex('01') || one || encode('m') || one || encode('t') || one || encode('l') || unhex(h)) AS committed FROM k""")
def lease_messages(spark, d) -> DataFrame:
    h = F.sha2("text", 256)
    key = H.cache_key(fingerprint(), h)
    message = lambda m, name: F.sha2(m, 256).alias(name)
    return I.table(spark, d, "documents").select("doc_id", message(H.lease_begin_message(h, h, F.array(h, h)), "begun"), message(H.lease_cancel_message(h, h), "cancelled"), message(H.lease_commit_message(h, h, key, F.array(h), key, F.lit(7)), "committed"))


@query("""SELECT user_id, sum(event_id) / 1048576.0 / (max(event_id) - min(event_id)) AS mib_per_s, count(*) / (max(event_id) - min(event_id))::DOUBLE AS blocks_per_s,
count(*) FILTER (event_type = 'view') / nullif(count(*) FILTER (event_type IN ('view', 'click')), 0)::DOUBLE AS hit_rate FROM events GROUP BY user_id HAVING max(event_id) > min(event_id)""")
def rates(spark, d) -> DataFrame:
    seconds = (F.max("event_id") - F.min("event_id")).cast("double")
    kind = lambda k: F.count_if(F.col("event_type") == k)
    g = I.table(spark, d, "events").groupBy("user_id").agg(F.sum("event_id").cast("double").alias("n"), F.count("*").alias("k"), seconds.alias("s"), kind("view").alias("hits"), kind("click").alias("misses")).where("s > 0")
    t = M.throughput(F.col("n"), F.col("k"), F.col("s"))
    return g.select("user_id", t["mib_per_s"].alias("mib_per_s"), t["blocks_per_s"].alias("blocks_per_s"), M.hit_rate(F.col("hits"), F.col("misses")).alias("hit_rate"))


# Manifests, logs, journals, ledgers, frames


def _lines(spark, d) -> DataFrame:
    """A manifest a line an event; the line at seven eighths of it is torn."""
    e = F.col("event_id")
    key = H.cache_key(fingerprint(), F.concat(F.lit("h"), (e % 97).cast("string")))
    line = J.manifest_line(key, F.array((e % 53).cast("string"), (e % 31).cast("string")))
    events = I.table(spark, d, "events")
    torn = events.agg(F.max(e).alias("last"))
    return events.join(F.broadcast(torn)).select(e.alias("line_no"), F.when(e == F.floor(F.col("last") * 7 / 8), F.substring(line, 1, 40)).when(e % 11 == 0, "").otherwise(line).alias("line"))


@query("""WITH t AS (SELECT floor(max(event_id) * 7 / 8.0) AS torn FROM events), g AS (SELECT event_id, event_id % 97 AS k FROM events, t WHERE event_id < torn AND event_id % 11 <> 0)
SELECT 'h' || k AS prefix_hash, 'm' AS model, (max(event_id) % 53) || ',' || (max(event_id) % 31) AS blocks FROM g GROUP BY k""")
def manifest_replay(spark, d) -> DataFrame:
    return J.manifest(_lines(spark, d)).select("key.prefix_hash", F.col("key.fingerprint.model_id").alias("model"), F.array_join("blocks", ",").alias("blocks"))


@query("SELECT event_id AS line_no, event_id AS log_index, event_type AS kind FROM events WHERE event_id < (SELECT max(event_id) FROM events) AND event_id BETWEEN 101 AND 899")
def log_entries_kept(spark, d) -> DataFrame:
    """Log lines read back without the torn last one, purged up to 100 and truncated before 900."""
    e = F.col("event_id")
    events = I.table(spark, d, "events")
    last = events.agg(F.max(e).alias("last"))
    line = F.to_json(F.struct(e.alias("log_index"), F.col("event_type").alias("kind")))
    lines = events.join(F.broadcast(last)).select(e.alias("line_no"), F.when(e == F.col("last"), F.substring(line, 1, 9)).otherwise(line).alias("line"))
    entries = J.log_entries(lines, "log_index bigint, kind string").select("line_no", "entry.log_index", "entry.kind")
    return J.truncated(J.purged(entries, 100), 900)


@F.pandas_udf(BinaryType())
def _journal(texts: pd.Series) -> pd.Series:
    """A journal of a frame a text, each guarding the text's id twice and that of the text before; the last one is torn."""
    from hashlib import sha256

    def one(ts) -> bytes:
        ids = [sha256(t.encode()).digest() for t in ts]
        return J.journal_frames([[x, x, ids[i - 1]] if i else [x] for i, x in enumerate(ids)], 1)[:-5]

    return texts.map(one)


JOURNAL = """r AS (SELECT source, doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE text IS NOT NULL),
g AS (SELECT source AS name, i AS sequence, h AS block_id FROM r WHERE i < n UNION SELECT b.source, b.i, a.h FROM r a JOIN r b ON a.source = b.source AND b.i = a.i + 1 WHERE b.i < b.n)"""


def _journals(spark, d) -> DataFrame:
    docs = I.table(spark, d, "documents").where("text is not null").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("t"))
    return docs.select(F.col("source").alias("name"), _journal(F.col("t.text")).alias("content"))


@query(f"WITH {JOURNAL} SELECT name, sequence, block_id FROM g")
def retention_journal(spark, d) -> DataFrame:
    return J.retention_journal(_journals(spark, d))


@query(f"WITH {JOURNAL}, m AS (SELECT block_id, max(sequence) AS s FROM g GROUP BY block_id), p AS (SELECT DISTINCT sha256(text) AS block_id FROM documents WHERE lang = 'fr' AND text IS NOT NULL) SELECT block_id, CASE WHEN p.block_id IS NOT NULL THEN 1000001 ELSE s END AS local_generation FROM m FULL JOIN p USING (block_id)")
def retention_protect(spark, d) -> DataFrame:
    """The guards of all journals after one more batch, of the French texts."""
    batch = I.table(spark, d, "documents").where("lang = 'fr' and text is not null").select(H.block_id(F.col("text")).alias("block_id"))
    return J.protect(batch, J.guards(J.retention_journal(_journals(spark, d))), 1_000_000)


@query(f"WITH {JOURNAL} SELECT count(DISTINCT block_id) AS guarded_blocks, 12345 AS journal_bytes, 1048576 AS max_guarded_blocks, FALSE AS automatic_expiry, FALSE AS gc_enabled FROM g")
def retention_snapshot(spark, d) -> DataFrame:
    return J.retention_snapshot(J.guards(J.retention_journal(_journals(spark, d))), 12345)


@query("SELECT user_id AS name, event_id AS sequence, before FROM (SELECT user_id, event_id, lag(event_id, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_id <> before + 1")
def sequence_gaps(spark, d) -> DataFrame:
    return J.sequence_gaps(I.table(spark, d, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("sequence")))


def _ledger(spark, d) -> DataFrame:
    """A ledger a user: what it requires, and where its blocks were seen; a generation in five is invalid."""
    e = F.col("event_id")
    rows = I.table(spark, d, "events").groupBy("user_id", (e % 53).cast("string").alias("block")).agg(F.max(e).alias("e"))
    gen = F.when(F.col("e") % 5 == 0, "bad").otherwise(F.sha2(F.col("e").cast("string"), 256))
    one = rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("block", (2 + F.col("e") % 15).cast("int")))).alias("blocks"), F.map_from_entries(F.collect_list(F.struct(F.col("block"), F.create_map((F.col("e") % 9).cast("string"), gen)))).alias("locations"))
    return one.select("user_id", F.to_json(F.struct(F.lit(1).alias("version"), "blocks", "locations")).alias("value"))


@query("""WITH r AS (SELECT user_id, CAST(event_id % 53 AS VARCHAR) AS block_id, max(event_id) AS e FROM events GROUP BY ALL)
SELECT 'required' AS part, block_id, CAST(2 + e % 15 AS BIGINT) AS n, NULL AS generation FROM r UNION ALL SELECT 'seen', block_id, e % 9, sha256(CAST(e AS VARCHAR)) FROM r WHERE e % 5 <> 0""")
def ledger_tables(spark, d) -> DataFrame:
    blocks, places = J.ledger_tables(_ledger(spark, d))
    required = blocks.select(F.lit("required").alias("part"), "block_id", F.col("replicas").cast("bigint").alias("n"), F.lit(None).cast("string").alias("generation"))
    return required.unionByName(places.select(F.lit("seen").alias("part"), "block_id", F.col("node").alias("n"), "generation"))


# Tiers and repair


@query(f"WITH {I.BLOCKS} SELECT DISTINCT block_id FROM docs WHERE pos % 2 = 0 AND block_id IN (SELECT block_id FROM damaged WHERE lang IN ('de', 'es'))")
def tier_quarantine(spark, d) -> DataFrame:
    """Of a warm tier of every second text, the blocks whose cold copy is damaged."""
    warm = I.payloads(spark, d).where("pos % 2 = 0").select(H.block_id(F.col("payload")).alias("block_id")).distinct()
    return T.quarantine(warm, B.damaged(I.damaged_store(spark, d)))


@query(f"WITH {I.BLOCKS} SELECT block_id, octet_length(encode(t)) AS n FROM (SELECT sha256(text) AS block_id, any_value(text) AS t FROM documents GROUP BY 1) WHERE block_id IN (SELECT block_id FROM damaged WHERE lang IN ('de', 'es'))")
def tier_repair(spark, d) -> DataFrame:
    candidates = I.payloads(spark, d).select(H.block_id(F.col("payload")).alias("block_id"), "payload")
    wrong = candidates.select("block_id", F.concat("payload", F.lit(b"x")).alias("payload"))
    return T.repair(B.damaged(I.damaged_store(spark, d)), candidates.unionByName(wrong), H.block_id).select("block_id", F.length("payload").cast("bigint").alias("n"))


@query("""WITH RECURSIVE c AS (SELECT source AS tier, doc_id AS pos, sha256(text) AS block_id, octet_length(encode(text)) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT tier, 0::BIGINT AS i, 0::BIGINT AS pos, '' AS block_id, 0::BIGINT AS n, 32768::BIGINT AS free, []::VARCHAR[] AS pinned, FALSE AS fits FROM (SELECT DISTINCT tier FROM c)
    UNION ALL SELECT w.tier, c.i, c.pos, c.block_id, c.n, CASE WHEN NOT list_contains(w.pinned, c.block_id) AND c.n <= w.free THEN w.free - c.n ELSE w.free END,
        CASE WHEN NOT list_contains(w.pinned, c.block_id) AND c.n <= w.free THEN list_append(w.pinned, c.block_id) ELSE w.pinned END, list_contains(w.pinned, c.block_id) OR c.n <= w.free
    FROM w JOIN c ON c.tier = w.tier AND c.i = w.i + 1)
SELECT tier, pos, block_id, n AS payload_len, fits FROM w WHERE i > 0""")
def pin_greedy(spark, d) -> DataFrame:
    p = I.payloads(spark, d).where("payload is not null").select(F.col("source").alias("tier"), "pos", H.block_id(F.col("payload")).alias("block_id"), F.length("payload").cast("bigint").alias("payload_len"))
    return T.pin_greedy(p, 1 << 17)


@query("""WITH RECURSIVE c AS (SELECT source AS store, doc_id AS pos, CAST(ceil((octet_length(encode(text)) + 64) / 4096.0) * 4096 AS BIGINT) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT store, 0::BIGINT AS i, 0::BIGINT AS pos, 0 AS segment, 0::BIGINT AS start, 0::BIGINT AS tail FROM (SELECT DISTINCT store FROM c)
    UNION ALL SELECT w.store, c.i, c.pos, CASE WHEN w.tail > 0 AND w.tail + c.size > 65536 THEN w.segment + 1 ELSE w.segment END, CASE WHEN w.tail > 0 AND w.tail + c.size > 65536 THEN 0 ELSE w.tail END,
        CASE WHEN w.tail > 0 AND w.tail + c.size > 65536 THEN 0 ELSE w.tail END + c.size FROM w JOIN c ON c.store = w.store AND c.i = w.i + 1)
SELECT store, pos, segment, start AS "offset" FROM w WHERE i > 0""")
def segment_roll(spark, d) -> DataFrame:
    return Z.roll(I.payloads(spark, d).where("payload is not null").select(F.col("source").alias("store"), "pos", F.length("payload").cast("bigint").alias("payload_len")), 1 << 16)


# State


CHAINED = """lk AS (SELECT event_id AS log_index, CAST(user_id AS VARCHAR) AS agent, s AS sub, CAST((event_id + s * s) % 97 AS VARCHAR) AS key, [CAST((event_id + s) % 53 AS VARCHAR)] AS blocks, CASE WHEN s > 0 THEN CAST((event_id + (s - 1) * (s - 1)) % 97 AS VARCHAR) END AS parent
    FROM events, (SELECT unnest([0, 1, 2, 3]) AS s) WHERE event_type = 'click' AND s <= event_id % 4)"""


@query(f"WITH {CHAINED} SELECT key, arg_max(agent, (log_index, sub)) AS agent, arg_max(blocks[1], (log_index, sub)) AS block, max(log_index) AS log_index FROM lk GROUP BY key")
def bind_chain_links(spark, d) -> DataFrame:
    """Chain entries of one to four links, among which a key may come twice."""
    e = F.col("event_id")
    key = lambda s: ((e + s * s) % 97).cast("string")
    links = F.transform(F.sequence(F.lit(0).cast("bigint"), e % 4), lambda s: F.struct(key(s).alias("key"), F.array(((e + s) % 53).cast("string")).alias("blocks"), F.when(s > 0, key(s - 1)).alias("parent")))
    none = F.lit(None).cast("string")
    chain = I.table(spark, d, "events").where("event_type = 'click'").select(e.alias("log_index"), F.lit(0).cast("bigint").alias("sub"), F.lit("bind_chain").alias("kind"), F.col("user_id").cast("string").alias("agent"), none.alias("key"), F.lit(None).cast("array<string>").alias("blocks"), none.alias("parent"), links.alias("links"))
    return G.bindings(G.expanded(chain)).select("key", "agent", F.col("blocks")[0].alias("block"), "log_index")


@query(f"""WITH RECURSIVE {I.LOG}, q AS (SELECT *, row_number() OVER (ORDER BY log_index) AS i FROM log WHERE kind IN ('bind', 'require')),
w AS (SELECT 0::BIGINT AS i, 0::BIGINT AS log_index, []::VARCHAR[] AS fenced, []::VARCHAR[] AS required, NULL::VARCHAR AS reason
    UNION ALL SELECT q.i, q.log_index,
        CASE WHEN n.f > 60 OR n.bad OR (q.kind = 'require' AND n.r > 25) THEN w.fenced ELSE list_distinct(list_concat(w.fenced, q.blocks)) END,
        CASE WHEN n.f > 60 OR n.bad OR q.kind = 'bind' OR n.r > 25 THEN w.required ELSE list_distinct(list_concat(w.required, q.blocks)) END,
        CASE WHEN n.f > 60 THEN 'block fence capacity exhausted' WHEN q.kind = 'require' AND NOT n.bad AND n.r > 25 THEN 'replica requirement capacity exhausted' END
    FROM w JOIN q ON q.i = w.i + 1, LATERAL (SELECT len(list_distinct(list_concat(w.fenced, q.blocks))) AS f, len(list_distinct(list_concat(w.required, q.blocks))) AS r, q.kind = 'require' AND q.replicas NOT BETWEEN 2 AND 16 AS bad) n)
SELECT log_index, reason FROM w WHERE reason IS NOT NULL""")
def capacity_rejections(spark, d) -> DataFrame:
    """The log under limits of 25 required and 60 fenced blocks, with ids of a wider range."""
    return G.capacity_rejections(I.log(spark, d), 25, 60)


def _snapshot(spark, d) -> tuple[G.State, DataFrame]:
    """A state in which every rule is broken by some rows."""
    log = I.log(spark, d)
    state = G.materialize(log, I.ACTIVATED_AT)
    e = F.col("event_id")
    events = I.table(spark, d, "events")
    state.requirements = events.select(e.cast("string").alias("block_id"), (1 + e % 17).cast("int").alias("replicas"))
    state.fences = events.select(e.cast("string").alias("block_id"), e.alias("log_index"))
    state.revisions = events.groupBy((e % 131).cast("string").alias("key")).agg(F.count("*").alias("revision"))
    rows = I.leases(spark, d).withColumn("e", F.col("created_at"))
    e = F.col("e")
    leases = rows.withColumns(
        {
            "blocks": F.when(e % 13 == 0, F.array().cast("array<string>")).otherwise(F.col("blocks")),
            "cancelled_at": F.when(e % 17 == 0, e - 1).when(e % 19 == 0, e + 1).otherwise(F.col("cancelled_at")),
            "expired_at": F.when(e % 23 == 0, e + 3).otherwise(F.col("expired_at")),
            "committed_revision": F.when(F.col("committed_key").isNotNull(), e % 4000),
            "generation": F.when(e % 29 == 0, 0).otherwise(F.col("generation")),
        }
    )
    return state, leases.drop("e")


SNAPSHOT = f"""{I.LOG}, rev AS (SELECT CAST(event_id % 131 AS VARCHAR) AS key, count(*) AS revision FROM events GROUP BY 1),
l0 AS (SELECT event_id AS e, lpad(CAST(event_id AS VARCHAR), 12, '0') AS lease, CAST(user_id AS VARCHAR) AS agent, event_id % 5 = 0 AS done, event_id % 7 = 0 AS stopped FROM events WHERE event_type = 'view'),
l AS (SELECT e, lease, agent, CASE WHEN e % 13 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN done THEN CAST(e % 97 AS VARCHAR) END AS committed_key, e % 4000 AS committed_revision,
    CASE WHEN e % 17 = 0 THEN e - 1 WHEN e % 19 = 0 THEN e + 1 WHEN stopped AND NOT done THEN e + 1 END AS cancelled_at,
    CASE WHEN e % 23 = 0 THEN e + 3 WHEN e % 40 < 10 AND NOT done AND NOT stopped THEN e + 2 END AS expired_at, CASE WHEN e % 29 = 0 THEN 0 ELSE 1 END AS generation, e % 40 AS deadline FROM l0)"""


@query(f"""WITH {SNAPSHOT}
SELECT 'replicas_out_of_range' AS rule, CAST(event_id AS VARCHAR) AS subject FROM events WHERE 1 + event_id % 17 NOT BETWEEN 2 AND 16
UNION ALL SELECT 'fence_after_last_entry', CAST(event_id AS VARCHAR) FROM events WHERE event_id > 900
UNION ALL SELECT 'revision_without_binding', key FROM rev WHERE key NOT IN (SELECT key FROM bindings)
UNION ALL SELECT 'owner_not_registered', lease FROM l WHERE agent NOT IN (SELECT agent FROM agents)
UNION ALL SELECT 'ended_before_it_began', lease FROM l WHERE cancelled_at < e OR expired_at < e
UNION ALL SELECT 'two_ends', lease FROM l WHERE committed_key IS NOT NULL AND (cancelled_at IS NOT NULL OR expired_at IS NOT NULL)
UNION ALL SELECT 'cancelled_and_expired', lease FROM l WHERE cancelled_at IS NOT NULL AND expired_at IS NOT NULL
UNION ALL SELECT 'block_count', lease FROM l WHERE n = 0
UNION ALL SELECT 'time_to_live', lease FROM l WHERE generation < 1 OR deadline - 5 > 20
UNION ALL SELECT 'marked_before_deadline', lease FROM l WHERE expired_at IS NOT NULL AND deadline > 20
UNION ALL SELECT 'revision_not_raised', lease FROM l LEFT JOIN rev ON rev.key = committed_key WHERE committed_key IS NOT NULL AND NOT coalesce(revision > committed_revision, FALSE)
UNION ALL SELECT 'requirement_capacity', CAST(count(*) AS VARCHAR) FROM events HAVING count(*) > 16384
UNION ALL SELECT 'lease_capacity', CAST(count(*) AS VARCHAR) FROM l HAVING count(*) > 4096""")
def snapshot_violations(spark, d) -> DataFrame:
    state, leases = _snapshot(spark, d)
    return X.snapshot_violations(state, leases, 900, I.CLOCK)


@query("""WITH RECURSIVE o AS (SELECT event_id AS t, CAST(event_id % 53 AS VARCHAR) AS block_id, user_id AS node, CASE WHEN event_type <> 'error' THEN 'g' || (event_id // 2000) END AS generation FROM events),
ch AS (SELECT t, node, generation FROM (SELECT *, lag(generation) OVER (PARTITION BY node ORDER BY t) AS old FROM o WHERE generation IS NOT NULL) WHERE old <> generation),
b AS (SELECT DISTINCT block_id FROM o WHERE CAST(block_id AS INTEGER) % 4 > 0),
s AS (SELECT t, 0 AS step, block_id, node, generation FROM ch, b UNION ALL SELECT t, 1, block_id, node, generation FROM o WHERE block_id IN (SELECT block_id FROM b)),
q AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY t, step) AS i FROM s),
w AS (SELECT block_id, 0::BIGINT AS i, []::STRUCT(node BIGINT, generation VARCHAR)[] AS held FROM b
    UNION ALL SELECT w.block_id, q.i, CASE WHEN q.step = 0 THEN list_filter(w.held, lambda x: NOT (x.node = q.node AND x.generation <> q.generation))
        WHEN q.generation IS NULL THEN list_filter(w.held, lambda x: x.node <> q.node)
        WHEN len(list_filter(w.held, lambda x: x.node = q.node)) > 0 THEN list_transform(w.held, lambda x: CASE WHEN x.node = q.node THEN {'node': q.node, 'generation': q.generation} ELSE x END)
        WHEN len(w.held) >= 16 THEN list_append(list_sort(w.held)[2:], {'node': q.node, 'generation': q.generation})
        ELSE list_append(w.held, {'node': q.node, 'generation': q.generation}) END
    FROM w JOIN q ON q.block_id = w.block_id AND q.i = w.i + 1),
e AS (SELECT block_id, arg_max(held, i) AS held FROM w GROUP BY block_id)
SELECT block_id, h.node, h.generation FROM (SELECT block_id, unnest(held) AS h FROM e)""")
def location_observation(spark, d) -> DataFrame:
    """Blocks of which every fourth has no requirement, seen by more nodes than a block may name, whose generations change."""
    e = F.col("event_id")
    seen = I.table(spark, d, "events").select(e.alias("at"), (e % 53).cast("string").alias("block_id"), F.col("user_id").cast("bigint").alias("node"), F.when(F.col("event_type") != "error", F.concat(F.lit("g"), F.floor(e / 2000).cast("string"))).alias("generation"))
    return R.observe_locations(seen, spark.range(1, 53).where("id % 4 > 0").select(F.col("id").cast("string").alias("block_id")))


# Stats of all sections, and every metric


STATS = f"""{I.LOG}, {I.INDEX}, {I.LEASES},
m AS (SELECT s.*, block_id IN (SELECT block_id FROM stored) AS live FROM sized s), dead AS (SELECT segment, count(*) FILTER (NOT live) AS gone, CAST(coalesce(sum(record_len) FILTER (NOT live), 0) AS BIGINT) AS freed FROM m WHERE segment < (SELECT max(segment) FROM m) GROUP BY segment HAVING count(*) FILTER (NOT live) > 0),
stats AS (SELECT (SELECT count(*) FROM sized) AS blocks, (SELECT count(DISTINCT segment) FROM sized) AS segments, (SELECT CAST(sum(record_len) AS BIGINT) FROM sized) AS disk_bytes,
    (SELECT count(*) FROM stored) AS warm_blocks, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT block_id, any_value(n) AS n FROM docs WHERE lang = 'en' GROUP BY 1)) AS warm_bytes, 1073741824 AS warm_budget_bytes,
    (SELECT count(*) FROM refs WHERE refs >= 6) AS pinned_blocks, (SELECT 4096 * count(*) FROM refs WHERE refs >= 6) AS pinned_bytes,
    (SELECT count(*) FROM events WHERE event_type = 'view') AS warm_hits_total, (SELECT count(*) FROM events WHERE event_type = 'click') AS warm_misses_total,
    (SELECT count(*) FROM dead) AS gc_runs_total, (SELECT CAST(coalesce(sum(gone), 0) AS BIGINT) FROM dead) AS gc_blocks_dropped_total, (SELECT CAST(coalesce(sum(freed), 0) AS BIGINT) FROM dead) AS gc_bytes_reclaimed_total,
    1 AS log_term, (SELECT max(event_id) FROM events) AS log_last_index, (SELECT max(log_index) FROM log WHERE kind <> 'blank') AS log_applied_index,
    (SELECT count(*) FROM agents) AS agents, (SELECT count(*) FROM bindings) AS bindings, (SELECT count(*) FROM leases) AS leases,
    (SELECT count(*) FROM leases WHERE status = 'pending') AS pending, (SELECT count(*) FROM leases WHERE status = 'committed') AS committed, (SELECT count(*) FROM leases WHERE status = 'cancelled') AS cancelled, (SELECT count(*) FROM leases WHERE status = 'expired') AS expired,
    (SELECT count(*) FROM needs) AS required_blocks, (SELECT count(*) FROM damaged WHERE lang NOT IN ('de', 'es')) AS intact, (SELECT count(*) FROM damaged WHERE lang = 'de') AS corrupt, (SELECT count(*) FROM damaged WHERE lang = 'es') AS unreadable,
    (SELECT count(*) FROM fences) AS guarded_blocks)"""


def _stats(spark, d) -> DataFrame:
    """A row of one struct a section."""
    log = I.log(spark, d)
    events = I.table(spark, d, "events")
    bound = G.bindings(log)
    shared = R.shared_blocks(G.block_refs(bound), 6)
    warm = I.stored(spark, d)
    gc = B.compact_stats(I.index(spark, d), warm)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    counts = R.lease_counts(I.leases(spark, d), F.lit(I.CLOCK))
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return R.stats_payload(
        {
            "data": B.store_stats(I.index(spark, d)),
            "tier": warm.agg(F.count("*").alias("warm_blocks"), total(F.length("payload")).alias("warm_bytes")),
            "pins": shared.agg(F.count("*").alias("pinned_blocks"), (F.count("*") * 4096).alias("pinned_bytes")),
            "reads": events.agg(kind("view").alias("warm_hits_total"), kind("click").alias("warm_misses_total"), F.max("event_id").alias("log_last_index")),
            "log": log.where("kind <> 'blank'").agg(F.max("log_index").alias("log_applied_index"), F.lit(1).cast("bigint").alias("log_term")),
            "gc": gc.agg(F.count("*").alias("gc_runs_total"), total("blocks_dropped").alias("gc_blocks_dropped_total"), total("bytes_reclaimed").alias("gc_bytes_reclaimed_total")),
            "agents": G.agents(log).agg(F.count("*").alias("agents")),
            "bindings": bound.agg(F.count("*").alias("bindings")),
            "leases": counts.select(F.col("total").alias("leases"), "pending", "committed", "cancelled", "expired"),
            "repair": G.replica_requirements(log).agg(F.count("*").alias("required_blocks")),
            "scrub": B.verify_all(I.damaged_store(spark, d).where("lang is not null")).select("intact", "corrupt", "unreadable"),
            "retention": J.retention_snapshot(J.guards(G.block_fences(log).withColumnRenamed("log_index", "sequence")), 0).select("guarded_blocks"),
        }
    )


def _flat(spark, d) -> DataFrame:
    flat = _stats(spark, d).select("data.blocks", "data.segments", F.col("data.bytes").alias("disk_bytes"), "tier.*", F.lit(1 << 30).cast("bigint").alias("warm_budget_bytes"), "pins.*", "reads.*", "gc.*", "log.*", "agents.*", "bindings.*", "leases.*", "repair.*", "scrub.*", "retention.*")
    return flat


@query(f"WITH {STATS} SELECT * FROM stats")
def stats_payload(spark, d) -> DataFrame:
    return _flat(spark, d)


def _line_rows() -> str:
    rows = ", ".join(f"({i}, '{name}', '{kind}', '{text}', (SELECT {name} FROM stats))" for i, (name, kind, text) in enumerate(M.METRICS))
    return f"SELECT unnest([{rows}]) AS m"


@query(f"""WITH {STATS}, s AS ({_line_rows()})
SELECT m[1] * 3 + i AS position, CASE i WHEN 0 THEN '# HELP engine_' || m[2] || ' ' || m[4] WHEN 1 THEN '# TYPE engine_' || m[2] || ' ' || m[3] ELSE 'engine_' || m[2] || ' ' || m[5] END AS line FROM s, (SELECT unnest([0, 1, 2]) AS i)""")
def prometheus_lines(spark, d) -> DataFrame:
    """Every metric."""
    return M.metric_lines(_flat(spark, d))


@query(f"""WITH {I.LOG}, {I.LEASES}, {I.BLOCKS}, w AS (SELECT DISTINCT block_id FROM (SELECT unnest(blocks) AS block_id FROM log)),
held AS (SELECT block_id, count(*) FILTER (status = 'pending') AS pending FROM (SELECT unnest(list_distinct(blocks)) AS block_id, status FROM leases) GROUP BY block_id),
g AS (SELECT block_id, max(log_index) AS local_generation FROM (SELECT unnest(blocks) AS block_id, log_index FROM log WHERE log_index % 3 = 0) GROUP BY block_id)
SELECT block_id, coalesce(refs, 0) AS binding_references, coalesce(replicas, 0) AS required_replicas, f.log_index AS block_reference_fence, coalesce(pending, 0) AS pending, local_generation, local_generation IS NOT NULL AS guarded,
    CASE WHEN CAST(block_id AS INTEGER) % 5 = 0 THEN 'not_found' WHEN CAST(block_id AS INTEGER) % 7 = 0 THEN 'corrupt' ELSE 'ok' END AS presence
FROM w LEFT JOIN refs USING (block_id) LEFT JOIN needs USING (block_id) LEFT JOIN fences f USING (block_id) LEFT JOIN held USING (block_id) LEFT JOIN g USING (block_id)""")
def reclamation_observation(spark, d) -> DataFrame:
    """What is known of every block that the log names: state, local guard and presence; nothing unknown is read as harmless."""
    log = I.log(spark, d)
    s = G.materialize(log, I.ACTIVATED_AT)
    wanted = log.select(F.explode("blocks").alias("block_id")).distinct()
    guards = J.guards(log.where("log_index % 3 = 0").select(F.col("log_index").alias("sequence"), F.explode("blocks").alias("block_id")))
    n = F.col("block_id").cast("int")
    presence = wanted.select("block_id", F.when(n % 5 == 0, "not_found").when(n % 7 == 0, "corrupt").otherwise("ok").alias("status"))
    seen = R.reclamation_observation(wanted, s.refs, s.requirements, s.fences, R.lease_status(I.leases(spark, d), F.lit(I.CLOCK)), guards, presence)
    return seen.select("block_id", "binding_references", "required_replicas", "block_reference_fence", "pending", "local_generation", "guarded", "presence")
