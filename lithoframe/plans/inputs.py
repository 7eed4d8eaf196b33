"""Objects of the engine derived from the driver's tables, in Spark and, as CTE texts, in SQL.

log: each event is an entry at log_index = event_id. streams: a user's events in order are its token stream.
stored: documents in English count as stored already; German ones are damaged in the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H

TOKENS = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
KINDS = {"signup": "register", "click": "bind", "purchase": "require"}
CHUNK = 2
CLOCK = 20
BINDERS = ("click", "view")  # users whose stream starts so have bound their chains


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cases(column: str, names: dict, other) -> F.Column:
    out = F.lit(other)
    for k, v in names.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def log(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    k = e % 97
    text = lambda c: c.cast("string")
    return table(spark, d, "events").select(
        e.alias("log_index"),
        F.lit(0).cast("bigint").alias("sub"),
        _cases("event_type", KINDS, "blank").alias("kind"),
        text(F.col("user_id")).alias("agent"),
        F.concat(F.lit("agent "), text(e)).alias("display_name"),
        text(k).alias("key"),
        F.array(text(e % 53), text(e % 31), text(e % 53)).alias("blocks"),
        F.when(k > 0, text(F.floor(F.greatest(k - e % 3, F.lit(0)) / 2))).alias("parent"),
        (2 + e % 15).cast("int").alias("replicas"),
    )


LOG = """log AS (SELECT event_id AS log_index, CAST(user_id AS VARCHAR) AS agent, 'agent ' || event_id AS display_name,
    CASE event_type WHEN 'signup' THEN 'register' WHEN 'click' THEN 'bind' WHEN 'purchase' THEN 'require' ELSE 'blank' END AS kind,
    CAST(event_id % 97 AS VARCHAR) AS key,
    CASE WHEN event_id % 97 > 0 THEN CAST(greatest(event_id % 97 - event_id % 3, 0) // 2 AS VARCHAR) END AS parent,
    [CAST(event_id % 53 AS VARCHAR), CAST(event_id % 31 AS VARCHAR), CAST(event_id % 53 AS VARCHAR)] AS blocks,
    2 + event_id % 15 AS replicas FROM events),
binds AS (SELECT * FROM log WHERE kind = 'bind'),
bindings AS (SELECT key, arg_max(agent, log_index) AS agent, arg_max(blocks, log_index) AS blocks, max(log_index) AS log_index FROM binds GROUP BY key),
edges AS (SELECT parent AS parent_key, key AS child_key, min(log_index) AS first_log_index, max(log_index) AS last_log_index FROM binds WHERE parent IS NOT NULL GROUP BY ALL),
refs AS (SELECT block_id, count(*) AS refs FROM (SELECT unnest(blocks) AS block_id FROM bindings) GROUP BY block_id),
needs AS (SELECT block_id, max(replicas) AS replicas FROM (SELECT unnest(blocks) AS block_id, replicas FROM log WHERE kind = 'require') GROUP BY block_id),
agents AS (SELECT agent, arg_max(display_name, log_index) AS display_name, max(log_index) AS registered_at FROM log WHERE kind = 'register' GROUP BY agent),
revisions AS (SELECT key, count(*) AS revision FROM binds WHERE log_index > 1000 GROUP BY key),
touched AS (SELECT log_index, unnest(list_concat(blocks, coalesce(lag(blocks) OVER (PARTITION BY key ORDER BY log_index), []))) AS block_id FROM binds
    UNION ALL SELECT log_index, unnest(blocks) FROM log WHERE kind = 'require'),
fences AS (SELECT block_id, max(log_index) AS log_index FROM touched GROUP BY block_id),
parents AS (SELECT child_key, arg_max(parent_key, (last_log_index, parent_key)) AS parent_key FROM edges GROUP BY child_key)"""
ACTIVATED_AT = 1000


def leases(spark: SparkSession, d: str) -> DataFrame:
    """Views as leases in all four states."""
    e = F.col("event_id")
    rows = table(spark, d, "events").where("event_type = 'view'")
    done, stopped = e % 5 == 0, e % 7 == 0
    return rows.select(
        F.lpad(e.cast("string"), 12, "0").alias("lease"),
        F.col("user_id").cast("string").alias("agent"),
        F.array((e % 53).cast("string"), (e % 11).cast("string")).alias("blocks"),
        e.alias("created_at"),
        F.when(done, (e % 97).cast("string")).alias("committed_key"),
        F.when(done, F.lit(0).cast("bigint")).alias("committed_revision"),
        F.when(stopped & ~done, e + 1).alias("cancelled_at"),
        F.when((e % 40 < 10) & ~done & ~stopped, e + 2).alias("expired_at"),
        F.lit(1).cast("bigint").alias("generation"),
        (e % 40).alias("deadline_tick"),
        F.lit(5).cast("bigint").alias("ttl_ticks"),
    )


LEASES = """leases AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS lease, [CAST(event_id % 53 AS VARCHAR), CAST(event_id % 11 AS VARCHAR)] AS blocks,
    CASE WHEN event_id % 5 = 0 THEN 'committed' WHEN event_id % 7 = 0 THEN 'cancelled' WHEN event_id % 40 <= 20 THEN 'expired' ELSE 'pending' END AS status,
    CASE WHEN event_id % 40 < 10 AND event_id % 5 <> 0 AND event_id % 7 <> 0 THEN event_id + 2 END AS expired_at,
    event_id % 40 AS deadline_tick FROM events WHERE event_type = 'view')"""


def payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.encode("text", "UTF-8").alias("payload"), "lang", "source")


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The English documents as a store."""
    return payloads(spark, d).where("lang = 'en'").select(H.block_id(F.col("payload")).alias("block_id"), "payload").dropDuplicates(["block_id"])


def damaged_store(spark: SparkSession, d: str) -> DataFrame:
    """All documents as a store in which German ones have a byte too many and Spanish ones can't be read.

    Of copies in several languages the first that names one decides, as any_value() does over the table in order.
    lang is null if no copy names one; such a text is whole.
    """
    p = payloads(spark, d).withColumn("block_id", H.block_id(F.col("payload")))
    first = F.min(F.when(F.col("lang").isNotNull(), F.struct("pos", "lang")))["lang"]
    p = p.groupBy("block_id").agg(F.any_value("payload").alias("payload"), first.alias("lang"))
    return p.select("block_id", F.when(F.col("lang") == "de", F.concat("payload", F.encode(F.lit("x"), "UTF-8"))).when(~F.col("lang").eqNullSafe("es"), F.col("payload")).alias("payload"), "lang")


BLOCKS = """docs AS (SELECT doc_id AS pos, sha256(text) AS block_id, octet_length(encode(text)) AS n, lang, source FROM documents),
stored AS (SELECT DISTINCT block_id FROM docs WHERE lang = 'en'),
damaged AS (SELECT block_id, any_value(n) AS n, any_value(lang) AS lang FROM docs GROUP BY block_id)"""


def index(spark: SparkSession, d: str) -> DataFrame:
    """A location for each distinct document: its source's number is the segment."""
    p = payloads(spark, d).withColumn("block_id", H.block_id(F.col("payload")))
    at = p.select("block_id", F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("segment"), F.col("pos").alias("offset"), F.length("payload").cast("bigint").alias("payload_len"))
    return at.groupBy("block_id").agg(F.max(F.struct("segment", "offset", "payload_len")).alias("l")).select("block_id", "l.*")


INDEX = BLOCKS + """,
located AS (SELECT block_id, unnest(max(struct_pack(segment := CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER), place := pos, payload_len := n))) FROM docs GROUP BY block_id),
sized AS (SELECT *, CAST(ceil((payload_len + 64) / 4096.0) * 4096 AS BIGINT) AS record_len FROM located)"""


def streams(spark: SparkSession, d: str) -> DataFrame:
    """user_id, tokens (in order), first (the type of the first event)."""
    e = table(spark, d, "events")
    listed = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", _cases("event_type", TOKENS, -1).cast("bigint").alias("token"), "event_type"))).alias("s"))
    return listed.select("user_id", F.col("s.token").alias("tokens"), F.col("s")[0]["event_type"].alias("first"))


def chains(spark: SparkSession, d: str) -> DataFrame:
    """lookup_id, depth, key, first."""
    keys = streams(spark, d).select(F.col("user_id").alias("lookup_id"), "first", H.chain_hashes(H.chunk_tokens(F.col("tokens"), CHUNK)).alias("keys"))
    return keys.select("lookup_id", "first", F.posexplode("keys").alias("depth", "key"))


def chain_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Keys that the binders' chains have bound, the least user owning; a key's blocks name its depth."""
    c = chains(spark, d).where(F.col("first").isin(*BINDERS))
    return c.groupBy("key").agg(F.min("lookup_id").cast("string").alias("agent"), F.max("depth").alias("depth")).select("key", "agent", F.array_append(F.transform(F.sequence(F.lit(0), F.col("depth")), lambda i: F.concat(F.lit("b"), i.cast("string"))), F.col("agent")).alias("blocks"))


CHAINS = """RECURSIVE ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS token, event_type FROM events),
firsts AS (SELECT user_id, event_type AS first FROM ev WHERE i = 0),
chunked AS (SELECT user_id, i // 2 AS depth, string_agg(printf('%02x000000', token), '' ORDER BY i) AS hex, string_agg(CAST(token AS VARCHAR), ' ' ORDER BY i) AS tokens
    FROM ev GROUP BY user_id, i // 2 HAVING count(*) = 2),
walk AS (SELECT user_id, depth, sha256(unhex(hex)) AS key FROM chunked WHERE depth = 0
    UNION ALL SELECT w.user_id, c.depth, sha256(unhex(w.key || c.hex)) FROM walk w JOIN chunked c ON c.user_id = w.user_id AND c.depth = w.depth + 1),
chains AS (SELECT user_id AS lookup_id, depth, key, first FROM walk JOIN firsts USING (user_id)),
bound AS (SELECT key, CAST(min(lookup_id) AS VARCHAR) AS agent, max(depth) AS depth FROM chains WHERE first IN ('click', 'view') GROUP BY key),
bound_blocks AS (SELECT key, agent, list_append(list_transform(range(0, depth + 1), lambda i: 'b' || i), agent) AS blocks FROM bound),
gaps AS (SELECT lookup_id, coalesce(min(CASE WHEN b.key IS NULL THEN c.depth END), max(c.depth) + 1) - 1 AS d FROM chains c LEFT JOIN bound b USING (key) GROUP BY lookup_id),
hits AS (SELECT lookup_id, CASE WHEN d >= 0 THEN d END AS hit_depth FROM gaps),
found AS (SELECT h.lookup_id, h.hit_depth, c.key, coalesce(b.blocks, []) AS blocks FROM hits h
    LEFT JOIN chains c ON c.lookup_id = h.lookup_id AND c.depth = h.hit_depth LEFT JOIN bound_blocks b ON b.key = c.key)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("index"), "role", F.col("text").alias("content"))


HISTORY = """RECURSIVE turns AS (SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS depth, role, text AS content,
    sha256(role || chr(31) || text || chr(31) || turn) AS block_id FROM conversations),
walk AS (SELECT session, 0 AS depth, sha256(CAST(session AS VARCHAR)) AS key, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS block_id, CAST([] AS VARCHAR[]) AS ids FROM (SELECT DISTINCT session FROM turns)
    UNION ALL SELECT w.session, t.depth, sha256(unhex(w.key || t.block_id)), w.key, t.block_id, list_append(w.ids, t.block_id) FROM walk w JOIN turns t ON t.session = w.session AND t.depth = w.depth + 1),
chain AS (SELECT session, depth, key, parent, block_id, CASE WHEN depth = 0 THEN [(SELECT block_id FROM turns t WHERE t.session = walk.session AND t.depth = 1)] ELSE ids END AS blocks FROM walk)"""
