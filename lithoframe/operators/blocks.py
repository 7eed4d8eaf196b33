"""Content-addressed blocks: put, get, dedup, verification, chunk streams, compaction figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H

PIECE = 1 << 20  # bytes of a streamed piece


def identified(payloads: DataFrame, id_of=H.block_id) -> DataFrame:
    """payloads(pos, payload) with block_id and payload_len."""
    return payloads.withColumn("block_id", id_of(F.col("payload"))).withColumn("payload_len", F.length("payload").cast("bigint"))


def put_many(payloads: DataFrame, store: DataFrame, id_of=H.block_id) -> tuple[DataFrame, DataFrame]:
    """Ids in input order (pos, block_id), and the rows to append (pos, block_id, payload, payload_len): the first of each id that the store lacks.

    Appending the second frame is the commit. Ids alone meet the store, and its payloads are not read; a payload is
    fetched by its position and must hash to the id that was found there, so a null payload stores nothing.
    """
    ids = payloads.select("pos", id_of(F.col("payload")).alias("block_id"))
    given = payloads.select("pos", "payload").where("payload is not null")
    found = F.coalesce(id_of(F.col("payload")), F.lit("")).alias("block_id")  # never null, or a filter on it would hash everything once more
    first = given.groupBy(found).agg(F.min("pos").alias("pos")).join(store.select("block_id"), "block_id", "left_anti")
    fresh = given.join(first, "pos").where(id_of(F.col("payload")) == F.col("block_id"))
    return ids, fresh.select("pos", "block_id", "payload", F.length("payload").cast("bigint").alias("payload_len"))


def dedup_first(payloads: DataFrame) -> DataFrame:
    """pos, block_id, first_pos, is_first: which occurrence in the batch stores the block."""
    ids = identified(payloads).select("pos", "block_id")
    return ids.join(ids.groupBy("block_id").agg(F.min("pos").alias("first_pos")), "block_id").select("pos", "block_id", "first_pos", (F.col("pos") == F.col("first_pos")).alias("is_first"))


def get_verified(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """wanted(block_id) -> block_id, payload_len, status: ok, corrupt or not_found."""
    found = wanted.join(store.select("block_id", "payload", F.lit(True).alias("here")), "block_id", "left")
    status = F.when(F.col("here").isNull(), "not_found").when(H.verify(F.col("block_id"), F.col("payload")), "ok").otherwise("corrupt")
    return found.select("block_id", F.length("payload").cast("bigint").alias("payload_len"), status.alias("status"))


def contains(wanted: DataFrame, store: DataFrame) -> DataFrame:
    return wanted.join(store.select("block_id").distinct(), "block_id", "left_semi")


def missing(wanted: DataFrame, store: DataFrame) -> DataFrame:
    return wanted.join(store.select("block_id"), "block_id", "left_anti")


def bind_check(binds: DataFrame, store: DataFrame) -> DataFrame:
    """binds(bind_id, blocks) -> bind_id, accepted, first_missing: one missing block rejects the whole bind."""
    each = binds.select("bind_id", F.posexplode_outer("blocks").alias("at", "block_id"))
    gone = each.where(F.col("block_id").isNotNull()).join(store.select("block_id"), "block_id", "left_anti").groupBy("bind_id").agg(F.min(F.struct("at", "block_id")).alias("m"))
    return binds.select("bind_id").join(gone, "bind_id", "left").select("bind_id", F.col("m").isNull().alias("accepted"), F.col("m.block_id").alias("first_missing"))


def fetch(wanted: DataFrame, replicas: DataFrame) -> DataFrame:
    """Replicate-on-read: of replicas(block_id, priority, node, payload) the first whose bytes hash to the id; 0 is the local one."""
    good = replicas.where(H.verify(F.col("block_id"), F.col("payload")))
    best = good.groupBy("block_id").agg(F.min_by(F.struct("node", "payload", "priority"), F.struct("priority", "node")).alias("r"))
    return wanted.join(best, "block_id", "left").select("block_id", "r.node", "r.payload", (F.col("r.priority") > 0).alias("store_locally"))


def store_stats(index: DataFrame) -> DataFrame:
    """index(block_id, segment, offset, payload_len) -> blocks, segments, bytes."""
    return index.agg(F.count("*").alias("blocks"), F.countDistinct("segment").alias("segments"), F.coalesce(F.sum(H.record_length(F.col("payload_len"))), F.lit(0)).alias("bytes"))


def verify_all(store: DataFrame) -> DataFrame:
    """store(block_id, payload) -> one row: intact blocks and bytes, corrupt and unreadable ones; all blocks are looked at."""
    state = F.when(F.col("payload").isNull(), "unreadable").when(H.verify(F.col("block_id"), F.col("payload")), "intact").otherwise("corrupt")
    s = store.select("block_id", F.length("payload").cast("bigint").alias("n"), state.alias("state"))
    count = lambda k: F.count_if(F.col("state") == k).alias(k)
    return s.agg(count("intact"), count("corrupt"), count("unreadable"), F.coalesce(F.sum(F.when(F.col("state") == "intact", F.col("n"))), F.lit(0)).alias("intact_bytes"))


def damaged(store: DataFrame) -> DataFrame:
    """The corrupt and unreadable blocks themselves."""
    return store.where(~H.verify(F.col("block_id"), F.col("payload"))).select("block_id", F.when(F.col("payload").isNull(), "unreadable").otherwise("corrupt").alias("state"))


def index_of(records: DataFrame) -> DataFrame:
    """Scanned records(block_id, segment, offset, payload_len) -> one location a block: later records replace earlier ones."""
    return records.groupBy("block_id").agg(F.max(F.struct("segment", "offset", "payload_len")).alias("l")).select("block_id", "l.*")


def compact_stats(index: DataFrame, live: DataFrame) -> DataFrame:
    """What compaction against an explicit live set would do, by segment; the newest segment is never touched."""
    newest = index.agg(F.max("segment").alias("newest"))
    marked = index.join(live.select("block_id").distinct().withColumn("live", F.lit(True)), "block_id", "left")
    size = H.record_length(F.col("payload_len"))
    per = marked.groupBy("segment").agg(F.count_if(F.col("live").isNull()).alias("blocks_dropped"), F.sum(F.when(F.col("live").isNull(), size).otherwise(0)).alias("bytes_reclaimed"), F.count_if(F.col("live")).alias("blocks_kept"))
    return per.join(F.broadcast(newest), F.col("segment") < F.col("newest")).where("blocks_dropped > 0").select("segment", "blocks_dropped", "blocks_kept", "bytes_reclaimed")


def compacted(index: DataFrame, live: DataFrame) -> DataFrame:
    """Locations after compaction: live records of rewritten segments move up in offset order."""
    rewritten = compact_stats(index, live).select("segment", F.lit(True).alias("rewritten"))
    marked = index.join(live.select("block_id").distinct().withColumn("live", F.lit(True)), "block_id", "left").join(rewritten, "segment", "left").where("live or rewritten is null")
    before = Window.partitionBy("segment").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(H.record_length(F.col("payload_len"))).over(before), F.lit(0))
    return marked.withColumn("offset", F.when(F.col("rewritten"), moved).otherwise(F.col("offset"))).select("block_id", "segment", "offset", "payload_len")


def daemon_gc(*_) -> None:
    raise PermissionError("collection is refused: call compact with an explicit live set")


def to_pieces(blocks: DataFrame, size: int = PIECE) -> DataFrame:
    """blocks(block_id, payload) -> block_id, piece_no, data, last; an empty block is one empty piece."""
    n = F.length("payload")
    no = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0))))
    return blocks.select("block_id", "payload", no.alias("piece_no")).select("block_id", "piece_no", F.substring(F.col("payload"), F.col("piece_no") * size + 1, F.lit(size)).alias("data"), ((F.col("piece_no") + 1) * size >= n).alias("last"))


def from_pieces(pieces: DataFrame) -> DataFrame:
    """pieces(stream_id, seq, data, last) -> stream_id, block_no, payload (null if the stream ends inside a block)."""
    before = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.withColumn("block_no", F.coalesce(F.sum(F.col("last").cast("int")).over(before), F.lit(0)))
    whole = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda p: F.hex(p["data"])), ""))
    return numbered.groupBy("stream_id", "block_no").agg(F.when(F.bool_or("last"), whole).alias("payload"))
