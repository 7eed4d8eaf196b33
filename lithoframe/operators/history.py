"""Chat histories as chains of blocks, and planning of prefix loads and saves."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType

from ..functions import hashing as H
from .prefix import longest_prefix

#: Role names on both sides; others pass inward as they are and become human outward. Fixed values.
INWARD = {"human": "user", "ai": "assistant", "system": "system"}
OUTWARD = {"user": "human", "assistant": "ai", "system": "system"}


def _mapped(role: Column, names: dict[str, str], other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, role), other)


def role_in(role: Column) -> Column:
    return _mapped(role, INWARD, role)


def role_out(role: Column) -> Column:
    return _mapped(role, OUTWARD, F.lit("human"))


def pseudo_token(payload: bytes) -> list[int]:
    """Two 32-bit numbers that stand for a payload in a chain."""
    return np.frombuffer(hashlib.blake2b(payload, digest_size=8).digest(), "<u4").tolist()


@F.pandas_udf(ArrayType(LongType()))
def pseudo_tokens(payload: pd.Series) -> pd.Series:
    return payload.map(lambda p: None if p is None else pseudo_token(bytes(p)))


@F.pandas_udf(StringType())
def turn_payload(role: pd.Series, content: pd.Series, index: pd.Series) -> pd.Series:
    """The JSON text that stores a turn, its own chain tokens included."""

    def one(r, c, i) -> str:
        turn = {"role": r, "content": c, "index": int(i)}
        turn["chain"] = pseudo_token(json.dumps(turn, separators=(",", ":")).encode())
        return json.dumps(turn, separators=(",", ":"))

    return pd.Series([one(*x) for x in zip(role, content, index, strict=True)])


def turn_blocks(turns: DataFrame) -> DataFrame:
    """turns(session, index, role, content) -> with block_id: equal turns at an equal place are one block in any session."""
    return turns.withColumn("block_id", H.block_id(F.concat_ws("\x1f", "role", "content", F.col("index").cast("string"))))


def history_chain(turns: DataFrame, cleared: int = 0) -> DataFrame:
    """turns(session, index, role, content) -> session, depth, key, parent, block_id, blocks.

    Depth 0 is the session's root, bound to its first turn; every later key extends the one before and its binding
    holds all blocks so far. A cleared history starts anew under the session's name with `#cleared`.
    """
    name = F.concat(F.col("session").cast("string"), F.lit("#cleared" * cleared))
    listed = turn_blocks(turns).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("index", "block_id"))).alias("t")).withColumn("ids", F.col("t.block_id"))
    root = F.sha2(name, 256)
    keys = F.aggregate("ids", F.array(root), lambda acc, b: F.array_append(acc, F.sha2(F.concat(F.unhex(F.element_at(acc, -1)), F.unhex(b)), 256)))
    each = listed.select("session", "ids", keys.alias("keys")).select("session", "ids", "keys", F.posexplode("keys").alias("depth", "key"))
    d = F.col("depth")
    return each.select("session", "depth", "key", F.get("keys", d - 1).alias("parent"), F.get("ids", d - 1).alias("block_id"), F.slice("ids", 1, F.greatest(d, F.lit(1))).alias("blocks"))


def replay(chain: DataFrame) -> DataFrame:
    """session, tip, turns, blocks: the end of each session's chain, found along its edges from a bound root.

    A chain's edges form a path from depth 0, so its tip is the deepest key before the first missing one.
    """
    order = Window.partitionBy("session").orderBy("depth")
    linked = chain.withColumn("ok", (F.col("depth") == 0) | (F.lag("key").over(order) == F.col("parent")))
    whole = linked.withColumn("reached", F.min("ok").over(order)).where("reached")
    tip = whole.groupBy("session").agg(F.max_by(F.struct("key", "depth", "blocks"), "depth").alias("t"))
    return tip.select("session", F.col("t.key").alias("tip"), F.col("t.depth").alias("turns"), F.when(F.col("t.depth") > 0, F.col("t.blocks")).otherwise(F.array().cast("array<string>")).alias("blocks"))


def messages(replayed: DataFrame, blocks: DataFrame) -> DataFrame:
    """replay() and blocks(block_id, role, content) -> session, position, role, content, oldest first."""
    each = replayed.select("session", F.posexplode("blocks").alias("position", "block_id"))
    return each.join(blocks.select("block_id", "role", "content").dropDuplicates(["block_id"]), "block_id").select("session", "position", "role", "content")


def turn_dedup(turns: DataFrame) -> DataFrame:
    """block_id, turns, sessions: how many turns share a stored block."""
    return turn_blocks(turns).groupBy("block_id").agg(F.count("*").alias("turns"), F.countDistinct("session").alias("sessions"))


def matched_tokens(requests: DataFrame, chains: DataFrame, bindings: DataFrame, chunk: int = H.CHUNK_TOKENS) -> DataFrame:
    """requests(lookup_id, computed) -> lookup_id, hit_depth, matched: tokens that a prefix supplies beyond those computed."""
    hits = requests.join(longest_prefix(chains, bindings), "lookup_id", "left")
    return hits.select("lookup_id", "hit_depth", F.greatest((F.coalesce("hit_depth", F.lit(-1)) + 1) * chunk - F.col("computed"), F.lit(0)).cast("bigint").alias("matched"))


def save_plan(chains: DataFrame, chunks: int) -> DataFrame:
    """lookup_id, depth, key, parent of the first chunks of each chain."""
    order = Window.partitionBy("lookup_id").orderBy("depth")
    return chains.where(F.col("depth") < chunks).select("lookup_id", "depth", "key", F.lag("key").over(order).alias("parent"))


def cumulative_bind(saved: DataFrame) -> DataFrame:
    """saved(lookup_id, depth, key, block_id) -> with blocks: binding i holds the first i + 1 blocks."""
    upto = Window.partitionBy("lookup_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return saved.select("lookup_id", "depth", "key", F.collect_list("block_id").over(upto).alias("blocks"))


def page_groups(pages: Column, block_size: int, chunk: int = H.CHUNK_TOKENS) -> Column:
    """A request's page ids in groups of a chunk's pages; a partial group is dropped."""
    return H.chunk_tokens(pages, chunk // block_size)


@F.pandas_udf(BinaryType())
def encode_pages(layers: pd.Series) -> pd.Series:
    """Pages of a chunk, layer by layer, as float32 bytes."""
    return layers.map(lambda x: None if x is None else b"".join(np.asarray(p, "<f4").tobytes() for p in x))


def decode_pages(payload: bytes, sizes: list[int]) -> list[list[float]]:
    a, ends = np.frombuffer(payload, "<f4"), np.cumsum(sizes)
    return [a[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)]
