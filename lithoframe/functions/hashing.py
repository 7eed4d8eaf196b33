"""Content ids, chained prefix keys and the canonical byte strings that agents sign, as column expressions.

Ids are lowercase hex strings of 32 bytes. SHA-256 is built in and the default; functions.blake3 has the other
algorithm for stores that use it. Everything here stays inside whole-stage codegen or higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_TOKENS = 256
PAGE = 4096  # records are padded to pages
HEADER = 64

# Domain prefixes of signed messages, each closed by a zero byte; fixed values.
REGISTER = "KLPK/reg/v1"
BIND = "KLPK/bind/v1"
CHAIN = "KLPK/chain/v1"
LEASE_BEGIN = "KLPK/lease/begin/v1"
LEASE_CANCEL = "KLPK/lease/cancel/v1"
LEASE_RENEW = "KLPK/lease/renew/v1"
LEASE_COMMIT = "KLPK/lease/commit/v1"


def block_id(payload: Column) -> Column:
    return F.sha2(payload, 256)


def verify(id_: Column, payload: Column) -> Column:
    """Null-safe: a missing payload does not verify."""
    return F.coalesce(block_id(payload) == id_, F.lit(False))


def parse_id(text: Column) -> Column:
    """Canonical lowercase id, null unless the text is hex of exactly 32 bytes."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.lower(text))


def valid_generation(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def little_endian(value: Column, n: int) -> Column:
    """value in n bytes, least significant first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * n, "0")
    return F.unhex(F.concat_ws("", F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1)))))


def le32(value: Column) -> Column:
    return little_endian(value, 4)


def le64(value: Column) -> Column:
    return little_endian(value, 8)


def token_bytes(tokens: Column) -> Column:
    """Tokens as one string of little-endian 32-bit words."""
    return F.unhex(F.array_join(F.transform(tokens, lambda t: F.concat_ws("", F.reverse(F.regexp_extract_all(F.lpad(F.hex(t.cast("bigint")), 8, "0"), F.lit("(..)"), F.lit(1))))), ""))


def root_hash(tokens: Column) -> Column:
    return F.sha2(token_bytes(tokens), 256)


def extend_hash(parent: Column, tokens: Column) -> Column:
    return F.sha2(F.concat(F.unhex(parent), token_bytes(tokens)), 256)


def cache_key(fingerprint: Column, prefix_hash: Column) -> Column:
    return F.struct(fingerprint.alias("fingerprint"), prefix_hash.alias("prefix_hash"))


def make_key(fingerprint: Column, parent: Column, tokens: Column) -> Column:
    """Root key of the fingerprint, or where there is a parent its extension, which keeps the parent's fingerprint."""
    return F.when(parent.isNotNull(), cache_key(parent["fingerprint"], extend_hash(parent["prefix_hash"], tokens))).otherwise(cache_key(fingerprint, root_hash(tokens)))


def chunk_tokens(tokens: Column, size: int = CHUNK_TOKENS) -> Column:
    """Complete chunks only; a trailing partial chunk is dropped."""
    n = F.floor(F.size(tokens) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(tokens, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<bigint>>"))


def chain_hashes(chunks: Column) -> Column:
    """The key of every prefix of the chunks, shortest first: a fold, since each hash takes in the one before."""
    return F.aggregate(chunks, F.array().cast("array<string>"), lambda acc, x: F.array_append(acc, F.sha2(F.concat(F.unhex(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))), token_bytes(x)), 256)))


def binding_key(key: Column) -> Column:
    return F.to_json(key)


def record_length(payload_len: Column) -> Column:
    return (F.ceil((payload_len + HEADER) / F.lit(PAGE)) * PAGE).cast("bigint")


def align_down(n: Column) -> Column:
    return n - n % PAGE


def align_up(n: Column) -> Column:
    return align_down(n + (PAGE - 1))


def parse_replicas(text: Column) -> Column:
    """1 where absent, null (an error) unless a whole number from 1 to 16."""
    n = F.expr("null").cast("int")
    n = F.when(text.rlike(r"^\d{1,2}$"), text.cast("int"))
    return F.when(text.isNull(), 1).when(n.between(1, 16), n)


def valid_binding(key: Column, parent: Column) -> Column:
    """Fingerprint fields of 1024 bytes at most, and a parent of the same fingerprint."""
    small = F.lit(True)
    for part in ("model_id", "tokenizer_hash", "kv_layout"):
        small = small & (F.octet_length(key["fingerprint"][part]) <= 1024)
    return F.coalesce(small & (parent.isNull() | (parent["fingerprint"] == key["fingerprint"])), F.lit(False))


def _domain(name: str) -> Column:
    return F.encode(F.lit(name + "\0"), "UTF-8")


def _text(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def _ids(blocks: Column) -> Column:
    return F.unhex(F.array_join(blocks, ""))


def _link(key: Column, blocks: Column, parent: Column) -> Column:
    names = [x for part in ("model_id", "tokenizer_hash", "kv_layout") for x in (_text(key["fingerprint"][part]), F.lit(b"\0"))]
    up = F.when(parent.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), F.unhex(parent["prefix_hash"])))
    return F.concat(*names, F.unhex(key["prefix_hash"]), le32(F.size(blocks)), _ids(blocks), up)


def register_message(agent: Column, display_name: Column) -> Column:
    return F.concat(_domain(REGISTER), F.unhex(agent), _text(display_name))


def bind_message(agent: Column, key: Column, blocks: Column, parent: Column) -> Column:
    return F.concat(_domain(BIND), F.unhex(agent), _link(key, blocks, parent))


def chain_message(agent: Column, links: Column) -> Column:
    """links: array of struct(key, blocks, parent)."""
    body = F.unhex(F.array_join(F.transform(links, lambda x: F.hex(_link(x["key"], x["blocks"], x["parent"]))), ""))
    return F.concat(_domain(CHAIN), F.unhex(agent), le32(F.size(links)), body)


def lease_begin_message(agent: Column, lease: Column, blocks: Column) -> Column:
    return F.concat(_domain(LEASE_BEGIN), F.unhex(agent), F.unhex(lease), le64(F.size(blocks)), _ids(blocks))


def lease_cancel_message(agent: Column, lease: Column) -> Column:
    return F.concat(_domain(LEASE_CANCEL), F.unhex(agent), F.unhex(lease))


def lease_renew_message(agent: Column, lease: Column, expected_generation: Column, ttl_ticks: Column) -> Column:
    return F.concat(_domain(LEASE_RENEW), F.unhex(agent), F.unhex(lease), le64(expected_generation), le64(ttl_ticks))


def _sized_key(key: Column) -> Column:
    parts = [x for part in ("model_id", "tokenizer_hash", "kv_layout") for x in (le64(F.octet_length(key["fingerprint"][part])), _text(key["fingerprint"][part]))]
    return F.concat(*parts, F.unhex(key["prefix_hash"]))


def lease_commit_message(agent: Column, lease: Column, key: Column, blocks: Column, parent: Column, expected_revision: Column) -> Column:
    up = F.when(parent.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), _sized_key(parent)))
    return F.concat(_domain(LEASE_COMMIT), F.unhex(agent), F.unhex(lease), le64(expected_revision), _sized_key(key), le64(F.size(blocks)), _ids(blocks), up)


def short_id(id_: Column, n: int = 8) -> Column:
    return F.substring(id_, 1, n)


def format_bytes(n: Column) -> Column:
    """`512 B`, then one decimal in units of 1024."""
    out = F.format_string("%d B", n.cast("bigint"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {unit}", n / float(1024**i))).otherwise(out)
    return out
