"""Explicit schemas of the state tables; nothing is inferred."""

from __future__ import annotations

FINGERPRINT = "struct<model_id:string,tokenizer_hash:string,kv_layout:string>"
CACHE_KEY = f"struct<fingerprint:{FINGERPRINT},prefix_hash:string>"
BLOCKS = "block_id string, payload binary, payload_len bigint"
LOCATIONS = "block_id string, segment int, offset bigint, payload_len bigint"
MUTATIONS = (
    "log_index bigint, sub bigint, kind string, agent string, display_name string, key string, blocks array<string>, parent string, replicas int, "
    "lease string, expected_revision bigint, expected_generation bigint, ttl_ticks bigint, expected_tick bigint, generation bigint, deadline_tick bigint"
)
RESPONSES = "log_index bigint, status string, reason string, generation bigint, deadline_tick bigint"
LEASES = "lease string, agent string, blocks array<string>, created_at bigint, committed_key string, committed_revision bigint, cancelled_at bigint, expired_at bigint, generation bigint, deadline_tick bigint, ttl_ticks bigint, status string"
FINDINGS = "segment int, offset bigint, kind string, block_id string"

# Limits of the state machine; fixed values.
MAX_LEASES = 4096
MAX_LEASE_BLOCKS = 256
MAX_RESERVED_BLOCKS = 65536
MAX_TTL_TICKS = 86400
MAX_REQUIREMENTS = 16384
MAX_REQUIREMENT_BATCH = 4096
MAX_BLOCK_FENCES = 65536
MAX_GUARDED_BLOCKS = 1048576
REPLICAS = (2, 16)
MAX_FINGERPRINT_BYTES = 1024
