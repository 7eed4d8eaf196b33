"""Golden vectors and algebra of ids, keys, messages and signatures."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from lithoframe.functions import blake3, ed25519
from lithoframe.functions import hashing as H

ABC = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_ids(spark):
    r = one(spark, H.block_id(F.lit("abc").cast("binary")), H.verify(F.lit(ABC), F.lit(b"abc")), H.verify(F.lit(ABC), F.lit(b"abd")), H.verify(F.lit(ABC), F.lit(None).cast("binary")))
    assert list(r) == [ABC, True, False, False]
    r = one(spark, H.parse_id(F.lit(ABC.upper())), H.parse_id(F.lit("not-a-valid-hex-id")), H.parse_id(F.lit(ABC + "0")))
    assert list(r) == [ABC, None, None]


def test_blake3_vectors():
    assert blake3.digest(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert blake3.digest(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 5000, 16385])
def test_blake3_agrees_with_the_jvm_class(spark, n):
    data = bytes(i % 251 for i in range(n))
    jvm = spark.sparkContext._jvm.org.apache.commons.codec.digest.Blake3
    assert blake3.digest(data) == bytes(b & 255 for b in jvm.hash(data))


def test_blake3_of_many_payloads(monkeypatch):
    payloads = [bytes(i % 251 for i in range(n)) for n in (0, 1, 64, 1023, 1024, 1025, 2048, 2049, 3 * 1024, 5000, 7 * 1024 + 1, 0, 40_000)]
    alone = [blake3.digest(p) for p in payloads]
    assert blake3.digests(payloads) == alone and blake3.digests([]) == []
    monkeypatch.setattr(blake3, "BATCH", 3000)
    assert blake3.digests(payloads) == alone


def test_blake3_column(spark):
    r = one(spark, blake3.blake3_id(F.lit(b"abc")), blake3.blake3_id(F.lit(None).cast("binary")))
    assert r[0].startswith("6437b3ac") and r[1] is None


def test_little_endian(spark):
    r = one(spark, F.hex(H.le32(F.lit(258))), F.hex(H.le32(F.lit(2**32 - 1))), F.hex(H.le64(F.lit(1))), F.hex(H.token_bytes(F.array(F.lit(1), F.lit(258)))))
    assert list(r) == ["02010000", "FFFFFFFF", "0100000000000000", "0100000002010000"]


def keys(spark, chunks):
    lists = F.array(*[F.array(*[F.lit(t).cast("bigint") for t in c]) for c in chunks])
    return one(spark, H.chain_hashes(lists))[0]


def test_chain_is_a_fold_of_hashes(spark):
    got, parent = keys(spark, [[1, 2, 3], [4, 5]]), b""
    for c, k in zip([[1, 2, 3], [4, 5]], got, strict=True):
        parent = hashlib.sha256(parent + struct.pack(f"<{len(c)}I", *c)).digest()
        assert parent.hex() == k
    assert got == keys(spark, [[1, 2, 3], [4, 5]])
    assert keys(spark, [[1, 2, 3], [4]])[1] != keys(spark, [[1, 2, 3], [5]])[1]
    assert keys(spark, [[1, 2], [3]])[1] != keys(spark, [[1], [2, 3]])[1]


def test_partial_chunks_are_dropped(spark):
    seq = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("bigint"))
    r = one(spark, F.size(H.chunk_tokens(seq(3 * 256 + 17))), F.size(H.chunk_tokens(seq(255))), F.size(H.chunk_tokens(F.array().cast("array<bigint>"))))
    assert list(r) == [3, 0, 0]


def key(model="m", prefix=ABC):
    return H.cache_key(F.struct(F.lit(model).alias("model_id"), F.lit("t").alias("tokenizer_hash"), F.lit("l").alias("kv_layout")), F.lit(prefix))


def test_keys(spark):
    none = F.lit(None).cast("struct<fingerprint:struct<model_id:string,tokenizer_hash:string,kv_layout:string>,prefix_hash:string>")
    toks = F.array(F.lit(5).cast("bigint"))
    r = one(spark, H.make_key(key()["fingerprint"], none, toks), H.make_key(key("other")["fingerprint"], key("m"), toks))
    assert r[1]["fingerprint"]["model_id"] == "m" and r[0]["prefix_hash"] != r[1]["prefix_hash"]
    r = one(spark, H.valid_binding(key(), none), H.valid_binding(key(), key("n")), H.valid_binding(key("x" * 1025), none))
    assert list(r) == [True, False, False]


def test_record_length(spark):
    assert list(one(spark, *[H.record_length(F.lit(n)) for n in (0, 4032, 4033)])) == [4096, 4096, 8192]


def test_replicas(spark):
    assert list(one(spark, *[H.parse_replicas(F.lit(x).cast("string")) for x in (None, "1", "16", "17", "0", "x", "-1")])) == [1, 1, 16, None, None, None, None]


def test_message_sizes(spark):
    none = F.lit(None).cast("struct<prefix_hash:string>")
    r = one(spark, H.register_message(F.lit(ABC), F.lit("x")), H.bind_message(F.lit(ABC), key(), F.array(F.lit(ABC)), none), H.bind_message(F.lit(ABC), key(), F.array(F.lit(ABC)), key()), H.lease_commit_message(F.lit(ABC), F.lit(ABC), key(), F.array(F.lit(ABC)), key(), F.lit(3)))
    assert len(r[0]) == 45 and bytes(r[0]).startswith(b"KLPK/reg/v1\0")
    assert len(r[1]) == 120 and len(r[2]) == 152
    sized = 3 * 8 + 3 + 32
    assert len(r[3]) == 21 + 32 + 32 + 8 + sized + 8 + 32 + 1 + sized


def test_messages_have_separate_domains(spark):
    r = one(spark, H.lease_begin_message(F.lit(ABC), F.lit(ABC), F.array(F.lit(ABC))), H.lease_cancel_message(F.lit(ABC), F.lit(ABC)), H.lease_renew_message(F.lit(ABC), F.lit(ABC), F.lit(1), F.lit(2)), H.chain_message(F.lit(ABC), F.array(F.struct(key().alias("key"), F.array(F.lit(ABC)).alias("blocks"), F.lit(None).cast("struct<prefix_hash:string>").alias("parent")))))
    assert len({bytes(x).split(b"\0")[0] for x in r}) == 4


def test_ed25519():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert ed25519.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    sig = ed25519.sign(seed, b"")
    assert sig.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    assert ed25519.verify(ed25519.public_key(seed), b"", sig)
    assert not ed25519.verify(ed25519.public_key(seed), b"x", sig)
    assert not ed25519.verify(b"\xff" * 32, b"", sig)


def test_signature_column(spark):
    seed = b"s" * 32
    sig, agent = ed25519.sign(seed, b"m").hex(), ed25519.public_key(seed).hex()
    r = one(spark, *[ed25519.signature_valid(F.lit(a), F.lit(b"m"), F.lit(s)) for a, s in ((agent, sig), (agent, "00"), ("zz", sig))])
    assert list(r) == [True, False, False]


def test_format_bytes(spark):
    assert list(one(spark, *[H.format_bytes(F.lit(n)) for n in (5, 1024, 1536, 5 << 20, 3 << 30)])) == ["5 B", "1.0 KiB", "1.5 KiB", "5.0 MiB", "3.0 GiB"]
