"""Segment files, journals and frames."""

import json
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithoframe.functions.blake3 import digest
from lithoframe.operators import blocks as B
from lithoframe.sources import journals as J
from lithoframe.sources import segments as Z


def record(payload):
    return Z.encode_record(digest(payload), payload)


def test_record_shape():
    raw = record(b"x" * 4032)
    assert len(raw) == 4096 and len(record(b"x" * 4033)) == 8192 and raw[:4] == b"KLPK" and raw[8:16] == (4032).to_bytes(8, "little")
    assert Z.parse_header(raw[:64]) == (digest(b"x" * 4032), 4032) and Z.parse_header(b"\0" * 64) is None


def test_scan_stops_at_a_torn_tail():
    a, b = record(b"one"), record(b"two")
    assert [n for _, _, n in Z.scan(a + b)] == [3, 3]
    assert [at for _, at, _ in Z.scan(a + b[:100])] == [0] and Z.valid_end(a + b[:100]) == 4096
    assert not list(Z.scan(b"\0" * 4096 + a))


def test_scrub_sees_past_damage():
    good = record(b"one")
    flipped = bytearray(record(b"two"))
    flipped[64] ^= 1
    reserved = bytearray(record(b"three"))
    reserved[50] = 1
    longer = bytearray(record(b"four"))
    longer[8:16] = (1 << 40).to_bytes(8, "little")
    over = bytearray(record(b"five"))
    over[8:16] = ((1 << 64) - 1).to_bytes(8, "little")
    data = bytes(flipped) + bytes(reserved) + bytes(longer) + bytes(over) + b"junk".ljust(4096, b"\0") + good + b"tail"
    assert [k for _, k, _ in Z.findings(data)] == ["payload_hash_mismatch", "invalid_reserved_header", "truncated_or_invalid_length", "length_overflow", "invalid_header", None, "truncated_header"]


@pytest.mark.parametrize("batch", [1, 10_000, 1 << 22])
def test_scrub_hashes_each_record_once(monkeypatch, batch):
    monkeypatch.setattr(Z, "BATCH", batch)
    raw = [bytearray(record(bytes([i]) * (5000 * (i % 3) + 9))) for i in range(12)]
    for i in (0, 3, 4, 11):
        raw[i][64] ^= 1
    hashed = []
    hashes = lambda payloads: [hashed.append(p) or digest(p) for p in payloads]
    got = list(Z.findings(b"".join(map(bytes, raw)), hashes))
    assert len([k for _, k, _ in got if k is None]) == 8 and len([k for _, k, _ in got if k == "payload_hash_mismatch"]) == 4
    assert len(hashed) == 12


def test_overwrite_replaces_segments_and_is_finished_after_a_crash(spark, tmp_path):
    spark.dataSource.register(Z.SegmentSource)
    schema = "block_id string, payload binary, segment int, offset bigint, payload_len bigint"

    def write(payloads, mode):
        rows = spark.createDataFrame([(None, p, None, None, None) for p in payloads], schema).coalesce(1)
        rows.write.format("segments").option("path", str(tmp_path)).option("rollbytes", 4096).mode(mode).save()

    def read():
        return sorted(bytes(r.payload) for r in spark.read.format("segments").option("path", str(tmp_path)).load().collect())

    write([b"a", b"b", b"c"], "append")
    write([b"d", b"e"], "overwrite")
    write([b"f"], "append")
    assert read() == [b"d", b"e", b"f"] and not Z.segment_gaps(Z.files(spark, str(tmp_path))).count()
    (tmp_path / ".new-00000000").write_bytes(record(b"g"))  # cut off before it was decided
    assert read() == [b"d", b"e", b"f"]
    (tmp_path / ".replacing").write_text("2")  # decided, the second segment in place already
    (tmp_path / "seg-00000001.klpk").write_bytes(record(b"h"))
    assert read() == [b"g", b"h"] and sorted(p.name for p in tmp_path.iterdir() if p.suffix != ".crc") == ["seg-00000000.klpk", "seg-00000001.klpk"]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20000))
def test_arbitrary_bytes_never_break_the_readers(data):
    list(Z.scan(data))
    list(Z.findings(data))
    J.parse_frame(data)


def test_data_source_round_trip(spark, tmp_path):
    spark.dataSource.register(Z.SegmentSource)
    payloads = [bytes([i]) * 2048 for i in range(32)]
    rows = spark.createDataFrame([(None, p, None, None, None) for p in payloads], "block_id string, payload binary, segment int, offset bigint, payload_len bigint").coalesce(2)
    rows.write.format("segments").option("path", str(tmp_path)).option("rollbytes", 16384).mode("append").save()
    back = spark.read.format("segments").option("path", str(tmp_path)).load()
    assert {r.block_id: bytes(r.payload) for r in back.collect()} == {digest(p).hex(): p for p in payloads}
    files = Z.files(spark, str(tmp_path))
    assert files.count() == 8 and Z.index_records(files).count() == 32 and not Z.scrub(files).count() and not Z.segment_gaps(files).count()
    assert B.store_stats(B.index_of(Z.index_records(files))).first().bytes == 32 * 4096
    assert Z.layout_stamp(spark, str(tmp_path)).first().files == 8
    path = tmp_path / "seg-00000000.klpk"
    path.write_bytes(path.read_bytes()[:64] + b"?" + path.read_bytes()[65:])
    assert [r.kind for r in Z.scrub(Z.files(spark, str(tmp_path))).collect()] == ["payload_hash_mismatch"]


def test_roll(spark):
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate([100, 100, 9000, 100, 40000, 100])], "store string, pos long, payload_len long")
    got = [(r.segment, r.offset) for r in Z.roll(rows, 16384).orderBy("pos").collect()]
    assert got == [(0, 0), (0, 4096), (1, 0), (1, 12288), (2, 0), (3, 0)]


def test_compaction_leaves_the_newest_segment(spark):
    index = spark.createDataFrame([("a", 0, 0, 10), ("b", 0, 4096, 10), ("c", 1, 0, 10)], "block_id string, segment int, offset long, payload_len long")
    live = spark.createDataFrame([("b",)], "block_id string")
    assert [tuple(r) for r in B.compact_stats(index, live).collect()] == [(0, 1, 1, 4096)]
    assert sorted(tuple(r) for r in B.compacted(index, live).collect()) == [("b", 0, 0, 10), ("c", 1, 0, 10)]
    with pytest.raises(PermissionError):
        B.daemon_gc()


def test_put_many_and_fsck(spark):
    p = spark.createDataFrame([(0, b"fresh"), (1, b"x"), (2, b"x"), (3, b"old")], "pos long, payload binary")
    store = B.identified(spark.createDataFrame([(0, b"old")], "pos long, payload binary")).select("block_id", "payload")
    ids, fresh = B.put_many(p, store)
    assert ids.count() == 4 and sorted(bytes(r.payload) for r in fresh.collect()) == [b"fresh", b"x"]
    bad = store.withColumn("payload", F.lit(b"new"))
    assert B.verify_all(bad).first().corrupt == 1 and B.damaged(bad).count() == 1


def test_put_many_of_null_repeated_and_misplaced_payloads(spark):
    rows = [(0, None), (1, b"a"), (2, None), (3, b"b"), (3, b"a"), (4, b"b")]
    p = spark.createDataFrame(rows, "pos long, payload binary")
    ids, fresh = B.put_many(p, spark.createDataFrame([], "block_id string, payload binary"))
    assert sorted((r.pos, r.block_id is None) for r in ids.collect()) == [(0, True), (1, False), (2, True), (3, False), (3, False), (4, False)]
    got = [(r.pos, bytes(r.payload), r.block_id) for r in fresh.collect()]
    assert sorted(got) == [(1, b"a", sha256(b"a").hexdigest()), (3, b"b", sha256(b"b").hexdigest())]
    assert not B.put_many(p.limit(0), p.select(F.lit("").alias("block_id")))[1].collect()


def test_bind_check_and_pieces(spark):
    store = spark.createDataFrame([("x",)], "block_id string")
    binds = spark.createDataFrame([(1, ["x"]), (2, ["x", "y", "z"]), (3, [])], "bind_id int, blocks array<string>")
    assert {r.bind_id: (r.accepted, r.first_missing) for r in B.bind_check(binds, store).collect()} == {1: (True, None), 2: (False, "y"), 3: (True, None)}
    pieces = B.to_pieces(spark.createDataFrame([("e", b""), ("f", b"abcdefg")], "block_id string, payload binary"), 3)
    assert sorted((r.block_id, r.piece_no, bytes(r.data), r.last) for r in pieces.collect()) == [("e", 0, b"", True), ("f", 0, b"abc", False), ("f", 1, b"def", False), ("f", 2, b"g", True)]
    stream = spark.createDataFrame([("s", 0, b"ab", False), ("s", 1, b"c", True), ("s", 2, b"", True), ("s", 3, b"open", False)], "stream_id string, seq int, data binary, last boolean")
    got = [r.payload and bytes(r.payload) for r in B.from_pieces(stream).orderBy("block_no").collect()]
    assert got == [b"abc", b"", None] or got == [b"abc", bytearray(b""), None]


BAD = {"no data": b"\xff\xff\xff\xff", "million": (10**6).to_bytes(4, "little"), "empty": b"", "short": b"\1\0\0\0" + (9999).to_bytes(4, "little") + b"short", "two": J.frame([b"abc"])[:0] + b"\2\0\0\0\3\0\0\0abc", "trailing": b"\0\0\0\0*", "many": (4097).to_bytes(4, "little") + b"\0\0\0\0" * 4097}


def test_frames(spark):
    rows = [(k, v) for k, v in BAD.items()] + [("good", J.frame([b"hello"]))]
    got = J.batch_frames(spark.createDataFrame(rows, "name string, frame binary")).collect()
    assert {r.name for r in got if r.error} == set(BAD) and [bytes(r.payload) for r in got if not r.error] == [b"hello"]


def test_retention_journal(spark):
    a, b = digest(b"a"), digest(b"b")
    raw = J.journal_frame([a, b, a], 1) + J.journal_frame([a], 2)
    assert J.parse_journal(raw) == [(1, a.hex()), (1, b.hex()), (2, a.hex())]
    assert J.parse_journal(raw[:-1]) == [(1, a.hex()), (1, b.hex())]
    with pytest.raises(ValueError):
        J.parse_journal(raw[:70] + b"?" + raw[71:])
    with pytest.raises(ValueError):
        J.parse_journal(J.journal_frame([a], 2))
    with pytest.raises(ValueError, match="corrupt journal body at byte 0"):  # the first of two faults
        J.parse_journal(raw[:70] + b"?" + raw[71:-200] + bytes(200))
    assert J.journal_frames([[a, b, a], [a]], 1) == raw and J.parse_journal(b"") == []
    entries = J.retention_journal(spark.createDataFrame([("j", raw)], "name string, content binary"))
    assert {r.block_id: r.local_generation for r in J.guards(entries).collect()} == {a.hex(): 2, b.hex(): 1}
    assert not J.sequence_gaps(entries).count()
    assert {r.local_generation for r in J.protect(entries.select("block_id"), J.guards(entries), 2).collect()} == {3}


def test_manifest_last_wins_until_a_bad_line(spark, tmp_path):
    key = {"fingerprint": {"model_id": "m", "tokenizer_hash": "t", "kv_layout": "l"}, "prefix_hash": "p"}
    line = lambda blocks: json.dumps({"key": key, "blocks": blocks})
    path = tmp_path / "manifest.jsonl"
    path.write_text("\n".join([line(["1"]), line(["2"]), "{torn", line(["3"])]) + "\n")
    assert [r.blocks for r in J.manifest(J.numbered_lines(spark, str(path))).collect()] == [["2"]]


def test_log_drops_a_torn_tail_and_fails_on_a_bad_line(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"log_index": 1}\n{"log_index": 2}\n{"log_in')
    lines = J.numbered_lines(spark, str(path))
    assert [r.entry.log_index for r in J.log_entries(lines, "log_index bigint").collect()] == [1, 2]
    path.write_text('{"log_index": 1}\n[[[\n{"log_index": 2}\n')
    with pytest.raises(Exception, match="malformed log line"):
        J.log_entries(J.numbered_lines(spark, str(path)), "log_index bigint").collect()


def test_ledger(spark):
    text = json.dumps({"version": 1, "blocks": {"x": 2}, "locations": {"x": {"3": "a" * 64, "4": "short"}}})
    blocks, places = J.ledger_tables(spark.createDataFrame([(text,)], "value string"))
    assert [tuple(r) for r in blocks.collect()] == [("x", 2)] and [(r.block_id, r.node) for r in places.collect()] == [("x", 3)]
