"""Segment files: padded, self-verifying block records, read through `binaryFile` or the `segments` data source.

Reading goes through Spark's own file sources, so segments can lie in any store; a file is a partition. The data
source also writes: each task rolls its own segments in a shared folder and the commit renames them into place.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .. import schemas as S
from ..functions.blake3 import BATCH, digests

# The record format; fixed values.
MAGIC = b"KLPK"
VERSION = 1
HEADER = 64
PAGE = 4096
RESERVED = slice(48, 64)
FILE_NAME = "seg-{:08d}.klpk"
FILE_PATTERN = re.compile(r"seg-(\d{8,10})\.klpk$")
ROLL_BYTES = 256 << 20
REPLACING = ".replacing"  # holds the number of new segments while an overwrite puts them in place
Hashes = Callable[[list[bytes]], list[bytes]]  # of many payloads at once
HASHES: dict[str, Hashes] = {"blake3": digests, "sha256": lambda payloads: [hashlib.sha256(p).digest() for p in payloads]}


def record_length(payload_len: int) -> int:
    return -(-(HEADER + payload_len) // PAGE) * PAGE


def encode_record(id_: bytes, payload: bytes) -> bytes:
    head = struct.pack("<4sIQ32s", MAGIC, VERSION, len(payload), id_)
    return (head.ljust(HEADER, b"\0") + payload).ljust(record_length(len(payload)), b"\0")


def parse_header(raw: bytes) -> tuple[bytes, int] | None:
    """Id and payload length of a record's start; reserved bytes are not looked at."""
    if len(raw) < HEADER:
        return None
    magic, version, n, id_ = struct.unpack_from("<4sIQ32s", raw)
    return (id_, n) if (magic, version) == (MAGIC, VERSION) else None


def scan(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(id, offset, payload length) of records from the start to the first that is torn or foreign; payloads are not hashed."""
    at = 0
    while (found := parse_header(data[at : at + HEADER])) and at + record_length(found[1]) <= len(data):
        yield found[0], at, found[1]
        at += record_length(found[1])


def valid_end(data: bytes) -> int:
    last = None
    for last in scan(data):
        pass
    return 0 if last is None else last[1] + record_length(last[2])


def _look(data: bytes, at: int) -> tuple[str | None, bytes | None, int]:
    """What is wrong with a record's start, its id and payload length; the payload is not hashed."""
    head = data[at : at + HEADER]
    found = parse_header(head)
    if len(head) < HEADER:
        return "truncated_header", None, 0
    if not found:
        return "invalid_header", None, 0
    if any(head[RESERVED]):
        return "invalid_reserved_header", *found
    if found[1] + HEADER + PAGE - 1 >= 1 << 64:
        return "length_overflow", *found
    if at + record_length(found[1]) > len(data):
        return "truncated_or_invalid_length", *found
    return None, *found


def findings(data: bytes, hashes_of: Hashes = digests) -> Iterator[tuple[int, str | None, bytes | None]]:
    """(offset, kind, id) at every page that should start a record; kind is null for an intact one.

    A damaged record's length is not trusted: the walk goes on at the next page, so later records are still seen.
    Records that follow each other are hashed together; hashes beyond a damaged one are kept until the walk gets there.
    """
    at, known = 0, {}
    while at < len(data):
        run, held, ahead, kind, id_ = [], 0, at, None, None
        while ahead < len(data) and held < BATCH:
            kind, id_, n = _look(data, ahead)
            if kind:
                break
            run.append((ahead, id_, n))
            ahead += record_length(n)
            held += record_length(n)
        known = {place: h for place, h in known.items() if place >= at}
        fresh = [r for r in run if r[0] not in known]
        hashes = hashes_of([data[place + HEADER : place + HEADER + n] for place, _, n in fresh])
        known |= {place: h for (place, _, _), h in zip(fresh, hashes, strict=True)}
        for place, expected, n in run:
            if known[place] != expected:
                yield place, "payload_hash_mismatch", expected
                at = place + PAGE
                break
            yield place, None, expected
            at = place + record_length(n)
        else:
            if kind:
                yield at, kind, id_
                at += PAGE


def files(spark: SparkSession, path: str) -> DataFrame:
    """segment, content of the segment files of a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "seg-*.klpk").load(path)
    return raw.select(F.regexp_extract("path", r"seg-(\d+)\.klpk$", 1).cast("int").alias("segment"), "content")


def _mapped(segments: DataFrame, rows_of: Callable[[bytes], list[tuple]], names: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for seg, content in zip(b.column("segment").to_pylist(), b.column("content"), strict=True):
                rows = [(seg, *r) for r in rows_of(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return segments.mapInArrow(run, schema)


def index_records(segments: DataFrame) -> DataFrame:
    """Every record of files(): segment, block_id, offset, payload_len."""
    names, kinds = ["segment", "block_id", "offset", "payload_len"], [pa.int32(), pa.string(), pa.int64(), pa.int64()]
    return _mapped(segments, lambda d: [(i.hex(), at, n) for i, at, n in scan(d)], names, kinds, "segment int, block_id string, offset bigint, payload_len bigint")


def payload_records(segments: DataFrame) -> DataFrame:
    """index_records() with the payload."""
    names, kinds = ["segment", "block_id", "offset", "payload"], [pa.int32(), pa.string(), pa.int64(), pa.binary()]
    return _mapped(segments, lambda d: [(i.hex(), at, d[at + HEADER : at + HEADER + n]) for i, at, n in scan(d)], names, kinds, "segment int, block_id string, offset bigint, payload binary")


def scrub(segments: DataFrame, hash_name: str = "blake3", sealed_only: bool = False) -> DataFrame:
    """schemas.FINDINGS of all damage; sealed_only leaves out the newest segment, which a writer may hold."""
    if sealed_only:
        newest = segments.agg(F.max("segment").alias("newest"))
        segments = segments.join(F.broadcast(newest), F.col("segment") < F.col("newest")).drop("newest")
    hashes_of = HASHES[hash_name]
    names, kinds = ["segment", "offset", "kind", "block_id"], [pa.int32(), pa.int64(), pa.string(), pa.string()]
    return _mapped(segments, lambda d: [(at, k, i.hex() if i else None) for at, k, i in findings(d, hashes_of) if k], names, kinds, S.FINDINGS)


def segment_gaps(segments: DataFrame) -> DataFrame:
    """Numbers missing between 0 and the newest segment; any is an error."""
    most = segments.agg(F.max("segment").alias("m")).select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("segment"))
    return most.join(segments.select("segment"), "segment", "left_anti")


def layout_stamp(spark: SparkSession, path: str) -> DataFrame:
    """One row: files and a hash over their sorted names, sizes and times, by which a resumed sweep knows its layout."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "seg-*.klpk").load(path).select("path", "length", "modificationTime")
    line = F.concat_ws("|", F.regexp_extract("path", r"([^/]+)$", 1), F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return raw.agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("manifest"))


def roll(records: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """records(store, pos, payload_len) -> store, pos, segment, offset: each record's place when appended in order.

    A segment closes when the next record would pass roll_bytes; a record larger than that is alone in its own.
    """

    def run(frame):
        frame = frame.sort_values("pos")
        seg, tail, out = 0, 0, []
        for n in frame["payload_len"]:
            size = record_length(int(n))
            if tail and tail + size > roll_bytes:
                seg, tail = seg + 1, 0
            out.append((seg, tail))
            tail += size
        return frame.assign(segment=[s for s, _ in out], offset=[o for _, o in out])[["store", "pos", "segment", "offset"]]

    return records.groupBy("store").applyInPandas(run, "store string, pos bigint, segment int, offset bigint")


@dataclass
class _File(InputPartition):
    path: str
    segment: int


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class SegmentSource(DataSource):
    """format("segments"): option path, a folder that all executors share; hash is blake3 (default) or sha256; payload false reads ids alone."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return "block_id string, payload binary, segment int, offset bigint, payload_len bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _groups(payloads: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Payloads in lists of BATCH bytes, the last payload of each beside."""
    group, held = [], 0
    for p in payloads:
        group.append(p)
        held += len(p) + HEADER
        if held >= BATCH:
            yield group
            group, held = [], 0
    if group:
        yield group


def finish_overwrite(path: str) -> None:
    """Puts new segments in place of the old ones if an overwrite was decided; it may be cut off and begun again anywhere."""
    marker = os.path.join(path, REPLACING)
    if not os.path.exists(marker):
        return
    with suppress(FileNotFoundError):  # another task may finish the same overwrite
        with open(marker) as f:
            count = int(f.read())
        for i in range(count):
            with suppress(FileNotFoundError):  # in place already
                os.replace(os.path.join(path, f".new-{i:08d}"), os.path.join(path, FILE_NAME.format(i)))
        for n in os.listdir(path):
            m = FILE_PATTERN.match(n)
            if n.startswith(".new-") or (m and int(m[1]) >= count):
                os.remove(os.path.join(path, n))
        os.remove(marker)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = _local(options["path"])
        finish_overwrite(self.path)
        self.payload = options.get("payload", "true") == "true"

    def partitions(self):
        found = [(int(m[1]), n) for n in os.listdir(self.path) if (m := FILE_PATTERN.match(n))]
        return [_File(os.path.join(self.path, n), seg) for seg, n in sorted(found)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            size, at = os.fstat(f.fileno()).st_size, 0
            while (found := parse_header(f.read(HEADER))) and at + record_length(found[1]) <= size:
                yield found[0].hex(), f.read(found[1]) if self.payload else None, partition.segment, at, found[1]
                at += record_length(found[1])
                f.seek(at)


class _Writer(DataSourceWriter):
    """Takes rows of (block_id, payload, ...); ids are hashed anew, so a wrong one can't be stored."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = _local(options["path"]), overwrite
        self.roll_bytes = int(options.get("rollbytes", ROLL_BYTES))
        self.hash = options.get("hash", "blake3")

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        done, out, tail = [], None, 0
        for payloads in _groups(bytes(row["payload"]) for row in rows):
            for id_, payload in zip(HASHES[self.hash](payloads), payloads, strict=True):
                record = encode_record(id_, payload)
                if out is None or (tail and tail + len(record) > self.roll_bytes):
                    if out:
                        out.close()
                    done.append(os.path.join(self.path, f".pending-{uuid.uuid4().hex}"))
                    out, tail = open(done[-1], "wb"), 0  # noqa: SIM115
                out.write(record)
                tail += len(record)
        if out:
            out.close()
        return _Written(done)

    def commit(self, messages):
        os.makedirs(self.path, exist_ok=True)
        finish_overwrite(self.path)
        made = [p for m in messages for p in (m.paths if m else ())]
        if self.overwrite:
            for i, p in enumerate(made):
                os.rename(p, os.path.join(self.path, f".new-{i:08d}"))
            draft = os.path.join(self.path, f".draft-{uuid.uuid4().hex}")
            with open(draft, "w") as f:
                f.write(str(len(made)))
            os.rename(draft, os.path.join(self.path, REPLACING))  # from here on the new segments count
            finish_overwrite(self.path)
            return
        old = [int(m[1]) for n in os.listdir(self.path) if (m := FILE_PATTERN.match(n))]
        for at, p in enumerate(made, max(old, default=-1) + 1):
            os.rename(p, os.path.join(self.path, FILE_NAME.format(at)))

    def abort(self, messages):
        for m in messages:
            for p in m.paths if m else ():
                if os.path.exists(p):
                    os.remove(p)
