"""Substring dedup by content-defined chunks.

A gear hash of the last 16 bytes cuts texts into variable chunks, so cuts depend on content and an insertion
shifts only the chunks around it. Chunks are compared by digest over the whole corpus: the document of least id
that holds a chunk keeps it. A stretch of consecutive chunks that earlier documents hold is removed if it has
MIN_WORDS words or more; shorter coincidences stay. A digest's holders are found by partial aggregation, and the
occurrences of one that very many documents share are spread over tasks.

Cases: null and empty texts have no chunks; rows without doc_id take no part and keep their text; rows of one
doc_id are versions of one document, which do not take passages from each other, and what only they or one text
repeat is not repeated across documents; repeated rows come out alike; a text is cut to whole words at both ends of what is removed; other columns pass through the stage unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed, hot_keys, met, recounted, settle, table

MIN_CHUNK, MASK_BITS, MAX_CHUNK = 16, 4, 120  # bytes; cuts are 2^MASK_BITS bytes apart beyond the least size
MIN_WORDS = 25
GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, dtype=np.uint16)
#: place: start << 32 | length << 24 | words << 18 | 18 bits of the text's hash
CHUNKS = "doc_id bigint, digest bigint, place bigint"
FOUND = "doc_id bigint, version int, n_chunks int, repeated_words int, removed_words int, removed array<struct<start:bigint,end:bigint>>, kept_in array<bigint>"


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of a text in UTF-8, all between characters."""
    a = np.frombuffer(raw, np.uint8)
    if not len(a):
        return []
    h = GEAR[a]
    for s in (1, 2, 4, 8):
        h[s:] += h[:-s] << np.uint16(s)
    whole = np.ones(len(a), bool)  # a character ends here
    whole[:-1] = (a[1:] & 0xC0) != 0x80
    out, last = [], 0
    for c in (np.flatnonzero((h >> np.uint16(16 - MASK_BITS) == 0) & whole) + 1).tolist() + [len(a)]:
        while c - last > MAX_CHUNK:
            last += MAX_CHUNK
            while not whole[last - 1]:
                last -= 1
            out.append(last)
        if c - last >= MIN_CHUNK or (c == len(a) and c > last):
            out.append(c)
            last = c
    return out


def version_of(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) & 0x3FFFF


def chunks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> CHUNKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                ids, digests, places = [], [], []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    if doc is None or not text:
                        continue
                    raw = text.encode()
                    version, start = version_of(raw), 0
                    for end in cuts(raw):
                        piece = raw[start:end]
                        digests.append(xxhash.xxh3_64_intdigest(piece))
                        places.append(start << 32 | (end - start) << 24 | min(63, piece.count(b" ") + piece.count(b"\n")) << 18 | version)
                        start = end
                    ids.extend([doc] * (len(digests) - len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(places, pa.int64())], names=["doc_id", "digest", "place"])

    return docs.select("doc_id", "text").mapInArrow(freed(run), CHUNKS)


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """FOUND, for each document with a stretch of min_words or more that another has too; positions are bytes of its UTF-8."""
    made = chunks(docs)
    held = made.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    held = settle(held.select("digest", "n", "first"))
    total = held.agg(F.sum("n")).first()[0] or 0
    shared = met(made, held.select("digest", "first"), "digest", hot_keys(held.select("digest", "n"), total), ["doc_id", "place"])
    by_doc = shared.groupBy("doc_id", F.col("place").bitwiseAND(F.lit(0x3FFFF).cast("bigint")).cast("int").alias("version")).agg(F.collect_set(F.struct("place", "first")).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, version, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "version", "chunks")), strict=True):
                stretch: list[tuple[int, int, int, int]] = []
                stretches = [stretch]
                for place, first in sorted({(c["place"], c["first"]) for c in found}):
                    start, words = place >> 32, place >> 18 & 63
                    end = start + (place >> 24 & 255)
                    if stretch and stretch[-1][1] != start:
                        stretch = []
                        stretches.append(stretch)
                    stretch.append((start, end, words, first))
                stretches = [s for s in stretches if sum(c[2] for c in s) >= min_words]
                removed, lost = [], 0
                for s in stretches:
                    run_: list[tuple[int, int, int, int]] = []
                    for c in [*s, None]:
                        if c is not None and c[3] != doc:
                            run_.append(c)
                            continue
                        if (n := sum(x[2] for x in run_)) >= min_words:
                            removed.append({"start": run_[0][0], "end": run_[-1][1]})
                            lost += n
                        run_ = []
                if stretches:
                    rows.append((doc, version, sum(map(len, stretches)), sum(c[2] for s in stretches for c in s), lost, removed, sorted({c[3] for s in stretches for c in s})))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64()))
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "version", "n_chunks", "repeated_words", "removed_words", "removed", "kept_in"])

    return by_doc.mapInArrow(freed(run), FOUND)


def without(raw: bytes, spans: list[dict]) -> bytes:
    """The text without these spans, drawn in to whole words."""
    out, at = [], 0
    for s in spans:
        start, end = s["start"], s["end"]
        while 0 < start < end and raw[start - 1] not in b" \n":
            start += 1
        while start < end < len(raw) and raw[end] not in b" \n":
            end -= 1
        out.append(raw[at:start])
        at = end
    return b"".join([*out, raw[at:]])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, without the passages that earlier documents keep."""
    found = repeated(docs).where(F.size("removed") > 0).select(F.col("doc_id").alias("__of"), "version", "removed")
    both = docs.join(found.groupBy("__of").agg(F.collect_list(F.struct("version", "removed")).alias("__versions")), F.col("doc_id") == F.col("__of"), "left").drop("__of")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            versions = b.column(b.num_columns - 1).to_pylist()
            for i, own in enumerate(versions):
                if own and texts[i]:
                    raw = texts[i].encode()
                    spans = next((v["removed"] for v in own if v["version"] == version_of(raw)), [])
                    texts[i] = without(raw, spans).decode()
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return recounted(both.mapInArrow(freed(run), docs.schema))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents")).drop("version")


QUERIES = {"op9_substrings": op9_substrings}
