"""Best-fit packing of token sequences by large-item matching, over the whole corpus at once.

Only lengths matter for a packing, so it is planned on the histogram of lengths (capacity numbers at most):
items above a third of the capacity are matched greedily, two to a bin at most, and smaller ones, longest
first, fill the tightest gaps. The plan is a short table of bin patterns with multiplicities; every piece
then finds its place by its length and its rank among pieces of that length, which is a sum of counts over
partitions. No task sees more than its own rows and the plan.

Cases: a null or empty text is one piece of the closing id alone; documents longer than the capacity are cut
into full pieces and a rest, nothing else is cut; repeated rows are packed each; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freed, settle, table

CAPACITY = 2048
END_ID = 0
BLOCK_CHARS = 2_000_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, at bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
_encoders: dict = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str):
    if path not in _encoders:
        from .wordbpe import WordEncoder

        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def forget() -> None:
    for e in _encoders.values():
        e.memo.clear()


def blocks(batches: Iterator[pa.RecordBatch], column: str, chars: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes of text, a row at least."""
    for b in batches:
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + chars)))
            yield b.slice(i, j - i)
            i = j


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> PIECES; at counts earlier pieces of that length in the same partition."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        step, end = 4 * capacity, END_ID.to_bytes(4, "little")
        for b in blocks(batches, "text", BLOCK_CHARS):
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), code.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                ids += end
                for no, i in enumerate(range(0, len(ids), step)):
                    n = min(step, len(ids) - i) // 4
                    rows.append((doc, no, i // 4, n, zlib.crc32(ids[i : i + step]), part, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "at"])

    return docs.select("doc_id", "text").mapInArrow(freed(run, forget), PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin patterns for so many items of each length: (number of bins, [(length, items of it in a bin)])."""
    left = {k: n for k, n in counts.items() if n > 0}
    large = sorted(k for k in left if 3 * k > capacity)
    bins: list[tuple[int, list[tuple[int, int]]]] = []
    gaps: dict[int, list[int]] = {}

    def opened(n: int, items: list[tuple[int, int]]) -> None:
        bins.append((n, items))
        gaps.setdefault(capacity - sum(k * m for k, m in items), []).append(len(bins) - 1)

    while large:
        k = large[-1]
        at = bisect_right(large, capacity - k) - 1
        mate = large[at] if at >= 0 else None
        if mate is None or (mate == k and left[k] == 1):
            opened(left[k], [(k, 1)])
            left[k] = 0
        elif mate == k:
            opened(left[k] // 2, [(k, 2)])
            left[k] %= 2
        else:
            n = min(left[k], left[mate])
            opened(n, [(k, 1), (mate, 1)])
            left[k] -= n
            left[mate] -= n
            if not left[mate]:
                large.pop(at)
        if not left[k]:
            large.remove(k)
    for k in sorted((x for x in left if 3 * x <= capacity and left[x]), reverse=True):
        n = left[k]
        for gap in sorted(g for g in gaps if g >= k):
            mine, gaps[gap] = gaps.pop(gap), []
            for b in mine:
                m, items = bins[b]
                each = gap // k
                full = min(m, n // each)
                n -= full * each
                rest = n if full < m else 0
                n -= rest
                parts = [(full, each), (1 if rest else 0, rest), (m - full - (1 if rest else 0), 0)]
                place = b
                for many, inside in parts:
                    if many:
                        made = (many, [*items, (k, inside)] if inside else items)
                        if place is not None:
                            bins[place], here, place = made, place, None
                        else:
                            bins.append(made)
                            here = len(bins) - 1
                        gaps.setdefault(gap - k * inside, []).append(here)
            if not gaps.get(gap, True):
                del gaps[gap]
            if not n:
                break
        each = capacity // k
        if n >= each:
            opened(n // each, [(k, each)])
        if n % each:
            opened(1, [(k, n % each)])
    return bins


def places(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as ranges of (length, rank): ranks from `rank` on lie at `offset` of sequences from `bin` on."""
    rows, used, first = [], {}, 0
    for n, items in bins:
        offset = 0
        for k, m in items:
            for _ in range(m):
                rows.append((k, used.get(k, 0), first, offset))
                used[k] = used.get(k, 0) + n
                offset += k
        first += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": a[:, 0] << 44 | a[:, 1], "rank": a[:, 1], "bin": a[:, 2], "offset": a[:, 3]}


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """PIECES as a settled table -> PACKED."""
    by_part = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table_ = places(plan(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(table_["key"], length << 44 | rank, side="right") - 1
            sequence = table_["bin"][at] + rank - table_["rank"][at]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(table_["offset"][at])], names=[*names, "sequence_id", "offset"])

    ranked = made.join(firsts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("at")).alias("rank"))
    return ranked.mapInArrow(freed(run), PACKED)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents."""
    return pack(settle(pieces(docs)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)


QUERIES = {"op4_packing": op4_packing}
