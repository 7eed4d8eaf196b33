"""Near-duplicate documents by improved consistent weighted sampling (Ioffe, 2010) over TF-IDF shingles.

Shingles are five words. Document frequencies are counted over all documents in a fixed number of hashed
counters, so the table that is broadcast has the same size for any corpus. A frequency below RARE of the documents
counts as RARE, at any corpus size: what shares a counter with a shingle adds to it in proportion to the corpus,
which is subtracted, and scatters by a part of RARE that shrinks as the corpus grows. Whatever a counter holds, a shingle
weighs the same in every document. The idf is damped, since the shingles of thousands of copies are frequent for that
reason alone. Samples drawn by weight tf * damped idf are banded, and every document of a bucket is compared with the
bucket's leader. In buckets that then still span several classes, each member outside the leader's class first meets
its nearest of another class in each cell of a bounded grid, which joins most to a large group without making its
pairs; samples say only which pair comes first. In the buckets that even then span several classes, every pair of
members of different classes is verified, inside cells of bounded size that hold the texts, so no pair of a bucket
goes unverified unless its members are already in one class or the ratio of their total weights, which no
similarity exceeds, is too small. A pair is verified on whole texts by weighted
Jaccard similarity under the same weights, so a pair's samples agree as often as it is similar. Classes are the
connected components of verified pairs.

Cases: null texts and texts without a word are classes of their own; texts of fewer than five words are one
shingle; equal texts are one node, so repeated rows share a class; rows without doc_id take no part (class null,
kept); rows of one doc_id are one document; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed, hot_keys, met, settle, table

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
COUNTERS = 1 << 20
SLICES = 32
SUMMED = 64  # tables of counters that one task adds up
RARE = 1 / 4096  # share of documents below which a shingle's frequency makes no difference
IDF_SPAN = 0.25  # a rare shingle weighs so much more than one that all documents have
CELL = 512  # members on a side of a grid cell, about
CELL_SHINGLES = 1 << 18  # shingles on a side of a grid cell, about
NEAREST = 0.5  # share of equal samples at which a member's nearest in a cell is tried before all other pairs
FEW = 32  # pairs of one member in a cell that are compared one by one
BLOCK_SHINGLES = 1 << 15
MAX_MEMO = 200_000
SLICE_ROWS = 1000  # of a batch that are held as Python objects
BLANKED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64
_words: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def forget() -> None:
    _words.clear()


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, as 64-bit hashes in order, and how often each occurs."""
    raw = (text or "").lower().encode()
    words = raw.translate(BLANKED).split() or raw.split()
    if len(_words) > MAX_MEMO:
        _words.clear()
    for w in words:
        if w not in _words:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        h = np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if len(h) else [], np.uint64)
    else:
        n = len(h) - WORDS + 1
        s = h[:n].copy()
        for i in range(1, WORDS):
            s = mixed(s * ODD + h[i : n + i])
        h = s
    return np.unique(h, return_counts=True)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(i, SLICE_ROWS)


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have a shingle of each counter, and the number of documents: SLICES rows reach the driver."""
    width = COUNTERS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size, n = np.zeros(COUNTERS, np.int64), [], 0, 0
        for b in sliced(batches):
            for t in b.column("text").to_pylist():
                k, _ = shingles(t)
                held.append((k & U(COUNTERS - 1)).astype(np.int64))
                size, n = size + len(k), n + 1
                if size > COUNTERS:
                    counts += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size = [], 0
        if n:
            if held:
                counts += np.bincount(np.concatenate(held), minlength=COUNTERS)
            rows = [zlib.compress(counts[i * width : (i + 1) * width].tobytes(), 1) for i in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([TaskContext.get().partitionId() // SUMMED] * SLICES, pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array(rows, pa.binary())], names=["slice", "part", "n", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        """The sum of SUMMED tables at most; part becomes that of the next level."""
        total = np.zeros(width, np.int64)
        for x in rows.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        first = rows.slice(0, 1)
        return pa.table({"slice": first.column("slice"), "part": pa.array([first.column("part")[0].as_py() // SUMMED], pa.int32()), "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    kind = "slice int, part int, n bigint, counts binary"
    sums, left = docs.select("text").mapInArrow(freed(count, forget), kind), max(2, docs.rdd.getNumPartitions())
    while left > 1:
        sums, left = sums.groupBy("slice", "part").applyInArrow(add, kind), -(-left // SUMMED)
    out, sums = np.zeros(COUNTERS, np.int64), sums.collect()
    for r in sums:
        out[r.slice * width : (r.slice + 1) * width] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return out, (sums[0].n if sums else 0)


def idf(counts: np.ndarray, n: int) -> np.ndarray:
    """ln(1 + n / df) by counter, df being its count beyond the mean load, RARE of all documents at least."""
    return np.log1p(n / np.maximum(counts - counts.mean(), max(1.0, RARE * n))).astype(np.float32)


def damped(idf_: np.ndarray) -> np.ndarray:
    return (1 + IDF_SPAN * idf_ / max(1e-9, float(idf_.max(initial=1e-9)))).astype(np.float32)


def sampled(keys: np.ndarray, weights: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (documents, BANDS) and 16 bits of each sample, of documents whose shingles lie one after another; none of them is empty."""
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    owner = np.repeat(np.arange(len(lens)), lens)
    log_weight = np.log(weights).astype(np.float32)
    out, kept = np.zeros((len(lens), BANDS), np.uint64), np.zeros((len(lens), BANDS * ROWS), "<u2")
    low, unit = U(0xFFFFFFFF), np.float32(2**-32)
    for i in range(BANDS * ROWS):
        x = mixed(keys + U(((2 * i + 1) * int(ODD)) & 0xFFFFFFFFFFFFFFFF))
        y = mixed(x + ODD)
        uniform = lambda v: (v.astype(np.float32) + np.float32(0.5)) * unit
        r = -np.log(uniform(x & low) * uniform(x >> U(32)))
        c = -np.log(uniform(y & low) * uniform(y >> U(32)))
        beta = ((mixed(y + ODD) >> U(40)).astype(np.float32)) * np.float32(2**-24)
        t = np.floor(log_weight / r + beta)
        a = np.log(c) - r * (t - beta + 1)
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), lens))
        _, first = np.unique(owner[least], return_index=True)
        at = least[first]
        band = i // ROWS
        sample = mixed(keys[at] ^ mixed(t[at].astype(np.int64).view(np.uint64)))
        kept[:, i] = sample >> U(48)
        out[:, band] = mixed(out[:, band] * ODD + sample + U(band + 1))
    return out, kept


def digest() -> Column:
    return F.unhex(F.md5("text"))


def sketches(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs(doc_id, h, text) -> doc_id, h (16 bytes of the text's digest), samples (2 bytes each), mass (total weight), size (shingles), b0.. (band keys), for documents with a word."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # COUNTERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        for b in sliced(batches):
            keys, values, lens, rows, size, found, mass, sizes = [], [], [], [], 0, [], [], []
            texts = b.column("text").to_pylist()
            for i, t in enumerate(texts):
                k, tf = shingles(t)
                if len(k):
                    keys.append(k), values.append(table_[(k & U(COUNTERS - 1)).astype(np.int64)] * tf), lens.append(len(k)), rows.append(i)
                    size += len(k)
                    mass.append(float(values[-1].sum())), sizes.append(len(k))
                if size >= BLOCK_SHINGLES or (size and i == len(texts) - 1):
                    found.append(sampled(np.concatenate(keys), np.concatenate(values), np.array(lens)))
                    keys, values, lens, size = [], [], [], 0
            bands = np.concatenate([x for x, _ in found]) if found else np.zeros((0, BANDS), np.uint64)
            samples = [row.tobytes() for _, x in found for row in x]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("h").take(at), pa.array(samples, pa.binary()), pa.array(mass, pa.float64()), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(bands[:, j]).view(np.int64)) for j in range(BANDS))], names=["doc_id", "h", "samples", "mass", "size", *(f"b{j}" for j in range(BANDS))])

    kind = "doc_id bigint, h binary, samples binary, mass double, size bigint, " + ", ".join(f"b{j} bigint" for j in range(BANDS))
    return docs.mapInArrow(freed(run, forget), kind)


def similarity(a: tuple, b: tuple, weights: np.ndarray) -> float:
    """Weighted Jaccard similarity of two results of shingles()."""
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    keys, tf = keys[order], np.concatenate([a[1], b[1]])[order]
    w = weights[(keys & U(COUNTERS - 1)).astype(np.int64)]
    both = np.flatnonzero(keys[1:] == keys[:-1])
    low = float((np.minimum(tf[both], tf[both + 1]) * w[both]).sum())
    total = float((tf * w).sum())
    return low / (total - low) if total > low else 1.0


def verified(pairs: DataFrame, texts: DataFrame, weights, least: float, hot: list[tuple[int, int]]) -> DataFrame:
    """pairs(a, b) that are similar. weights is a broadcast of damped idf; equal b lie together, so a leader's shingles are made once a task.

    hot names every b of very many pairs, which are spread over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                s = batch.slice(i, 200)
                good = []
                for b, text, other in zip(s.column("b").to_pylist(), s.column("text_a").to_pylist(), s.column("text_b").to_pylist(), strict=True):
                    if b != last:
                        last, mine = b, shingles(other)
                    good.append(similarity(shingles(text), mine, weights.value) >= least)
                yield pa.RecordBatch.from_arrays([s.column("a"), s.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    own = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = met(own, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b", hot, ["a"]).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(freed(run, forget), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, label (least node of its component), by least labels of neighbours and pointer jumping."""
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct().where("a <> b"))
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("next"))
        jumped = hooked.join(labels.select(F.col("node").alias("next"), F.col("label").alias("beyond")), "next").select("node", F.least("next", "beyond").alias("label"), (F.least("next", "beyond") < F.col("label")).alias("moved"))
        found = settle(jumped)
        labels = found.select("node", "label")
        if not found.where("moved").limit(1).count():
            return labels


def grid(members: DataFrame, down: str, across: str) -> tuple[DataFrame, DataFrame]:
    """members(bucket, node, outside, ...) with numbers of cells -> those outside in every cell of a row (y, x), all in every cell of a column."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    return members.where("outside").withColumns({"asks": F.lit(True), "y": place(down)}).withColumn("x", every(across)), members.withColumns({"asks": F.lit(False), "x": place(across)}).withColumn("y", every(down))


def split(buckets: DataFrame, classes: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """buckets(bucket, node, mass, size) that span several classes, with label, leader_label (the class of the least node) and
    the bucket's n members, s shingles, u members and us shingles outside the leader's class. A bucket of two has its one pair verified."""
    rows = buckets.join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = rows.groupBy("bucket", "label").agg(F.min("node").alias("least"), F.count("*").alias("n"), F.sum("size").alias("s"))
    heads = parts.groupBy("bucket").agg(F.min(F.struct("least", "label", "n", "s")).alias("l"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 2 and n > l.n")
    heads = heads.select("bucket", F.col("l.label").alias("leader_label"), "n", "s", (F.col("n") - F.col("l.n")).alias("u"), (F.col("s") - F.col("l.s")).alias("us"))
    return settle(met(rows, heads, "bucket", hot, ["node"]))


def nearest(state: DataFrame, samples: DataFrame) -> DataFrame:
    """split() buckets, samples(node, samples) -> pairs a < b of different classes.

    Of each member outside the leader's class only the pair with the one of another class that agrees most in a cell, the
    smaller on ties. Cells pair CELL members outside with CELL of all members, so no task holds a whole large bucket.
    """
    cells = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    members = state.join(samples, "node").select("bucket", "node", "label", "samples", (F.col("label") != F.col("leader_label")).alias("outside"), cells("n").alias("across"), cells("u").alias("down"))
    rows, cols = (part.select("bucket", "node", "label", "samples", "asks", "y", "x") for part in grid(members, "down", "across"))

    def run(key: tuple, cell: pa.Table) -> pa.Table:
        asks = cell.column("asks").to_numpy()
        nodes, labels = cell.column("node").to_numpy(), cell.column("label").to_numpy()
        all_ = np.frombuffer(b"".join(cell.column("samples").to_pylist()), "<u2").reshape(len(nodes), -1)
        y, x = np.flatnonzero(asks), np.flatnonzero(~asks)
        a, b = [], []
        for i in y:
            equal = np.where(labels[x] == labels[i], 0, (all_[x] == all_[i]).mean(1))
            near = x[equal >= NEAREST]
            if len(near):
                near = near[[np.lexsort((nodes[near], -equal[equal >= NEAREST]))[0]]]
            a.append(np.minimum(nodes[near], nodes[i]))
            b.append(np.maximum(nodes[near], nodes[i]))
        return pa.table({"a": np.concatenate([*a, np.empty(0, np.int64)]), "b": np.concatenate([*b, np.empty(0, np.int64)])})

    return rows.unionByName(cols).groupBy("bucket", "y", "x").applyInArrow(run, "a bigint, b bigint").distinct()


def can_reach(a, b, least: float):
    """Whether documents of total weights a and b can be so similar: the common weight is the smaller one at most."""
    low, high = (F.least(a, b), F.greatest(a, b)) if not isinstance(b, np.ndarray) else (np.minimum(a, b), np.maximum(a, b))
    return low >= high * (least * (1 - 1e-6))


def postings(made: list[tuple], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of many documents in order, whose each is, and its weight there."""
    keys = np.concatenate([k for k, _ in made])
    owner = np.repeat(np.arange(len(made)), [len(k) for k, _ in made])
    weight = weights[(keys & U(COUNTERS - 1)).astype(np.int64)] * np.concatenate([tf for _, tf in made])
    order = np.argsort(keys, kind="stable")
    return keys[order], owner[order], weight[order]


def common(one: tuple, index: tuple, n: int, weights: np.ndarray) -> np.ndarray:
    """Weight that one document has in common with each of the n documents of postings()."""
    keys, owner, weight = index
    mine = weights[(one[0] & U(COUNTERS - 1)).astype(np.int64)] * one[1]
    low = np.searchsorted(keys, one[0], "left")
    lens = np.searchsorted(keys, one[0], "right") - low
    at = np.repeat(low - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
    return np.bincount(owner[at], np.minimum(weight[at], np.repeat(mine, lens)), minlength=n)


def links_within(nodes, labels, mass, asks, asked, text, weights: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Verified pairs (a < b) that join all classes of a cell which any pair of one that asks and one asked joins; labels are updated.

    text(i) gives the shingles of member i.
    """
    y, x = np.flatnonzero(asks), np.flatnonzero(asked)
    index, out = None, []
    for i in y:
        near = np.flatnonzero((labels[x] != labels[i]) & can_reach(mass[i], mass[x], least))
        if len(near) >= FEW:
            if index is None:
                index = postings([text(j) for j in x], weights)
            both = common(text(i), index, len(x), weights)[near]
            near = near[both >= least * (1 - 1e-6) * (mass[i] + mass[x[near]] - both)]
        for j in x[near]:
            if labels[j] != labels[i] and similarity(text(i), text(j), weights) >= least:
                labels[labels == labels[j]] = labels[i]
                out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return out


def remaining(state: DataFrame, texts: DataFrame, weights, least: float) -> DataFrame:
    """split() buckets -> similar pairs (a, b) that join all classes which a pair of a bucket joins.

    Every pair of different classes meets in a cell and is verified there unless the cell has
    joined the two before. Buckets of one cell are put together in lots of about a cell.
    """
    cells = lambda n, s: F.ceil(F.greatest(F.col(n) / CELL, F.col(s) / CELL_SHINGLES)).cast("int")
    placed = state.withColumns({"outside": F.col("label") != F.col("leader_label"), "across": cells("n", "s"), "down": cells("u", "us")})
    small = placed.where("across = 1").agg(F.count("*").alias("n"), F.sum("size").alias("s")).first()
    lots = max(1, small.n // CELL, (small.s or 0) // CELL_SHINGLES)
    rows, cols = grid(placed.where("across > 1"), "down", "across")
    one = placed.where("across = 1").withColumns({"asks": F.col("outside"), "asked": F.lit(True), "unit": F.pmod(F.xxhash64("bucket"), F.lit(lots)), "y": F.lit(-1), "x": F.lit(-1)})
    names = ["unit", "y", "x", "bucket", "node", "label", "mass", "asks", "asked"]
    spread = rows.unionByName(cols).withColumns({"asked": ~F.col("asks"), "unit": F.col("bucket")})
    all_ = spread.select(names).unionByName(one.select(names)).join(texts.select(F.col("doc_id").alias("node"), "text"), "node")

    def run(key: tuple, unit: pa.Table) -> pa.Table:
        unit = unit.sort_by([("bucket", "ascending"), ("node", "ascending")])
        bucket, nodes, labels, mass, asks, asked = (unit.column(c).to_numpy().copy() for c in ("bucket", "node", "label", "mass", "asks", "asked"))
        held: dict[int, tuple] = {}

        def text(i: int) -> tuple:
            if nodes[i] not in held:
                held[nodes[i]] = shingles(unit.column("text")[int(i)].as_py())
            return held[nodes[i]]

        out = []
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for start, end in zip(starts, [*starts[1:], len(bucket)], strict=True):
            here = np.zeros(len(bucket), bool)
            here[start:end] = True
            out += links_within(nodes, labels, mass, asks & here, asked & here, text, weights.value, least)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return all_.groupBy("unit", "y", "x").applyInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, class_id: a row each."""
    docs = docs.select("doc_id", "text")
    hashed = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", digest().alias("h"), "text")
    counts, n = document_counts(docs)
    table_ = damped(idf(counts, max(1, n)))
    weights = docs.sparkSession.sparkContext.broadcast(table_)
    made = settle(sketches(hashed, table_))
    nodes = settle(made.groupBy("h").agg(F.min("doc_id").alias("node"), *[F.any_value(c).alias(c) for c in ("samples", "mass", "size")], *[F.min(f"b{j}").alias(f"b{j}") for j in range(BANDS)]))
    buckets = nodes.select("node", "mass", "size", F.explode(F.array(*[f"b{j}" for j in range(BANDS)])).alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.min(F.struct("node", "mass")).alias("l"), F.max("node").alias("last"), F.count("*").alias("n")).where("l.node < last")
    leaders = settle(leaders.select("bucket", F.col("l.node").alias("leader"), F.col("l.mass").alias("leader_mass"), "n"))
    hot = hot_keys(leaders.select("bucket", "n", "leader"), BANDS * n)  # also of any part of the buckets
    hot_leaders: dict[int, int] = {}
    for _, tasks, leader in hot:
        hot_leaders[leader] = max(tasks, hot_leaders.get(leader, 0))
    hot = [x[:2] for x in hot]
    buckets = settle(met(buckets, leaders.drop("n"), "bucket", hot, ["node"]).select("bucket", "node", "mass", "size", "leader", can_reach(F.col("mass"), F.col("leader_mass"), least).alias("near")))
    wanted = nodes.select(F.col("node").alias("doc_id"), "h").join(buckets.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = settle(hashed.join(wanted, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]).select("doc_id", "text"))

    def linked(links: DataFrame, classes: DataFrame | None) -> DataFrame:
        """node, label of what similar pairs join, on top of the classes so far."""
        if classes is None:
            return components(links)
        own = lambda c, name: classes.select(F.col("node").alias(c), F.col("label").alias(name))
        ends = links.join(own("a", "x"), "a", "left").join(own("b", "y"), "b", "left")
        merged = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("to"))
        moved = classes.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        return settle(moved.unionByName(merged.select(F.col("label").alias("node"), F.col("to").alias("label")).join(classes, "node", "left_anti")))

    led = buckets.where("node <> leader and near").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    classes = linked(verified(led, texts, weights, least, list(hot_leaders.items())), None)
    state = split(buckets.select("bucket", "node", "mass", "size"), classes, hot)
    pairs = settle(nearest(state, nodes.select("node", "samples")))
    classes = linked(verified(pairs, texts, weights, least, hot_keys(pairs.groupBy("b").agg(F.count("*").alias("n")), pairs.count())), classes)
    state = split(state.select("bucket", "node", "mass", "size"), classes, hot)
    classes = linked(remaining(state, texts, weights, least), classes)
    by_text = made.select("doc_id", "h").join(nodes.select("h", "node"), "h").join(classes, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "node")).alias("class_id"))
    return docs.select("doc_id").join(by_text, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class, that of least id, and one row of it."""
    found = near_duplicates(docs)
    once = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__again"))
    gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    if not once.limit(1).count():
        return kept
    first = kept.join(once, F.col("doc_id") == F.col("__again"), "left_semi").dropDuplicates(["doc_id"])
    return kept.join(once, F.col("doc_id") == F.col("__again"), "left_anti").unionByName(first)


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") != F.col("class_id")).alias("is_duplicate"))


QUERIES = {"op5_neardup": op5_neardup}
