"""Byte-level BPE by merge replay over the words of a block of texts, and decoding.

A block's new words lie in one array of symbols. An inverted index from token pair (by the rank of what it
makes) to word positions is walked in rank order; each pair is merged at all its positions at once and only
the neighbours of those positions are looked up again. Words are kept in a bounded memo, so common ones are
merged once a worker. Ids equal those of the tiktoken library, whose order of merges within a word is the same.

Cases: a null or empty text has no ids; a word that is a token itself is that token; a text of any length is
read in stretches of matches, so memory is bounded by the text; rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .packing import blocks

NONE = np.int32((1 << 31) - 1)
MAX_MEMO = 400_000
BLOCK_CHARS = 4_000_000
STRETCH = 500_000  # matches of a text that are held at a time
RANK_BLOCK = 1024  # ranks whose positions are indexed at a time
ENCODED = "doc_id bigint, n_tokens bigint, ids binary"
_codecs: dict = {}


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(self.rank_of.values()) >= 0xFFFF:
            raise ValueError("the vocabulary is too large for 16-bit ids")
        self.pattern = regex.compile(pattern)
        self.bytes_of = {r: t for t, r in self.rank_of.items()}
        self.single = np.array([self.rank_of[bytes([b])] for b in range(256)], np.int32)
        pairs = sorted((self.rank_of[t[:i]] << 16 | self.rank_of[t[i:]], r) for t, r in self.rank_of.items() for i in range(1, len(t)) if t[:i] in self.rank_of and t[i:] in self.rank_of)
        self.keys = np.array([k for k, _ in pairs], np.uint32)
        self.made = np.array([r for _, r in pairs], np.int32)
        self.memo: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, none of them empty."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        n = len(flat)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        sym = self.single[flat]
        nxt = np.arange(1, n + 1, dtype=np.int64)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1, dtype=np.int64)
        prv[ends[:-1]] = -1
        prv[0] = -1
        rank = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(nxt >= 0)
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        alive = np.ones(n, bool)
        low = 0
        while True:
            todo = np.flatnonzero(rank < NONE)
            if not len(todo):
                break
            low = int(rank[todo].min())
            high = low + RANK_BLOCK
            todo = todo[rank[todo] < high]
            index: dict[int, list[np.ndarray]] = {}
            self._add(index, todo, rank[todo])
            queue = list(index)
            heapq.heapify(queue)
            while queue:
                r = heapq.heappop(queue)
                at = index.pop(r)
                at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
                at = at[rank[at] == r]
                if not len(at):
                    continue
                at = self._apart(at, nxt)
                gone = nxt[at]
                after = nxt[gone]
                has = after >= 0
                sym[at] = r
                nxt[at] = after
                prv[after[has]] = at[has]
                rank[gone] = NONE
                alive[gone] = False
                rank[at] = NONE
                rank[at[has]] = self.ranks(sym[at[has]], sym[after[has]])
                before = prv[at]
                lead = before >= 0
                before, own = before[lead], at[lead]
                rank[before] = self.ranks(sym[before], sym[own])
                touched = np.concatenate([at[has], before])
                new = rank[touched]
                touched, new = touched[new < high], new[new < high]
                if len(touched):
                    for k in self._add(index, touched, new):
                        heapq.heappush(queue, k)
        live = np.flatnonzero(alive)
        return np.split(sym[live].astype("<u4"), np.searchsorted(live, ends[:-1]))

    @staticmethod
    def _add(index: dict, at: np.ndarray, ranks: np.ndarray) -> list[int]:
        """Enter positions by rank; the ranks that are new to the index."""
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        fresh = []
        for k, some in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
            if k not in index:
                index[k] = []
                fresh.append(k)
            index[k].append(some)
        return fresh

    @staticmethod
    def _apart(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Without positions whose first symbol the merge before them uses, from left to right."""
        at = np.sort(at)
        if not (nxt[at[:-1]] == at[1:]).any():
            return at
        out, used = [], -1
        for p, q in zip(at.tolist(), nxt[at].tolist(), strict=True):
            if p != used:
                out.append(p)
                used = q
        return np.array(out)

    def learn(self, words: set[str]) -> None:
        new = words - self.memo.keys()
        if len(self.memo) + len(new) > MAX_MEMO:
            self.memo.clear()
            new = words
        hard = []
        for w in new:
            r = self.rank_of.get(w.encode())
            if r is None:
                hard.append(w)
            else:
                self.memo[w] = r.to_bytes(4, "little")
        if hard:
            for w, ids in zip(hard, self.replay([w.encode() for w in hard]), strict=True):
                self.memo[w] = ids.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= BLOCK_CHARS]
        split = {i: self.pattern.findall(texts[i]) for i in short}
        self.learn(set(chain.from_iterable(split.values())))
        get = self.memo.__getitem__
        for i, words in split.items():
            out[i] = b"".join(map(get, words))
        for i in set(range(len(texts))) - split.keys():
            out[i] = b"".join(self._stretches(m[0] for m in self.pattern.finditer(texts[i])))
        return out

    def _stretches(self, words: Iterable[str]) -> Iterator[bytes]:
        words = iter(words)
        while some := list(islice(words, STRETCH)):
            self.learn(set(some))
            yield b"".join(map(self.memo.__getitem__, some))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBPE(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> ENCODED."""
    found = vocabulary() if path is None or pattern is None else (path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*found)
        for b in blocks(batches, "text", BLOCK_CHARS):
            ids = own.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """ENCODED -> with the column decoded (binary)."""
    found = vocabulary() if path is None or pattern is None else (path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*found)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                s = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array([own.decode(x) for x in s.column("ids").to_pylist()], pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.mapInArrow(run, ENCODED + ", decoded binary")


def op10_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(table(spark, sf_dir, "documents")))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op10_bytebpe": op10_bytebpe}
