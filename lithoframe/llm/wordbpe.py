"""Exact word-end BPE for many distinct words at once.

Plain words of ASCII and Latin-1 letters, with or without punctuation around them, are merged as matrices, a
merge per word and step: the pair of least rank, the leftmost on ties, as the tokenizers library does. Any other
stretch of text goes to that library itself. Results are kept by stretch in a bounded memo.
"""

from __future__ import annotations

import json
import re

import numpy as np

NONE = np.int32(1 << 30)
PAD = 0xFFFF
CELLS = 1 << 20  # of a matrix
MAX_WORD = 128  # longer ones go to the library
MAX_MEMO = 800_000
PUNCT = r"[!-&(-/:-@\[-`{-~]"
#: A stop or comma that closes a stretch right after a character which may belong to the same token.
STOPS = re.compile(r"[^A-Za-z0-9À-ÖØ-öø-ÿ][.,][ \n]")
SIMPLE = re.compile(rf"({PUNCT}*)([A-Za-zÀ-ÖØ-öø-ÿ]+)({PUNCT}*)")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        if len(vocab) >= PAD:
            raise ValueError("the vocabulary is too large for 16-bit ids")
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        keys, made = [], []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(vocab[a] << 16 | vocab[b])
            made.append(vocab[a + b])
        keys = np.array(keys, np.uint32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), np.array(made, np.int32)
        self.memo: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers."""
        out: list = [b""] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lens, kind="stable")
        sizes = lens[order]
        i = 0
        while i < len(order):
            widest = sizes[i] + sizes[i] // 4 + 1
            j = min(int(np.searchsorted(sizes, widest, side="right")), i + max(1, CELLS // int(widest)))
            self._matrix([words[k] for k in order[i:j]], sizes[i:j], order[i:j], out)
            i = j
        return out

    def _matrix(self, words: list[bytes], lens: np.ndarray, places: np.ndarray, out: list) -> None:
        width = int(lens.max())
        cols = np.arange(width)
        inside = cols < lens[:, None]
        at = np.zeros(inside.shape, np.uint8)
        at[inside] = np.frombuffer(b"".join(words), np.uint8)
        m = np.where(inside, self.inner[at], np.int32(PAD))
        rows = np.arange(len(words))
        m[rows, lens - 1] = self.last[at[rows, lens - 1]]
        r = self.ranks(m[:, :-1], m[:, 1:]) if width > 1 else np.empty((len(words), 0), np.int32)
        while True:
            if r.shape[1]:
                first = r.argmin(1)
                best = r[rows, first]
                live = best < NONE
            else:
                live = np.zeros(len(m), bool)
            if not live.all():
                done = m[~live]
                raw, step = done.astype("<u4").tobytes(), 4 * done.shape[1]
                for k, (place, n) in enumerate(zip(places[~live].tolist(), (done != PAD).sum(1).tolist(), strict=True)):
                    out[place] = raw[k * step : k * step + 4 * n]
                if not live.any():
                    return
                m, r, places, first, best = m[live], r[live], places[live], first[live], best[live]
            rows = np.arange(len(m))
            m[rows, first] = self.made[best]
            width = m.shape[1] - 1
            cols = np.arange(width)
            m = np.take_along_axis(m, cols + (cols > first[:, None]), 1)
            cols = np.arange(width - 1)
            r = np.take_along_axis(r, cols + (cols >= first[:, None]), 1)
            left = np.flatnonzero(first > 0)
            r[left, first[left] - 1] = self.ranks(m[left, first[left] - 1], m[left, first[left]])
            right = np.flatnonzero(first < width - 1)
            r[right, first[right]] = self.ranks(m[right, first[right]], m[right, first[right] + 1])

    def learn(self, stretches: set[str]) -> None:
        """Put the ids of these stretches of text without spaces into the memo."""
        new = stretches - self.memo.keys()
        if len(self.memo) + len(new) > MAX_MEMO:
            self.memo.clear()
            new = stretches
        plain, parts, hard = [], [], []
        for s in new:
            if s.isalpha() and len(s) <= MAX_WORD and (s.isascii() or max(s) <= "ÿ"):
                plain.append(s)
            elif len(s) <= MAX_WORD and (found := SIMPLE.fullmatch(s)):
                parts.append((s, [x.lower().encode() for x in found.groups() if x]))
            elif s:
                hard.append(s)
        words = {w: i for i, w in enumerate({x for _, own in parts for x in own})}
        ids = self.merge([*words, *[s.lower().encode() for s in plain]])
        self.memo.update(zip(plain, ids[len(words) :], strict=True))
        for s, own in parts:
            self.memo[s] = b"".join([ids[words[x]] for x in own])
        for at in range(0, len(hard), 1000):
            some = hard[at : at + 1000]
            for s, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.memo[s] = np.array(e.ids, "<u4").tobytes()
        self.memo[""] = b""

    def stretches(self, text: str) -> list[str]:
        """The text at its spaces and line breaks, lower-cased and with closing stops and commas apart where that changes no token."""
        if "Σ" not in text and "İ" not in text and not STOPS.search(text):
            text = text.lower().replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.stretches(t) for t in texts]
        self.learn(set().union(*split))
        get = self.memo.__getitem__
        return [b"".join(map(get, s)) for s in split]
