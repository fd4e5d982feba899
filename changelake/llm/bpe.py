"""Byte-pair merging of many pre-tokens at once, on ragged numpy arrays.

All pre-tokens of a batch lie behind one another in one array of symbol ids, with the bounds of each.
A round looks up the rank of every adjacent pair, finds the lowest rank of each pre-token, and merges
the leftmost pair of that rank in every pre-token at the same time. Pre-tokens without a known pair
are done and leave the array. The number of rounds is the largest number of merges of one pre-token;
longer ones than ``LONG`` bytes are merged on a heap instead, one at a time, with the same result.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from changelake.llm.text import ragged

LONG = 96


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files (a fixed public mapping:
    printable Latin-1 stands for itself, the others follow from U+0100 on)."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Pair (left, right) -> (rank, merged symbol), held as sorted arrays."""

    def __init__(self, size: int, byte_ids: np.ndarray, left, right, rank, merged):
        self.size = size                                  # number of symbols
        self.byte_ids = byte_ids                          # symbol of each byte
        key = np.asarray(left, np.int64) * size + np.asarray(right, np.int64)
        order = np.argsort(key)
        self.key = key[order]
        self.rank = np.asarray(rank, np.int64)[order]
        self.merged = np.asarray(merged, np.int64)[order]
        # open addressing with linear probing: a pair is found by a few gathers
        bits = max(4, int(4 * len(key)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._slot = np.full(1 << bits, -1, np.int64)
        todo, at = np.arange(len(key)), self._home(self.key)
        while len(todo):
            free = self._slot[at] < 0
            self._slot[at[free]] = todo[free]
            lost = self._slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self._mask
        self._slot_key = np.where(self._slot >= 0, self.key[np.maximum(self._slot, 0)], -1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair among the merges, -1 if there is none."""
        key = left * self.size + right
        out = np.full(len(key), -1, np.int64)
        todo, at = np.arange(len(key)), self._home(key)
        while len(todo):
            there = self._slot_key[at]
            hit = there == key[todo]
            out[todo[hit]] = self._slot[at[hit]]
            more = ~hit & (there >= 0)
            todo, at = todo[more], (at[more] + 1) & self._mask
        return out

    def encode(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, bounds): those of words[i] are symbols[bounds[i]:bounds[i + 1]]."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        begin = np.cumsum(size) - size
        long = np.flatnonzero(size > LONG)
        done: dict[int, np.ndarray] = {int(i): self._merge_one(data[begin[i]:begin[i] + size[i]]) for i in long}
        short = np.flatnonzero((size > 0) & (size <= LONG))
        count, parts = np.zeros(len(words), np.int64), []
        ids = data[ragged(begin[short], size[short])]
        word, length = short, size[short]
        while len(word):
            ids, word, length, gone = self._round(ids, word, length)
            if len(gone[1]):
                parts.append(gone)
        for i, x in done.items():
            parts.append((x, np.array([i]), np.array([len(x)])))
        for _, w, n in parts:
            count[w] = n
        bounds = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(bounds[-1], np.int64)
        for x, w, n in parts:
            out[ragged(bounds[w], n)] = x
        return out, bounds

    def _round(self, ids, word, length):
        """One merge in each pre-token; returns what goes on and what is done."""
        begin = np.cumsum(length) - length
        pair = self.find(ids[:-1], ids[1:]) if len(ids) > 1 else np.zeros(0, np.int64)
        pair = np.append(pair, -1)
        pair[begin + length - 1] = -1                      # no pair across pre-tokens
        none = np.int64(1) << 62
        # rank and position in one number: the least one is the leftmost pair of the lowest rank
        best = np.where(pair >= 0, self.rank[pair] * (1 << 32) + np.arange(len(ids)), none)
        least = np.minimum.reduceat(best, begin)
        more = least < none
        at = least[more] & ((1 << 32) - 1)
        ids[at] = self.merged[pair[at]]
        keep = np.repeat(more, length)
        over = ~keep
        done = (ids[over], word[~more], length[~more])
        keep[at + 1] = False
        return ids[keep], word[more], length[more] - 1, done

    @lru_cache(maxsize=1)  # noqa: B019 - one table per worker
    def _dict(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.merged.tolist())))

    def _merge_one(self, ids: np.ndarray) -> np.ndarray:
        """The same for one long pre-token: a heap of pairs over a linked list, n log n."""
        pairs, size = self._dict(), self.size
        sym = ids.tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (hit := pairs.get(sym[i] * size + sym[j])):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[j], hit[1]))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = merged, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in sym if x >= 0], np.int64)


@lru_cache(maxsize=2)
def load_ranks(path: str) -> tuple[Merges, list[bytes]]:
    """Merges of a rank file (base64 bytes and rank a line) and the bytes of each id. A pair may merge
    when the joined bytes have a rank, which is also its priority."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = max(ranks.values()) + 1
    left, right, rank = [], [], []
    for token, r in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                rank.append(r)
    table = [b""] * size
    for token, r in ranks.items():
        table[r] = token
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    return Merges(size, byte_ids, left, right, rank, rank), table


@lru_cache(maxsize=2)
def load_merges(path: str) -> tuple[Merges, dict[str, int]]:
    """Merges of a tokenizers file with a byte-level BPE model, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, pairs = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [p if isinstance(p, list) else p.split(" ") for p in pairs]
    ids = np.zeros(256, np.int64)
    for char, byte in byte_symbols().items():
        ids[byte] = vocab[char]
    size = max(vocab.values()) + 1
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return Merges(size, ids, [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs],
                  range(len(pairs)), [vocab[a + b] for a, b in pairs]), special


@lru_cache(maxsize=2)
def load_token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a tokenizers file with a byte-level BPE model."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte = byte_symbols()
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return table
