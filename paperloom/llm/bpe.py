"""Byte-level BPE encoding and decoding by a segment tree over adjacent pair ranks.

The leaves of a word's tree are the ranks of its adjacent symbol pairs, a node holds the smallest
(rank, position) below it, so the root is the leftmost pair of the lowest rank. A merge changes at
most three leaves, each a path of log2(n) nodes. Short words are encoded many at a time: their trees
are rows of one NumPy matrix and every step merges one pair in each row. Long words have a tree of
their own. Words already met are kept in a bounded cache of the Python worker.

Defined results: null text counts as empty (no ids, empty decoded text); repeated rows give repeated
results; an empty table gives an empty result; columns other than the id and the text are ignored.
A text is never cut: one very long word costs O(n log n).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .arrow_io import id_and_text, map_arrow, runs_of_chars, struct

SCHEMA = "doc_id long, ids array<int>, decoded string"
#: Words of up to this many bytes share a matrix of trees.
SHORT = 64
#: Words kept by a Python worker; the cache only saves time.
CACHE_WORDS = 250_000
NONE = np.int64(1) << 62
POS_BITS = 32
#: Fixed value: how the byte-level scheme splits a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairs:
    """The vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.pieces: dict[int, bytes] = {i: bytes(symbols[c] for c in piece) for piece, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: text.encode() for text, i in self.special.items()}
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = regex.compile(WORD_PATTERN).findall
        by_byte = {bytes_[0]: i for i, bytes_ in self.pieces.items() if len(bytes_) == 1}
        self.byte_ids = np.array([by_byte[b] for b in range(256)], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], NONE), np.append(order, 0)
        self.cache: dict[str, bytes] = {}

    # -- one long word -------------------------------------------------------------------------
    def encode_long(self, data: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(data, np.uint8)].tolist()
        n = len(ids)
        none, rank_of, merged = int(NONE), self.rank_of, self.merged
        leaves = 1 << max(1, n - 1).bit_length()
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            rank = rank_of.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[leaves + i] = rank << POS_BITS | i
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def put(i: int, left: int, right: int) -> None:
            rank = rank_of.get(left << 32 | right) if right >= 0 else None
            node, value = leaves + i, none if rank is None else rank << POS_BITS | i
            while node and tree[node] != value:
                tree[node] = value
                node >>= 1
                value = min(tree[2 * node], tree[2 * node + 1]) if node else none

        while n > 1 and tree[1] != none:
            rank, i = tree[1] >> POS_BITS, tree[1] & (1 << POS_BITS) - 1
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i] = int(merged[rank]), -1, k
            if k < n:
                before[k] = i
            put(j, 0, -1)
            put(i, ids[i], ids[k] if k < n else -1)
            if before[i] >= 0:
                put(before[i], ids[before[i]], ids[i])
        return [x for x in ids if x >= 0]

    # -- many short words ----------------------------------------------------------------------
    def lookup(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaf values of pairs; NONE where a side is missing or the pair does not merge."""
        key = np.where((left >= 0) & (right >= 0), left << 32 | np.maximum(right, 0), -1)
        found = np.searchsorted(self.keys, key)
        return np.where(self.keys[found] == key, self.ranks[found] << POS_BITS | at, NONE)

    def encode_short(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Words of at most leaves + 1 bytes, a tree for each row."""
        n, width = len(words), leaves + 1
        length = np.fromiter(map(len, words), np.int64, n)
        ids = np.full((n, width + 1), -1, dtype=np.int64)  # the last column stands for "no symbol"
        inside = np.arange(width + 1) < length[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((n, 2 * leaves), NONE, dtype=np.int64)
        tree[:, leaves:] = self.lookup(ids[:, :leaves], ids[:, 1 : leaves + 1], np.arange(leaves))
        level = leaves
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.minimum(np.arange(1, width + 2), width) * np.ones((n, 1), np.int64)
        after = np.where(after < length[:, None], after, width)
        before = np.arange(-1, width) * np.ones((n, 1), np.int64)
        rows = np.nonzero(tree[:, 1] != NONE)[0]
        while len(rows):
            root = tree[rows, 1]
            i = root & (1 << POS_BITS) - 1
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], ids[rows, j] = self.merged[root >> POS_BITS], -1
            after[rows, i] = k
            before[rows, k] = i
            p = before[rows, i]
            new, q = ids[rows, i], np.where(p >= 0, p, width)
            tree[rows, leaves + np.minimum(j, leaves - 1)] = np.where(j < leaves, NONE, tree[rows, 2 * leaves - 1])
            last = i >= leaves
            tree[rows, leaves + np.minimum(i, leaves - 1)] = np.where(last, tree[rows, 2 * leaves - 1], self.lookup(new, ids[rows, k], i))
            has = p >= 0
            tree[rows[has], leaves + p[has]] = self.lookup(ids[rows[has], q[has]], new[has], p[has])
            a, b, c = leaves + np.minimum(j, leaves - 1), leaves + np.minimum(i, leaves - 1), leaves + np.maximum(p, 0)
            level = leaves
            while level > 1:
                a, b, c, level = a >> 1, b >> 1, c >> 1, level >> 1
                for node in (a, b, c):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            rows = rows[tree[rows, 1] != NONE]
        kept = ids >= 0
        flat, ends = ids[kept].astype("<i4").tobytes(), np.concatenate([[0], np.cumsum(kept.sum(1)) * 4]).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each word."""
        out: dict[str, bytes] = {}
        groups: dict[int, list[str]] = {}
        coded = {w: w.encode() for w in words}
        for w, data in coded.items():
            if len(data) > SHORT:
                out[w] = np.array(self.encode_long(data), dtype="<i4").tobytes()
            elif len(data) == 1:
                out[w] = self.byte_ids[data[0]].astype("<i4").tobytes()
            else:
                groups.setdefault(1 << (len(data) - 2).bit_length() if len(data) > 2 else 1, []).append(w)
        for leaves, group in groups.items():
            out.update(zip(group, self.encode_short([coded[w] for w in group], leaves)))
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts: list[list[str | bytes]] = []
        for text in texts:
            own: list[str | bytes] = []
            at = 0
            for m in self.split.finditer(text) if self.split else ():
                own += self.words(text[at : m.start()])
                own.append(np.array([self.special[m[0]]], dtype="<i4").tobytes())
                at = m.end()
            own += self.words(text[at:] if at else text)
            parts.append(own)
        cache = self.cache
        new = {w for own in parts for w in own if w not in cache}
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = {w for own in parts for w in own}
        ready = {w for w in new if isinstance(w, bytes)}
        made = self.encode_words(list(new - ready)) | {w: w for w in ready}
        cache.update((w, x) for w, x in made.items() if len(w) <= SHORT)
        found = cache if all(len(w) <= SHORT for w in made) else cache | made
        return [b"".join(map(found.__getitem__, own)) for own in parts]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, BytePairs] = {}


def load(path: str) -> BytePairs:
    """The tokenizer at this path, read once by each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = BytePairs(path)
    return _LOADED[path]


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for each row: the ids of its text and the text those ids decode to.

    A narrow map: no shuffle, whole texts, about a million characters at a time in a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        pairs = load(tokenizer_path)
        for batch in batches:
            for ids, texts in runs_of_chars(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = pairs.encode_batch(texts)
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
                values = np.frombuffer(b"".join(coded), "<i4")
                yield {
                    "doc_id": ids,
                    "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                    "decoded": [pairs.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:])],
                }

    return map_arrow(id_and_text(df, id_col, text_col), run, struct(SCHEMA))
