"""Byte-level BPE by a segment tree over byte positions.

A leaf holds ``rank << 32 | position`` of the pair that starts at a live position, so the smallest value of the tree is
the leftmost pair of the lowest rank. A merge changes three leaves (the pair itself, its right part and the neighbour to
the left) and their ancestors, a logarithmic number of nodes. Words of one length class are worked on side by side, one
row of arrays each, so that every step is a few array operations for all of them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, slices, worker_cache
from tidemark.llm.tokens import UNIT, Units

NONE = np.int64(1) << np.int64(62)
POSITION = np.int64((1 << 32) - 1)
ROWS_BYTES = 1 << 22  # positions worked on at a time


class Merges:
    """Ranks of a vocabulary: byte strings, and pairs of ids whose bytes together are in it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge; a negative id has no pair."""
        keys = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.values[at], -1)


def merge_rows(words: list[bytes], width: int, merges: Merges) -> list[np.ndarray]:
    """Ids of words of at most ``width`` bytes, a power of two."""
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
    places = np.arange(width, dtype=np.int64)
    live = places[None, :] < lengths[:, None]
    token = np.full((n, width + 1), -1, np.int64)  # the last column stands for "no neighbour"
    token[:, :width] = np.where(live, merges.single[data], -1)
    after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
    before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
    before[:, 0] = width
    after[:, width] = width
    after[np.arange(n), lengths - 1] = width
    rank = merges.rank(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width)
    tree = np.full((n, 2 * width), NONE, np.int64)
    tree[:, width:] = np.where(rank >= 0, (rank << np.int64(32)) | places, NONE)
    level = width
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        best = tree[rows, 1]
        at, merged = best & POSITION, best >> np.int64(32)
        right = after[rows, at]
        follow = after[rows, right]
        token[rows, at] = merged
        token[rows, right] = -1
        after[rows, at] = follow
        before[rows, follow] = at
        token[rows, width] = -1
        left = before[rows, at]
        changed = np.stack([at, left, right])
        pair = merges.rank(np.concatenate([merged, token[rows, left]]), np.concatenate([token[rows, follow], merged]))
        pair = np.concatenate([pair, np.full(len(rows), -1)]).reshape(3, -1)
        value = np.where(pair >= 0, (pair << np.int64(32)) | changed, NONE)
        inside = changed < width  # a word's first token has no left neighbour
        which = np.broadcast_to(rows, changed.shape)[inside]
        node = changed[inside] + width
        tree[which, node] = value[inside]
        while node[0] > 1:
            node >>= 1
            tree[which, node] = np.minimum(tree[which, 2 * node], tree[which, 2 * node + 1])
        rows = rows[tree[rows, 1] != NONE]
    return [row[row >= 0] for row in token[:, :width]]


def encode_words(words: list[bytes], merges: Merges) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit bytes; a word that is itself a token is not merged."""
    out: list[bytes] = [b""] * len(words)
    classes: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        known = merges.ranks.get(word)
        if known is not None:
            out[i] = known.to_bytes(4, "little")
        elif word:
            classes.setdefault(1 << (len(word) - 1).bit_length(), []).append(i)
    for width, members in classes.items():
        step = max(1, ROWS_BYTES // (16 * width))
        for start in range(0, len(members), step):
            part = members[start : start + step]
            for i, ids in zip(part, merge_rows([words[i] for i in part], width, merges), strict=True):
                out[i] = ids.astype("<u4").tobytes()
    return out


class RankUnits(Units):
    """Ids of white-space delimited units by a rank file; each match of ``pattern`` is encoded on its own. Units and words
    are forgotten once ``limit`` of them are held."""

    limit = 700_000  # about 140 MB

    def __init__(self, path: str, pattern: str):
        import regex

        super().__init__()
        self.merges, self.pattern = Merges.load(path), regex.compile(pattern)
        self.words: dict[str, bytes] = {}

    def learn(self, texts: list[list[str]]) -> None:
        """Encode all units of some texts that are not known yet, all their new words at once."""
        if len(self) > self.limit:
            self.clear()
        if len(self.words) > self.limit:
            self.words.clear()
        new = {unit: self.pattern.findall(unit) for unit in set().union(*texts) if unit not in self}
        words = list({w for found in new.values() for w in found if w not in self.words})
        self.words.update(zip(words, encode_words([w.encode() for w in words], self.merges), strict=True))
        for unit, found in new.items():
            self[unit] = b"".join([self.words[w] for w in found])

    def texts(self, texts: list[str]) -> list[bytes]:
        units = [UNIT.findall(t) for t in texts]
        self.learn(units)
        return [b"".join(map(self.__getitem__, u)) for u in units]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merges.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def rank_units(path: str, pattern: str) -> RankUnits:
    return worker_cache(f"ranks:{path}:{pattern}", lambda: RankUnits(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every text; ``ids`` are little-endian unsigned 32-bit numbers.

    A null text counts as empty and has no ids. Repeated rows and null ids are kept as they are. Every text is encoded
    whole; the words of many texts are merged together, and a worker keeps the ids of a bounded number of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        units = rank_units(path, pattern)
        for ids, texts in slices(batches):
            yield {"doc_id": ids, "ids": units.texts([t or "" for t in texts])}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids stand for; an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        units = rank_units(path, pattern)
        for doc_ids, ids in slices(batches):
            yield {"doc_id": doc_ids, "ids": ids, "decoded": [units.decode(i) for i in ids]}

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text: encoded, then decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        units = rank_units(path, pattern)
        for doc_ids, texts in slices(batches):
            found = units.texts([t or "" for t in texts])
            yield {
                "doc_id": doc_ids,
                "n_tokens": [len(i) // 4 for i in found],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in found],
                "decoded_sha256": [hashlib.sha256(units.decode(i)).hexdigest() for i in found],
            }

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
