"""Byte-level BPE encoding and decoding over padded numpy matrices.

A text is split by the vocabulary's pattern into pieces; each distinct piece is encoded once. Pieces
are bucketed by length and laid out as rows of a padded matrix of token ids. In each round every row
merges its leftmost pair of least rank; pair ranks come from an open-addressing hash table that a whole
matrix looks up at once, and rows that have no pair left are written out and dropped (compaction).
Pieces of over LONG bytes, where a matrix round for each merge would take quadratic time, merge by a
heap of pairs in the same order. Each Python worker keeps the pieces it has met, CACHE at most.

Defined results: null text encodes like the empty one, to no ids; equal rows give equal rows; the whole
text is encoded whatever its length; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

VOCABULARY = "byte_bpe_50k.tiktoken"
LONG = 256
CACHE = 150_000
NONE = np.int32(np.iinfo(np.int32).max)
MIX = np.uint64(0x9E3779B97F4A7C15)


def ranks_of(path: str) -> dict[bytes, int]:
    """The rank file's tokens: base64 and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """Pair of ids -> id of the merged token, by open addressing with linear probing; lookups take arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, NONE, np.int32)
        left = np.array([a << 32 | b for a, b in pairs], np.int64)
        ids = np.array(list(pairs.values()), np.int32)
        slot = self.slots(left)
        while len(left):  # of the keys that want a free slot, one gets it; the others probe on
            free = self.keys[slot] == -1
            self.keys[slot[free]] = left[free]
            got = self.keys[slot] == left
            self.ids[slot[got]] = ids[got]
            left, ids, slot = left[~got], ids[~got], (slot[~got] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids; NONE for what doesn't merge. Ids below 0 are padding."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = -2
        flat = keys.ravel()
        slot = self.slots(flat)
        held = self.keys[slot]
        out = np.where(held == flat, self.ids[slot], NONE)
        open_ = np.flatnonzero((held != flat) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == flat[open_]
            out[open_[hit]] = self.ids[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out.reshape(keys.shape).astype(np.int32)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.decimals = {i: str(i) for i in self.tokens}
        self.bytes = np.full(256, -1, np.int32)
        for t, i in ranks.items():
            if len(t) == 1:
                self.bytes[t[0]] = i
        if (self.bytes < 0).any():
            raise ValueError("a byte-level vocabulary has a token for each byte")
        self.by_pair = {(ranks[t[:k]], ranks[t[k:]]): i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pairs = PairTable(self.by_pair)
        self.met: dict[str, tuple[int, ...]] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if piece in self.ranks:  # a whole token needs no merges
                out[k] = [self.ranks[piece]]
            elif len(piece) > LONG:
                out[k] = self.by_heap(piece)
            elif piece:
                buckets.setdefault(-(-len(piece) // 4) * 4, []).append(k)
        for width, ks in buckets.items():
            for at in range(0, len(ks), 4096):
                part = ks[at : at + 4096]
                for k, ids in zip(part, self.by_matrix([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def by_matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Pieces of at most width bytes, of two at least."""
        padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < sizes[:, None], self.bytes[padded], -1).astype(np.int32)
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        row, out, columns = np.arange(len(pieces)), [[]] * len(pieces), np.arange(width)
        while True:
            at = rank.argmin(axis=1)  # the leftmost of the least
            least = rank[np.arange(len(rank)), at]
            done = least == NONE
            if done.any():
                for k, line in zip(row[done], ids[done], strict=True):
                    out[k] = line[line >= 0].tolist()
                live = ~done
                row, ids, rank, at, least = row[live], ids[live], rank[live], at[live], least[live]
                if not len(row):
                    return out
                most = int((ids >= 0).sum(axis=1).max())
                ids, rank, columns = ids[:, :most], rank[:, : most - 1], columns[:most]
            n = np.arange(len(row))
            take = np.minimum(columns + (columns > at[:, None]), len(columns) - 1)
            ids = np.take_along_axis(ids, take, 1)
            ids[:, -1] = -1
            ids[n, at] = least
            rank = np.take_along_axis(rank, np.minimum(take[:, :-1], rank.shape[1] - 1), 1)
            rank[:, -1] = NONE
            right = np.minimum(at + 1, len(columns) - 1)
            after = self.pairs(ids[n, at], np.where(at + 1 < len(columns), ids[n, right], -1))
            inside = at < rank.shape[1]
            rank[n[inside], at[inside]] = after[inside]
            has = at > 0
            rank[n[has], at[has] - 1] = self.pairs(ids[n[has], at[has] - 1], ids[n[has], at[has]])

    def by_heap(self, piece: bytes) -> list[int]:
        """The same merges in the same order for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(r, k) for k in range(len(ids) - 1) if (r := self.by_pair.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            n = after[k] if ids[k] >= 0 else -1
            if n < 0 or self.by_pair.get((ids[k], ids[n])) != r:
                continue  # one of the two has merged since
            ids[k], ids[n], after[k] = r, -1, after[n]
            if after[k] >= 0:
                before[after[k]] = k
                if (x := self.by_pair.get((r, ids[after[k]]))) is not None:
                    heapq.heappush(heap, (x, k))
            if before[k] >= 0 and (x := self.by_pair.get((ids[before[k]], r))) is not None:
                heapq.heappush(heap, (x, before[k]))
        return [i for i in ids if i >= 0]

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.pattern.findall(t) for t in texts]
        new = list({p for pieces in split for p in pieces if p not in self.met})
        if len(self.met) + len(new) > CACHE:
            self.met = {}
            new = list({p for pieces in split for p in pieces})
        self.met.update(zip(new, map(tuple, self.encode_pieces([p.encode("utf-8", "replace") for p in new])), strict=True))
        met = self.met
        return [[i for p in pieces for i in met[p]] for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each vocabulary and Python process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBpe(ranks_of(path), pattern)
    return _codecs[path, pattern]


def in_lots(it: Iterator[tuple], chars: int = 1 << 20, rows: int = 256) -> Iterator[list[tuple]]:
    """Rows (doc_id, text, ...) in lots of about so many characters."""
    lot, size = [], 0
    for row in it:
        lot.append(row)
        size += len(row[1] or "")
        if size >= chars or len(lot) >= rows:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def encode(documents: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids array<int>, and the bytes that the ids decode to."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        bpe = codec(path, pattern)
        for lot in in_lots(it):
            for (doc, _), ids in zip(lot, bpe.encode([t or "" for _, t in lot]), strict=True):
                yield doc, ids, bpe.decode(ids)

    return map_rows(documents, ["doc_id", "text"], "doc_id long, ids array<int>, decoded binary", rows)


def digests(documents: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """What encode() gives, as counts and digests: the ids don't leave the Python worker."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        bpe = codec(path, pattern)
        for lot in in_lots(it):
            for (doc, _), ids in zip(lot, bpe.encode([t or "" for _, t in lot]), strict=True):
                yield doc, len(ids), hashlib.sha256(" ".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return map_rows(documents, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
