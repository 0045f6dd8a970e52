"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Texts of a chunk become one array of code points. A table gives each code
point its class; class changes, the code points around white space and the
contractions give the piece boundaries without a regex. "What was the last
position that fixed the state?" is an associative scan (a running maximum
over transition functions that are either constant or the identity), run
forward or backward over the whole array. Pieces are slices of the UTF-8
bytes; each distinct piece is merged once, all new pieces of a chunk
together, and kept in a bounded cache under a 64-bit hash of its bytes and
length.

Null text is empty: no ids. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relyframe.llm.common import Rolling, byte_values, chunks, id_text

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
               0x3000]
#: What may follow an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Entries kept in a worker's piece cache before it starts anew.
CACHE_PIECES = 700_000
#: Pieces over this many bytes are merged one at a time with a heap.
LONG_PIECE = 48
NONE = np.uint32(0xFFFFFFFF)


@lru_cache(1)
def class_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def last_fixed(fixed: np.ndarray) -> np.ndarray:
    """For each place the last place at or before it where ``fixed`` holds, or -1.

    Scan of transition functions under composition: a fixed place is a
    constant function, any other the identity; the later constant wins.
    """
    return np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))


def piece_starts(points: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Mask of the code points at which a piece begins; ``doc_start`` marks each text's first one."""
    n = len(points)
    if n == 0:
        return np.zeros(0, bool)
    kind = class_table()[points]
    space = kind == SPACE
    before = np.empty_like(kind)  # class of the code point before, in the same text
    before[0], before[1:] = 255, kind[:-1]
    before[doc_start] = 255
    blank_before = np.zeros(n, bool)  # a plain blank that joins what follows
    blank_before[1:] = points[:-1] == 0x20
    blank_before &= before == SPACE
    start = (kind != before) & ~(blank_before & ~space)
    # a run of white space that a text goes on after gives its last one away
    doc_end = np.zeros(n, bool)
    doc_end[:-1] = doc_start[1:]
    doc_end[-1] = True
    after = np.zeros(n, bool)
    after[:-1] = ~space[1:]
    start |= space & after & ~doc_end
    # contractions, where the apostrophe begins a piece
    rest = np.full(n + 2, -1, np.int64)
    rest[:n] = points
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        left = n - 1 - last_fixed(doc_end[::-1])[::-1] - np.arange(n)  # code points after it in its text
        size = np.zeros(len(quote), np.int64)
        for tail in CONTRACTIONS:
            ok = left[quote] >= len(tail)
            for k, ch in enumerate(tail, 1):
                ok &= rest[np.minimum(quote + k, n + 1)] == ord(ch)
            size[ok] = len(tail) + 1
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        at = quote + size
        inner = at < n
        inner[inner] = ~doc_start[at[inner]]
        at = at[inner]
        start[at] |= (kind[at] == LETTER)
    return start


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(UTF-8 of all texts, byte bounds of the pieces, each text's range of pieces as bounds)."""
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    chars = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(chars)))
    doc_start = np.zeros(len(points) + 1, bool)
    doc_start[at] = True
    start = np.flatnonzero(piece_starts(points, doc_start[:-1]))
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    place = np.concatenate(([0], np.cumsum(width)))
    bounds = np.concatenate((place[start], place[-1:]))
    return whole.encode("utf-8"), bounds, np.searchsorted(start, at)


class Ranks:
    """The ranks of a vocabulary, and the pairs of ids that merge, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.uint32)
        self.ranks, pairs = ranks, {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.uint64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.uint32)
        self.pairs = pairs
        self.size = max(ranks.values()) + 1
        table = [b""] * self.size
        for token, rank in ranks.items():
            table[rank] = token
        self.table = table

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint64) << np.uint64(32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece with a heap of pairs over a linked list: n log n for any length."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.pairs.get(ids[i] << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))
            if (p := before[i]) >= 0 and (r := self.pairs.get(ids[p] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (r, p, ids[p], ids[i]))
        return [x for x, k in zip(ids, alive) if k]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers; all short pieces advance together."""
        out: list[bytes] = [b""] * len(pieces)
        short = []
        for i, p in enumerate(pieces):
            if p in self.ranks:
                out[i] = self.ranks[p].to_bytes(4, "little")
            elif len(p) > LONG_PIECE:
                out[i] = np.array(self.merge_long(p), "<u4").tobytes()
            else:
                short.append(i)
        if not short:
            return out
        own = np.repeat(np.arange(len(short)), [len(pieces[i]) for i in short])
        ids = self.single[np.frombuffer(b"".join(pieces[i] for i in short), np.uint8)]
        done_own, done_ids = [], []
        while len(ids):
            rank = np.full(len(ids), NONE, np.uint32)
            if len(ids) > 1:
                same = np.flatnonzero(own[:-1] == own[1:])
                rank[same] = self.lookup(ids[same], ids[same + 1])
            first = np.flatnonzero(np.diff(own, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(own)))
            going = least != NONE
            keep = np.repeat(going, size)
            done_own.append(own[~keep])
            done_ids.append(ids[~keep])
            hit = np.flatnonzero((rank == np.repeat(least, size)) & keep)
            hit = hit[np.diff(own[hit], prepend=-1) != 0]  # the leftmost of each piece
            ids[hit] = rank[hit]
            keep[hit + 1] = False
            own, ids = own[keep], ids[keep]
        own, ids = np.concatenate(done_own), np.concatenate(done_ids)
        order = np.argsort(own, kind="stable")
        raw = ids[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(own, minlength=len(short))) * 4
        lo = 0
        for i, hi in zip(short, ends.tolist()):
            out[i], lo = raw[lo:hi], hi
        return out


@lru_cache(4)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


class PieceCache:
    """Ids of pieces by 64-bit hash: an open-addressing table and one pool of ids, both numpy arrays."""

    def __init__(self, limit: int):
        self.limit = limit
        self.mask = (1 << (5 * limit // 2).bit_length()) - 1
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.mask + 1, np.uint64)
        self.at = np.zeros(self.mask + 1, np.uint32)
        self.n = np.zeros(self.mask + 1, np.uint32)
        self.pool, self.used, self.size = np.zeros(4 * self.limit, np.uint32), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        key = self.key[slot]
        left = np.flatnonzero(key != h)
        slot[left[key[left] == 0]] = -1
        left = left[key[left] != 0]
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            key = self.key[slot[left]]
            slot[left[key == 0]] = -1
            left = left[(key != h[left]) & (key != 0)]
        return slot

    def add(self, h: np.ndarray, ids: list[bytes]) -> None:
        """New distinct hashes and their ids."""
        raw = np.frombuffer(b"".join(ids), "<u4")
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        if self.used + len(raw) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(raw), len(self.pool)), np.uint32)))
        at = self.used + np.cumsum(n) - n
        self.pool[self.used:self.used + len(raw)] = raw
        self.used, self.size = self.used + len(raw), self.size + len(h)
        slot, left = (h & np.uint64(self.mask)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.key[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.key[slot[own]], self.at[slot[own]], self.n[slot[own]] = h[own], at[own], n[own]
            left = left[self.key[slot[left]] != h[left]]
            slot[left] = slot[left] + 1 & self.mask

    def ids(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slots one after another, how many each has)."""
        n = self.n[slot].astype(np.int64)
        place = np.repeat(self.at[slot].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.pool[place], n


class Encoder:
    """Chunk-wise encoder. ``merge`` gives the ids of new pieces; the cache starts anew when it is full."""

    def __init__(self, merge, limit: int = CACHE_PIECES):
        self.merge, self.cache = merge, PieceCache(limit)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
        """(ids of all texts, bounds of each text's ids, UTF-8 bytes, bounds of the pieces in bytes)."""
        blob, bounds, doc = slices(texts)
        cache, start = self.cache, bounds[:-1]
        h = Rolling(byte_values(np.frombuffer(blob, np.uint8))).windows(start, np.diff(bounds))
        h[h == 0] = 1
        slot = cache.find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            if cache.size + len(first) > cache.limit:
                cache = self.cache = PieceCache(max(cache.limit, len(h))) if len(h) > cache.limit else cache
                cache.clear()
                new = np.arange(len(h))
                _, first = np.unique(h, return_index=True)
            own = new[first]
            cache.add(h[own], self.merge([blob[a:b] for a, b in zip(start[own].tolist(), bounds[own + 1].tolist())]))
            slot[new] = cache.find(h[new])
        ids, n = cache.ids(slot)
        return ids, np.concatenate(([0], np.cumsum(n)))[doc], blob, bounds


@lru_cache(4)
def encoder_of(path: str) -> Encoder:
    return Encoder(ranks_of(path).merge)


def decode(ranks: Ranks, ids: np.ndarray) -> bytes:
    return b"".join(map(ranks.table.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers; with ``keep_ids``), ids_sha256, decoded_sha256.

    One pass without a shuffle; every row is encoded whole and its ids are
    decoded again. ``path`` must exist on every executor.
    """
    schema = "doc_id long, n_tokens long, " + ("ids binary, " if keep_ids else "") + \
        "ids_sha256 string, decoded_sha256 string"

    def run(batches):
        coder, ranks = encoder_of(path), ranks_of(path)
        for ids_, texts in chunks(batches):
            ids, at, _, _ = coder.encode(texts)
            raw, rows = ids.tobytes(), []
            for a, b in zip(at.tolist(), at[1:].tolist()):
                own = raw[4 * a:4 * b]
                back = decode(ranks, ids[a:b])
                rows.append((b - a, own, hashlib.sha256(own).hexdigest(), hashlib.sha256(back).hexdigest()))
            cols = list(zip(*rows))
            arrays = [pa.array(ids_, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()),
                      pa.array(cols[2]), pa.array(cols[3])]
            names = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
            if not keep_ids:
                del arrays[2], names[2]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return id_text(docs).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, data: the bytes that the ``ids`` of each row stand for (null ids: none)."""

    def run(batches):
        ranks = ranks_of(path)
        for batch in batches:
            out = [decode(ranks, np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
