"""Cross-tokenizer alignment: groups of tokens of two vocabularies that cover the same bytes, and how ids link.

A text is encoded by a byte-level BPE (A) and a sentencepiece model (B). In a
chunk of texts every token of either side points to its farthest-right
overlapping token: the one of the other side that covers its last byte, if
that one ends later, else itself. Doubling the pointers (``p = p[p]``) brings
every token to the last token of its group in log2(longest chain) rounds; the
end of that token labels the group. Where two last tokens end together they
link. Links are counted by pair of ids over the whole corpus, and each link
is compared with the highest count of its B id.

Chunks are kept as blocks, one row each: what its documents have, its distinct
pairs with their counts, and for each link the place of its pair. Counting
moves one row for each distinct pair of a block, never links or texts; the only
table that is broadcast has one row for each B id (the vocabulary bounds it).

Null and empty texts, and texts whose tokens don't give back a blank and the
text (U+2581 becomes a blank, say), have no tokens: zeros and an empty string.
Repeated rows are rows of their own and count again. Ties for the highest count
are all best. An empty table gives no rows; other columns don't matter,
whatever their names. A text is encoded whole, however long; the longest one
bounds a block's memory (about 60 bytes for each of its bytes).
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.llm.bpe import CACHE_PIECES, Encoder, PieceCache, Ranks
from relyframe.llm.common import Rolling, byte_values, chunks, id_text
from relyframe.session import scratch_path

#: Bytes of text in a block, at least; a block ends with the chunk that passes it.
BLOCK_BYTES = 4_000_000
#: Blocks in a file. A file's rows are held together by its writer and by its readers, so this bounds both, whatever the input.
FILE_BLOCKS = 8
#: Characters handled at once.
CHUNK = 300_000
SPACE_MARK = "▁"

BLOCK = ("blk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
         "sha array<string>, groups array<string>, codes binary, pair array<long>, n array<long>")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string, groups string")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class JsonRanks(Ranks):
    """The ranks of a byte-level vocabulary in the tokenizers library's format; added tokens are plain text here."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = byte_alphabet()
        spelled = {token: bytes(of[ch] for ch in token) for token in model["vocab"] if all(ch in of for ch in token)}
        ids = {spelled[token]: i for token, i in model["vocab"].items() if token in spelled}
        self.single = np.array([ids[bytes([b])] for b in range(256)], np.uint32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {spelled[a] + spelled[b] for a, b in merges}
        #: A whole piece that is a token is merged at once; ids rise with the order of merges.
        self.ranks = {t: i for t, i in ids.items() if len(t) == 1 or t in made}
        self.pairs = {ids[spelled[a]] << 32 | ids[spelled[b]]: ids[spelled[a] + spelled[b]] for a, b in merges}
        order = [self.pairs[ids[spelled[a]] << 32 | ids[spelled[b]]] for a, b in merges]
        if any(x >= y for x, y in zip(order, order[1:])):
            raise ValueError("the vocabulary's ids don't rise with its merges")
        self.keys = np.array(sorted(self.pairs), np.uint64)
        self.merged = np.array([self.pairs[k] for k in self.keys.tolist()], np.uint32)
        self.size = max(model["vocab"].values()) + 1
        self.table = [b""] * self.size
        for token, i in ids.items():
            self.table[i] = token


class Pieces:
    """sentencepiece over a chunk of texts, by cached units (blanks and what follows them up to the next blank)."""

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.table = [bytes([int(s[3:-1], 16)]) if m.is_byte(i) else s.replace(SPACE_MARK, " ").encode("utf-8")
                      for i, s in enumerate(names)]
        #: No merge reaches over the start of a run of blanks, so units are independent of each other.
        self.units = not any(SPACE_MARK in s.lstrip(SPACE_MARK) for i, s in enumerate(names)
                             if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)))
        self.blank = m.piece_to_id(SPACE_MARK)
        self.cache = PieceCache(CACHE_PIECES)

    def _encode(self, units: list[bytes]) -> list[bytes]:
        """Ids of units that begin with a blank; the model puts that blank there itself."""
        out = self.model.encode([u[1:].decode("utf-8") for u in units], num_threads=1)
        return [np.array(ids if len(u) > 1 else [self.blank], "<u4").tobytes() for u, ids in zip(units, out)]

    def encode(self, blob: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of each text's ids); the texts, each with a blank before it, are blob[at[i]:at[i + 1]]."""
        if not self.units:
            own = [np.frombuffer(x, "<u4") for x in self._encode([blob[a:b] for a, b in zip(at.tolist(), at[1:].tolist())])]
            return np.concatenate([*own, np.zeros(0, "<u4")]), np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)
        raw = np.frombuffer(blob, np.uint8)
        start = raw == 0x20
        start[1:] &= raw[:-1] != 0x20
        start[at[at < len(raw)]] = True
        start = np.flatnonzero(start)
        bounds = np.concatenate((start, [len(raw)]))
        h = Rolling(byte_values(raw)).windows(start, np.diff(bounds))
        h[h == 0] = 1
        slot = self.cache.find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            if self.cache.size + len(first) > self.cache.limit:
                self.cache = PieceCache(max(self.cache.limit, len(h)))
                new = np.arange(len(h))
                _, first = np.unique(h, return_index=True)
            own = new[first]
            self.cache.add(h[own], self._encode([blob[a:b] for a, b in zip(start[own].tolist(), bounds[own + 1].tolist())]))
            slot[new] = self.cache.find(h[new])
        ids, n = self.cache.ids(slot)
        return ids, np.concatenate(([0], np.cumsum(n)))[np.searchsorted(start, at)]


@lru_cache(2)
def coder_a(path: str) -> tuple[Encoder, JsonRanks]:
    ranks = JsonRanks(path)
    return Encoder(ranks.merge), ranks


@lru_cache(2)
def coder_b(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(4)
def _decimals(size: int) -> list[bytes]:
    """Each id in decimal, followed by a comma, a bar, a semicolon or nothing."""
    return [b"%d" % i + end for i in range(size) for end in (b",", b"|", b";", b"")]


def last_tokens(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """For each token, A's then B's, the last token of its group, by pointer jumping.

    Ends rise strictly on both sides and have the same last value.
    """
    n = len(end_a)
    over_a = np.searchsorted(end_b, end_a)  # the token of the other side that covers the last byte
    over_b = np.searchsorted(end_a, end_b)
    p = np.concatenate((np.where(end_b[over_a] > end_a, n + over_a, np.arange(n)) if n else np.zeros(0, np.int64),
                        np.where(end_a[over_b] > end_b, over_b, n + np.arange(len(end_b))) if n else np.zeros(0, np.int64)))
    while True:
        further = p[p]
        if np.array_equal(further, p):
            return p
        p = further


class Aligned:
    """The tokens of a chunk's texts, their groups and links. Texts without tokens have none."""

    def __init__(self, texts: list[str], a: Encoder, ranks: JsonRanks, b: Pieces):
        texts = [" " + t if t and SPACE_MARK not in t else "" for t in texts]
        ids_a, at_a, blob, _ = a.encode(texts)
        size = np.fromiter((len(t.encode("utf-8")) for t in texts), np.int64, len(texts))
        at = np.concatenate(([0], np.cumsum(size)))
        ids_b, at_b = b.encode(blob, at) if len(blob) else (np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64))
        width_a = np.fromiter(map(len, ranks.table), np.int64, ranks.size)[ids_a]
        width_b = np.fromiter(map(len, b.table), np.int64, len(b.table))[ids_b]
        good = _same(at_a, width_a, ranks.table, ids_a, blob, at) & _same(at_b, width_b, b.table, ids_b, blob, at) & (size > 0)
        if not good.all():
            keep_a, keep_b = np.repeat(good, np.diff(at_a)), np.repeat(good, np.diff(at_b))
            ids_a, width_a, ids_b, width_b = ids_a[keep_a], width_a[keep_a], ids_b[keep_b], width_b[keep_b]
        self.n_a, self.n_b = np.where(good, np.diff(at_a), 0), np.where(good, np.diff(at_b), 0)
        end_a, end_b = np.cumsum(width_a), np.cumsum(width_b)
        last = last_tokens(end_a, end_b)
        n = len(ids_a)
        ends = np.concatenate((end_a, end_b))[last]  # labels
        last_a, last_b = np.flatnonzero(last[:n] == np.arange(n)), np.flatnonzero(last[n:] == n + np.arange(len(ids_b)))
        label = end_a[last_a]
        group_a, group_b = np.searchsorted(label, ends[:n]), np.searchsorted(label, ends[n:])
        doc_end = np.cumsum(np.where(good, size, 0))
        self.n_groups = np.diff(np.searchsorted(label, doc_end, side="right"), prepend=0)
        #: Links in order of their ends: tokens of both sides that end together.
        self.link_a, self.link_b = ids_a[last_a].astype(np.int64), ids_b[last_b].astype(np.int64)
        self.n_links = np.diff(np.searchsorted(end_a[last_a], doc_end, side="right"), prepend=0)
        self._written(ids_a, ids_b, group_a, group_b, last_a, last_b, label, doc_end, max(ranks.size, len(b.table)))

    def _written(self, ids_a, ids_b, group_a, group_b, last_a, last_b, label, doc_end, size):
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        n = len(label)
        before_a = np.searchsorted(group_a, np.arange(n + 1))
        before_b = np.searchsorted(group_b, np.arange(n + 1))
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        end = np.zeros(len(ids_a), np.int64)
        end[last_a] = 1
        code[np.arange(len(ids_a)) + before_b[group_a]] = ids_a.astype(np.int64) * 4 + end
        end = np.zeros(len(ids_b), np.int64)
        end[last_b] = np.where(np.isin(label, doc_end), 3, 2)
        code[np.arange(len(ids_b)) + before_a[group_b + 1]] = ids_b.astype(np.int64) * 4 + end
        names = _decimals(size).__getitem__
        at = np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        code = code.tolist()
        self.groups = [b"".join(map(names, code[x:y])) for x, y in zip(at, at[1:])]


def _same(at, width, table, ids, blob, want) -> np.ndarray:
    """Which texts' tokens have exactly the bytes of the text."""
    total = np.concatenate(([0], np.cumsum(width)))[at]
    if np.array_equal(total, want) and b"".join(map(table.__getitem__, ids.tolist())) == blob:
        return np.ones(len(at) - 1, bool)
    return np.array([b"".join(map(table.__getitem__, ids[x:y].tolist())) == blob[u:v] for x, y, u, v in
                     zip(at.tolist(), at[1:].tolist(), want.tolist(), want[1:].tolist())], bool)


def align_blocks(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """Rows of BLOCK: one pass over the texts without a shuffle."""

    def run(batches):
        (a, ranks), b = coder_a(path_a), coder_b(path_b)
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for ids, texts in chunks(batches, limit=CHUNK):
            held.append((ids, Aligned(texts, a, ranks, b)))
            size += sum(map(len, texts))
            if size >= BLOCK_BYTES:
                number += 1
                yield _block(number, held, keep_groups)
                held, size = [], 0
        if held:
            yield _block(number + 1, held, keep_groups)

    return id_text(docs).select("doc_id", "text").mapInArrow(run, BLOCK)


def _block(number: int, held: list, keep_groups: bool) -> pa.RecordBatch:
    parts = [x for _, x in held]
    pair = np.concatenate([x.link_b << 32 | x.link_a for x in parts])
    distinct, code, n = np.unique(pair, return_inverse=True, return_counts=True)
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    columns = [one(np.concatenate([getattr(x, c) for x in parts]), pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    groups = [g for x in parts for g in x.groups]
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), one([i for ids, _ in held for i in ids], pa.int64()), *columns,
         one([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string()),
         one([g.decode() for g in groups] if keep_groups else None, pa.string()) if keep_groups else
         pa.nulls(1, pa.list_(pa.string())),
         pa.array([code.astype("<u4").tobytes()], pa.binary()), one(distinct, pa.int64()), one(n, pa.int64())],
        ["blk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "groups", "codes", "pair", "n"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (B id * 2**32 + A id), total, best (whether no pair of the B id has a higher total), over all blocks."""
    spark = blocks.sparkSession
    each = blocks.select(F.explode(F.arrays_zip("pair", "n")).alias("x")).select("x.pair", "x.n")
    at = scratch_path(spark, "pair-counts")
    each.groupBy("pair").agg(F.sum("n").alias("total")).write.parquet(at)
    totals = spark.read.parquet(at).withColumn("b", F.shiftright("pair", 32))
    top = totals.groupBy("b").agg(F.max("total").alias("top"))  # one row for each id of B's vocabulary at most
    return totals.join(F.broadcast(top), "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups), by row of ``docs``.

    ``path_a`` and ``path_b`` must exist on every executor.
    """
    spark = docs.sparkSession
    at = scratch_path(spark, "aligned")
    align_blocks(docs, path_a, path_b, keep_groups).write.option("compression", "zstd").option("maxRecordsPerFile", FILE_BLOCKS).parquet(at)
    blocks = spark.read.parquet(at)
    asked = blocks.select("blk", F.posexplode("pair").alias("place", "pair"))
    answers = asked.join(pair_counts(blocks), "pair").select("blk", "place", "total", "best")
    kept = spark.read.parquet(at).drop("pair", "n")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0] for c in left.schema.names}
        total, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        place = right.column("place").to_numpy()
        total[place] = right.column("total").to_numpy()
        best[place] = right.column("best").to_numpy()
        code = np.frombuffer(row["codes"].as_py(), "<u4")
        bounds = np.concatenate(([0], np.cumsum(row["n_links"].values.to_numpy())))
        sums = [np.diff(np.concatenate(([0], np.cumsum(x[code])))[bounds]) for x in (best, total)]
        groups = row["groups"].values if row["groups"].is_valid else pa.nulls(len(row["sha"].values), pa.string())
        return pa.table([row["doc_id"].values, *[row[c].values for c in ("n_a", "n_b", "n_groups", "n_links")],
                         *map(pa.array, sums), row["sha"].values, groups], names=[c.split()[0] for c in RESULT.split(", ")])

    out = kept.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(finish, RESULT)
    return out if keep_groups else out.drop("groups")
