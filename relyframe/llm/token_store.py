"""Token ids on disk: canonical length-limited Huffman codes in independent blocks.

Texts are encoded with the tokenizers library. Its pre-tokeniser splits as
the code-point scan of :mod:`bpe` does, so each distinct piece is given to
the library once and kept in the bounded cache. A vocabulary of another kind,
or a text that holds an added token, is given to the library whole.

Format: a folder with ``code`` (id, code length: the canonical code follows
from it) and ``ids``, whose files hold blocks in ascending doc_id order. A
block has the documents' ids and lengths, the bits of all their tokens and
the bit offset of every ``STRIDE``-th token, so it is decoded alone, and all
strides of it at once. Lengths are at most ``LIMIT`` bits, which makes the
decoder one table look-up a token.

Null text is empty (only the end id). A null doc_id comes first; documents
with the same id follow each other by the hash of their tokens. An empty table gives
an empty store.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relyframe.llm.bpe import Encoder
from relyframe.llm.common import chunks, id_text
from relyframe.session import scratch_path

LIMIT = 16
STRIDE = 512
#: Pieces that are given to the library at once.
RUN = 2_000
#: Tokens in a block; a longer document is a block of its own.
BLOCK_TOKENS = 500_000
BLOCK = "part int, first long, doc_ids binary, null_ids binary, counts binary, n long, bits binary, checkpoints binary"


class Library:
    """The tokenizers library behind the piece cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.pieces = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                       and pre.get("use_regex", True) and not pre.get("add_prefix_space", True))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.encoder = Encoder(self._merge)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.width = np.zeros(self.size, np.int64)  # bytes of each id: a character of its name stands for a byte
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece. Pieces that are a blank and something else are given to the library in
        runs: it splits them before each blank, so the ids' byte lengths tell where pieces end."""
        texts = [p.decode("utf-8") for p in pieces]
        out = [b""] * len(pieces)
        run = [i for i, t in enumerate(texts) if t[0] == " " and len(t) > 1 and not t.isspace()]
        own = set(run)
        rest = [i for i in range(len(pieces)) if i not in own]
        for i, ids in zip(rest, self._whole([texts[i] for i in rest])):
            out[i] = ids.tobytes()
        groups = [run[k:k + RUN] for k in range(0, len(run), RUN)]
        for group, ids in zip(groups, self._whole(["".join([texts[i] for i in g]) for g in groups])):
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(pieces[i]) for i in group])) + 1
            raw, lo = ids.tobytes(), 0
            for i, hi in zip(group, (4 * ends).tolist()):
                out[i], lo = raw[lo:hi], hi
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.pieces:
            return self._whole(texts)
        ids, at, _, _ = self.encoder.encode(texts)
        out = [ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]
        odd = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if odd:
            for i, own in zip(odd, self._whole([texts[i] for i in odd])):
                out[i] = own
        return out


@lru_cache(2)
def library(path: str) -> Library:
    return Library(path)


def id_type(path: str, end_id: int) -> str:
    """16 bits an id where the vocabulary allows it."""
    return "<u2" if max(library(path).size, end_id + 1) <= 1 << 16 else "<u4"


def tokenise(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids: little-endian ids (of ``id_type``) of each text and the end id."""
    kind = id_type(path, end_id)

    def run(batches):
        lib, end = library(path), np.array([end_id], kind).tobytes()
        for ids, texts in chunks(batches):
            own = [x.astype(kind).tobytes() + end for x in lib.encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.binary())], ["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids binary")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit into codes of {limit} bits")
    if n <= 1:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    merged, kinds = leaf, []
    kinds.append(np.ones(n, bool))
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaf, pairs))
        is_leaf = np.concatenate((np.ones(n, bool), np.zeros(len(pairs), bool)))
        by = np.argsort(both, kind="stable")
        merged = both[by]
        kinds.append(is_leaf[by])
    out, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(kinds):
        leaves = int(is_leaf[:take].sum())
        out[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return out


class Code:
    """The canonical code of given lengths: codes for writing, one table of 2**LIMIT entries for reading."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        by = np.lexsort((ids, lengths))
        ids, lengths = ids[by].astype(np.int64), lengths[by].astype(np.int64)
        span = np.int64(1) << (LIMIT - lengths)  # table entries of each code
        first = np.concatenate(([0], np.cumsum(span)))[:-1]
        size = int(ids.max()) + 1 if len(ids) else 1
        self.length = np.zeros(size, np.int64)
        self.code = np.zeros(size, np.int64)
        self.length[ids], self.code[ids] = lengths, first >> (LIMIT - lengths)
        self.symbol = np.zeros(1 << LIMIT, np.int64)
        self.width = np.ones(1 << LIMIT, np.int64)
        used = int(span.sum())
        self.symbol[:used], self.width[:used] = np.repeat(ids, span), np.repeat(lengths, span)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every STRIDE-th token)."""
        if not len(ids):
            return b"", np.zeros(0, np.uint32)
        width = self.length[ids]
        at = np.cumsum(width) - width
        total = int(at[-1] + width[-1])
        word, shift = at >> 5, 64 - (at & 31) - width
        value = self.code[ids].astype(np.uint64) << shift.astype(np.uint64)  # in 64 bits from the word's first bit
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        pair = np.bitwise_or.reduceat(value, first)
        words = np.zeros((total + 31 >> 5) + 1, np.uint32)
        words[word[first]] |= (pair >> np.uint64(32)).astype(np.uint32)
        words[word[first] + 1] |= (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return words.astype(">u4").tobytes()[: total + 7 >> 3], at[::STRIDE].astype(np.uint32)

    def unpack(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All strides advance together, one token a step."""
        lanes = len(checkpoints)
        out = np.zeros((lanes, STRIDE), np.uint32)
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.int64)
        window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]  # 24 bits from each byte
        at = checkpoints.astype(np.int64)
        last = len(window) - 1
        for k in range(STRIDE):
            entry = window[np.minimum(at >> 3, last)] >> (24 - LIMIT - (at & 7)) & ((1 << LIMIT) - 1)
            out[:, k] = self.symbol[entry]
            at = at + self.width[entry]
        return out.reshape(-1)[:n]


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Tokenise, count, build the code, and write the store in ascending doc_id order."""
    spark = docs.sparkSession
    at = scratch_path(spark, "token-ids")
    tokenise(docs, vocabulary, end_id).write.option("compression", "zstd").parquet(at)
    ids, kind = spark.read.parquet(at), id_type(vocabulary, end_id)

    def count(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=len(total))
            n[:len(total)] += total
            total = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counts = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted((r["id"], r["n"]) for r in counts.collect())  # as many as the vocabulary has ids
    symbols = np.array([r[0] for r in rows], np.int64)
    lengths = code_lengths(np.array([r[1] for r in rows], np.int64))
    code = spark.createDataFrame([(int(i), int(n)) for i, n in zip(symbols, lengths)], "id long, length int")
    code.coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((symbols, lengths))

    def write(batches):
        from pyspark import TaskContext

        book, part, first = Code(*shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            own = [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]
            doc, size = batch.column("doc_id").to_pylist(), np.array([len(x) for x in own], np.int64)
            group = (np.cumsum(size) - size) // BLOCK_TOKENS
            edge = np.flatnonzero(np.diff(group, prepend=-1)).tolist() + [len(own)]
            for lo, hi in zip(edge, edge[1:]):
                tokens = np.concatenate(own[lo:hi])
                bits, check = book.pack(tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([first], pa.int64()),
                     *[pa.array([x], pa.binary()) for x in (
                         np.array([d or 0 for d in doc[lo:hi]], np.int64).tobytes(),
                         np.array([d is None for d in doc[lo:hi]]).tobytes(), size[lo:hi].tobytes())],
                     pa.array([len(tokens)], pa.int64()), pa.array([bits], pa.binary()),
                     pa.array([check.tobytes()], pa.binary())], [c.split()[0] for c in BLOCK.split(", ")])
                first += len(tokens)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("ids")
    ordered = ids.withColumns({"tie": tie, "row": F.monotonically_increasing_id()}).repartitionByRange(
        parts, F.col("doc_id").asc_nulls_first(), "tie", "row").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "tie", "row").select("doc_id", "ids")
    ordered.mapInArrow(write, BLOCK).write.option("compression", "none").parquet(f"{path}/ids")


def read_store(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, with ``keep_ids``, ids, from the files."""
    code = spark.read.parquet(f"{path}/code").orderBy("id").collect()  # as many rows as the vocabulary has ids
    shared = spark.sparkContext.broadcast((np.array([r["id"] for r in code], np.int64),
                                           np.array([r["length"] for r in code], np.int64)))
    blocks = spark.read.parquet(f"{path}/ids")
    names = ["doc_id", "part", "within", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches):
        book = Code(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids = book.unpack(row["bits"], np.frombuffer(row["checkpoints"], np.uint32), row["n"])
                size = np.frombuffer(row["counts"], np.int64)
                end = np.cumsum(size)
                raw = ids.astype("<u4").tobytes()
                own = [raw[4 * (b - n):4 * b] for b, n in zip(end.tolist(), size.tolist())]
                cols = [pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["null_ids"], bool)),
                        pa.array([row["part"]] * len(size), pa.int32()), pa.array(row["first"] + end - size),
                        pa.array(size), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(own, pa.binary())] * keep_ids, names)

    docs = blocks.mapInArrow(run, "doc_id long, part int, within long, n_tokens long, ids_crc32 long"
                                  + ", ids binary" * keep_ids)
    total = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    total = total.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return docs.join(total, "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"),
                                           "n_tokens", "ids_crc32", *["ids"] * keep_ids)
