"""Blocks of documents and the exchange of their keys: which keys occur in another block too.

Documents are written once as blocks (a row holds the ids, lengths and bytes
of about ``block_bytes`` of text), bucketed by block, so later passes read
and join them without moving text again. A pass sends each distinct 64-bit
key of a block once to the bucket of its leading bits; a bucket is sorted on
its own and answers with one bit per key. So a key that a third of all rows
share costs one entry a block, and a bucket's size depends on the number of
buckets alone, which follows the input.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.llm.common import U, chunks, id_text, release_memory
from relyframe.session import scratch_path

#: Kinds of keys. FILTER sends 32 bits below the bucket's (a false tie is harmless there), the others 64.
#: LEAST and DIGEST carry a number with each key and ask whether another block has a smaller one.
FILTER, EXACT, LEAST, DIGEST = 0, 1, 2, 3
MANY = 8
#: Bounds of a block's bytes of text; between them a block is a sixteenth of an even share of a task.
BLOCK_BYTES = (1 << 19, 1 << 23)
#: Bytes of text for each bucket of keys.
BUCKET_BYTES = 4_000_000
NO_ID = np.iinfo(np.int64).max

BLOCK = "blk long, doc_ids binary, null_ids binary, k1 binary, k2 binary, lens binary, blob binary"
REQUEST = "kind int, bucket long, blk long, keys binary, vals binary"
ANSWER = "blk long, kind int, bucket long, tie binary, other binary, entries long, lists long"


@dataclass
class Blocks:
    table: DataFrame
    buckets: int
    name: str

    def ask(self, fn) -> DataFrame:
        """Rows of REQUEST that ``fn(Docs)`` gives for each block."""
        buckets = self.buckets
        return self.each(lambda docs, _: request_table(docs, fn(docs), buckets), REQUEST)

    def each(self, fn, schema: str, answers: DataFrame | None = None) -> DataFrame:
        """``fn(Docs, Answers)`` gives a pyarrow table for each block; answers are brought to the blocks."""
        if answers is None:
            return self.table.groupBy("blk").applyInArrow(lambda t: _then_release(fn, Docs(t), None), schema)
        both, buckets = self.table.groupBy("blk").cogroup(answers.groupBy("blk")), self.buckets
        return both.applyInArrow(lambda left, right: _then_release(fn, Docs(left), Answers(right, buckets)), schema)

    def ask_again(self, fn, answers: DataFrame) -> DataFrame:
        buckets = self.buckets
        return self.each(lambda docs, a: request_table(docs, fn(docs, a), buckets), REQUEST, answers)

    def answer(self, requests: DataFrame) -> DataFrame:
        """Sort each bucket and write the answers (a bit or two for each key)."""
        path = scratch_path(requests.sparkSession, "answers")
        requests.groupBy("kind", "bucket").applyInArrow(_answer, ANSWER).write.option("compression", "zstd").parquet(path)
        return requests.sparkSession.read.parquet(path)


def _then_release(fn, *args):
    out = fn(*args)
    release_memory()
    return out


class Docs:
    """One block: texts as bytes, each followed by a line feed."""

    def __init__(self, table: pa.Table):
        row = {c: table.column(c)[0].as_py() for c in table.schema.names}
        self.blk, self.blob = row["blk"], row["blob"]
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.nulls = np.frombuffer(row["null_ids"], bool)
        self.k1, self.k2 = np.frombuffer(row["k1"], np.int64), np.frombuffer(row["k2"], np.int64)
        self.lens = np.frombuffer(row["lens"], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lens + 1)))[:-1].astype(np.int64)
        self.raw = np.frombuffer(self.blob, np.uint8)
        #: Order by id; a missing one comes last.
        self.order = np.where(self.nulls, NO_ID, self.ids)

    def text(self, i: int) -> bytes:
        return self.blob[self.starts[i]:self.starts[i] + self.lens[i]]

    def digests(self) -> np.ndarray:
        """A 64-bit digest of each text."""
        return np.array([int.from_bytes(hashlib.blake2b(self.text(i), digest_size=8).digest(), "little")
                         for i in range(len(self.ids))], U)

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, mask=self.nulls)


class Answers:
    """The answers to one block's keys, in the order in which it sent them."""

    def __init__(self, table: pa.Table, buckets: int):
        self.buckets, self.rows = buckets, {}
        for k, b, tie, other in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "tie", "other"))):
            self.rows[k, b] = tie, other

    def of(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both bits of each of the (distinct, ascending) keys."""
        tie, other = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for b, lo, hi in slices(keys, self.buckets):
            x, y = self.rows[kind, b]
            tie[lo:hi] = np.unpackbits(np.frombuffer(x, np.uint8), count=hi - lo).astype(bool)
            other[lo:hi] = np.unpackbits(np.frombuffer(y, np.uint8), count=hi - lo).astype(bool)
        return tie, other


def slices(keys: np.ndarray, buckets: int):
    """(bucket, from, to) of ascending keys; buckets are ranges of the leading 32 bits."""
    if not len(keys):
        return
    bucket = (keys >> U(32)) * U(buckets) >> U(32)
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for lo, hi in zip(edge.tolist(), edge[1:].tolist()):
        yield int(bucket[lo]), lo, hi


def request_table(docs: Docs, parts: list[tuple[int, np.ndarray, np.ndarray | None]], buckets: int) -> pa.Table:
    """Requests for (kind, distinct ascending keys, numbers or None)."""
    rows = []
    for kind, keys, vals in parts:
        sent = (keys & U(0xFFFFFFFF)).astype("<u4") if kind == FILTER else keys
        rows += [(kind, b, docs.blk, sent[lo:hi].tobytes(), None if vals is None else vals[lo:hi].tobytes())
                 for b, lo, hi in slices(keys, buckets)]
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())],
                    names=["kind", "bucket", "blk", "keys", "vals"])


def _answer(key, table):
    kind, bucket = key[0].as_py(), key[1].as_py()
    dtype = "<u4" if kind == FILTER else U
    parts = [np.frombuffer(x, dtype) for x in table.column("keys").to_pylist()]
    size = np.array([len(p) for p in parts])
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.concatenate(([True], s[1:] != s[:-1]))
    run = np.cumsum(first) - 1
    length = np.bincount(run)
    tie, other = np.empty(len(keys), bool), np.empty(len(keys), bool)
    tie[order] = length[run] > 1
    if kind in (LEAST, DIGEST):
        vals = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("vals").to_pylist()])[order]
        other[order] = vals > np.minimum.reduceat(vals, np.flatnonzero(first))[run]
    else:
        other[order] = length[run] >= MANY
    cut = np.cumsum(size)[:-1]
    n = len(parts)
    return pa.table([table.column("blk"), pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int64()),
                     pa.array([np.packbits(x).tobytes() for x in np.split(tie, cut)], pa.binary()),
                     pa.array([np.packbits(x).tobytes() for x in np.split(other, cut)], pa.binary()),
                     pa.array([int(length[length > 1].sum())] + [0] * (n - 1), pa.int64()),
                     pa.array([int((length > 1).sum())] + [0] * (n - 1), pa.int64())],
                    names=["blk", "kind", "bucket", "tie", "other", "entries", "lists"])


def write_blocks(docs: DataFrame) -> Blocks:
    """Pack documents into blocks, in a table under the shared folder bucketed by block."""
    spark = docs.sparkSession
    rows = id_text(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(min(BLOCK_BYTES[1], max(BLOCK_BYTES[0], total // (16 * parts))))

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        for ids, k1, k2, texts in chunks(batches, ("doc_id", "k1", "k2", "text"), size):
            data = [t.encode("utf-8") for t in texts]
            number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([np.array([i or 0 for i in ids], np.int64).tobytes()], pa.binary()),
                 pa.array([np.array([i is None for i in ids]).tobytes()], pa.binary()),
                 pa.array([np.array(k1, np.int64).tobytes()], pa.binary()),
                 pa.array([np.array(k2, np.int64).tobytes()], pa.binary()),
                 pa.array([np.array([len(d) for d in data], np.int64).tobytes()], pa.binary()),
                 pa.array([b"\n".join(data) + b"\n"], pa.binary())],
                ["blk", "doc_ids", "null_ids", "k1", "k2", "lens", "blob"])

    name = f"blocks_{uuid.uuid4().hex}"
    (rows.mapInArrow(pack, BLOCK).write.format("parquet").option("compression", "zstd")
     .option("path", scratch_path(spark, "blocks")).bucketBy(parts, "blk").saveAsTable(name))
    return Blocks(spark.table(name), max(parts, -(-total // BUCKET_BYTES)), name)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct keys, place of each key among them, how often each occurs)."""
    return np.unique(keys, return_inverse=True, return_counts=True)


def first_of_each(digests: np.ndarray) -> np.ndarray:
    """Mask of the rows that are the first with their digest."""
    out = np.zeros(len(digests), bool)
    out[np.unique(digests, return_index=True)[1]] = True
    return out


def least_of_each(inverse: np.ndarray, n: int, vals: np.ndarray) -> np.ndarray:
    """The smallest value of each of n groups."""
    out = np.full(n, NO_ID)
    np.minimum.at(out, inverse, vals)
    return out
