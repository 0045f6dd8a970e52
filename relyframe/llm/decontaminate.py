"""Benchmark decontamination with a distributed positional inverted index.

The index is a written table: one row for a block of documents, holding its
distinct terms (64-bit hashes, ascending), the bounds of each term's posting
list and the lists themselves (word positions). Positions leave a gap after
each document, so no phrase crosses documents. A phrase is searched from its
rarest term: that term's postings, moved by its offset, are intersected with
the moved lists of the next rarest terms until all are done. Document
frequencies over the whole index decide what is rare.

Test items are a stated set, read in blocks of ``WINDOW_BLOCK`` windows; each
block is broadcast and looked up in every index row. Index rows hold about
``BLOCK_CHARS`` characters, so a task's memory doesn't grow with the input.

Null text has no words. Repeated rows are documents of their own. Items with
null text occur nowhere; an item with a null id can hit words but isn't
listed. Empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm.common import ALNUM, U, Words, chunks, encoded, id_text, runs_covered
from relyframe.session import scratch_path

WINDOW = 13
#: Characters of documents in an index row.
BLOCK_CHARS = 1_000_000
#: Windows of test items that are broadcast and searched at once (about 150 bytes each).
WINDOW_BLOCK = 200_000
INDEX = "row long, doc_ids binary, null_ids binary, k1 binary, k2 binary, n_words binary, terms binary, bounds binary, positions binary"


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the positional index of ``docs`` (doc_id, text) to ``path`` and read it."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for ids, k1, k2, texts in chunks(batches, ("doc_id", "k1", "k2", "text"), BLOCK_CHARS):
            w = Words(*encoded(texts), word=ALNUM, lower=True)
            place = np.arange(len(w.hash)) + w.doc * WINDOW
            order = np.argsort(w.hash, kind="stable")
            h = w.hash[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            own = [np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids]),
                   np.array(k1, np.int64), np.array(k2, np.int64), w.count.astype(np.int64), h[first], np.append(first, len(h)).astype(np.uint32),
                   place[order].astype(np.uint32)]
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([x.tobytes()], pa.binary()) for x in own]],
                                             [c.split()[0] for c in INDEX.split(", ")])

    id_text(docs).mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def test_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, n, terms): each run of ``size`` words of an item, or the whole of a shorter one."""

    def run(batches):
        for ids, texts in chunks(batches, ("item_id", "text")):
            w = Words(*encoded(texts), word=ALNUM, lower=True)
            out = []
            for i, (a, n) in enumerate(zip(w.first.tolist(), w.count.tolist())):
                k = min(n, size)
                out += [(ids[i], k, w.hash[j:j + k].tobytes()) for j in range(a, a + n - k + 1) if k]
            out = list(dict.fromkeys(out))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()),
                 pa.array([x[2] for x in out], pa.binary())], ["item_id", "n", "terms"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item_id string, n int, terms binary").dropDuplicates()


class Block:
    """One index row."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.nulls = np.frombuffer(row["null_ids"], bool)
        self.n_words = np.frombuffer(row["n_words"], np.int64)
        self.terms = np.frombuffer(row["terms"], U)
        self.bounds = np.frombuffer(row["bounds"], np.uint32).astype(np.int64)
        self.positions = np.frombuffer(row["positions"], np.uint32)
        self.first = np.concatenate(([0], np.cumsum(self.n_words + WINDOW)))[:-1]
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.bounds))
        self.keys = term << 32 | self.positions  # ascending: every list, one after another

    def term_of(self, h: np.ndarray) -> np.ndarray:
        """Place of each term in the block's dictionary, or -1."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the query, position) of every posting of the queried terms."""
        lo, n = self.bounds[term], self.bounds[term + 1] - self.bounds[term]
        own = np.repeat(np.arange(len(term)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[own]
        return own, self.positions[at].astype(np.int64)

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the term's list holds the position."""
        key = term << 32 | np.maximum(place, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (place >= 0)


class Queries:
    """Windows as matrices, terms of each in order of rarity over the whole index."""

    def __init__(self, items: list, sizes: list[int], terms: list[bytes], frequency: dict[int, int]):
        self.items, self.n = items, np.array(sizes, np.int64)
        wide = max(sizes, default=1)
        self.hash = np.zeros((len(items), wide), U)
        self.offset = np.zeros((len(items), wide), np.int64)
        for i, raw in enumerate(terms):
            h = np.frombuffer(raw, U)
            df = np.array([frequency.get(int(x), 0) for x in h])
            order = np.argsort(df, kind="stable")
            self.hash[i, :len(h)], self.offset[i, :len(h)] = h[order], order

    def phrases(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every exact occurrence, rarest lists first."""
        empty = np.zeros(0, np.int64)
        if not len(self.items) or not len(block.terms):
            return empty, empty
        term = block.term_of(self.hash.ravel()).reshape(self.hash.shape)
        used = np.arange(term.shape[1])[None, :] < self.n[:, None]
        alive = np.flatnonzero(((term >= 0) | ~used).all(axis=1))
        if not len(alive):
            return empty, empty
        own, place = block.postings(term[alive, 0])
        own = alive[own]
        place = place - self.offset[own, 0]
        for k in range(1, term.shape[1]):
            rest = self.n[own] > k
            ok = ~rest
            ok[rest] = block.has(term[own[rest], k], place[rest] + self.offset[own[rest], k])
            own, place = own[ok], place[ok]
            if not len(own):
                break
        return own, place

    def near(self, block: Block, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest term) where every term lies at most ``slop`` words away."""
        empty = np.zeros(0, np.int64)
        if not len(self.items) or not len(block.terms):
            return empty, empty
        term = block.term_of(self.hash.ravel()).reshape(self.hash.shape)
        used = np.arange(term.shape[1])[None, :] < self.n[:, None]
        alive = np.flatnonzero(((term >= 0) | ~used).all(axis=1))
        if not len(alive):
            return empty, empty
        own, place = block.postings(term[alive, 0])
        own = alive[own]
        doc = np.searchsorted(block.first, place, "right") - 1
        low = np.maximum(place - slop, block.first[doc])
        high = np.minimum(place + slop, block.first[doc] + block.n_words[doc] - 1)
        for k in range(1, term.shape[1]):
            rest = self.n[own] > k
            t = term[own, k]
            a = np.searchsorted(block.keys, t << 32 | low)
            b = np.searchsorted(block.keys, t << 32 | high, "right")
            ok = ~rest | (b > a)
            own, place, low, high = own[ok], place[ok], low[ok], high[ok]
        return own, place


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Postings of each of the given terms in the whole index."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        total = np.zeros(len(shared.value), np.int64)
        for row in _rows(batches):
            have, bounds = np.frombuffer(row["terms"], U), np.frombuffer(row["bounds"], np.uint32).astype(np.int64)
            if len(have):
                at = np.minimum(np.searchsorted(have, shared.value), len(have) - 1)
                total += np.where(have[at] == shared.value, np.diff(bounds)[at], 0)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["term", "n"])

    found = index.select("terms", "bounds").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {int(terms[r["term"]]): r["n"] for r in found.collect()}


def query_blocks(index: DataFrame, items: DataFrame, size: int = WINDOW) -> Iterator[Queries]:
    """The windows of the items, in blocks of a bounded number, ready to search."""
    spark = index.sparkSession
    at = scratch_path(spark, "test-windows")
    test_windows(items, size).write.parquet(at)
    windows = spark.read.parquet(at)
    total = windows.count()
    parts = -(-total // (WINDOW_BLOCK // 2)) if total > WINDOW_BLOCK else 1  # hashed parts stay under the block size
    for k in range(parts):
        part = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("terms"), F.lit(parts)) == k)
        rows = sorted(part.collect(), key=lambda r: (r["terms"], r["item_id"] or ""))
        terms = np.unique(np.frombuffer(b"".join(r["terms"] for r in rows), U))
        yield Queries([r["item_id"] for r in rows], [r["n"] for r in rows], [r["terms"] for r in rows],
                      _frequencies(index, terms))


def matches(index: DataFrame, items: DataFrame, size: int = WINDOW, slop: int | None = None) -> DataFrame:
    """(doc_id, item_id, position, n_words of the window): exact phrase matches, or proximity matches when ``slop`` is given.

    ``position`` is the word in the document at which the phrase begins, or
    at which the window's rarest term stands.
    """
    out = None
    for queries in query_blocks(index, items, size):
        shared = index.sparkSession.sparkContext.broadcast(queries)

        def run(batches, shared=shared):
            q = shared.value
            for row in _rows(batches):
                block = Block(row)
                own, place = q.phrases(block) if slop is None else q.near(block, slop)
                doc = np.searchsorted(block.first, place, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids[doc], mask=block.nulls[doc]), pa.array([q.items[i] for i in own], pa.string()),
                     pa.array(place - block.first[doc]), pa.array(q.n[own])],
                    ["doc_id", "item_id", "position", "n_words"])

        part = index.mapInArrow(run, "doc_id long, item_id string, position long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_words, n_hit, n_items, items_sha256, contaminated.

    With one block of windows, one pass over the index gives the result.
    With more, each block's matches are gathered by index row and joined to
    it, so never more than one block is held.
    """
    spark: SparkSession = docs.sparkSession
    index = build_index(docs, scratch_path(spark, "positional-index"))
    hits = [index.mapInArrow(_hits(spark.sparkContext.broadcast(q)), HITS) for q in query_blocks(index, items)]
    if len(hits) == 1:
        return hits[0].mapInArrow(_verdicts, VERDICT)
    at = scratch_path(spark, "phrase-hits")
    for h in hits:
        h.select("row", "doc", "place", "size", "item").where(F.length("doc") > 0).write.mode("append").parquet(at)
    gathered = spark.read.parquet(at).groupBy("row").agg(
        *[F.array_join(F.collect_list(F.hex(c)), "").alias(c) for c in ("doc", "place", "size")],
        F.flatten(F.collect_list("item")).alias("item"))
    gathered = gathered.select("row", *[F.coalesce(F.unhex(c), F.lit(b"")).alias(c) for c in ("doc", "place", "size")], "item")
    return index.select("row", *DOCS).join(gathered, "row", "left").mapInArrow(_verdicts, VERDICT)


DOCS = ["doc_ids", "null_ids", "k1", "k2", "n_words"]
HITS = "row long, doc_ids binary, null_ids binary, k1 binary, k2 binary, n_words binary, doc binary, place binary, size binary, item array<string>"
VERDICT = "doc_id long, k1 long, k2 long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _hits(shared):
    """Index rows with the matches of one block of windows: document, position, length and item of each."""

    def run(batches):
        q = shared.value
        for row in _rows(batches):
            block = Block(row)
            own, place = q.phrases(block)
            doc = np.searchsorted(block.first, place, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["row"]]), *[pa.array([row[c]], pa.binary()) for c in DOCS],
                 *[pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (doc, place, q.n[own])],
                 pa.array([[q.items[i] for i in own]], pa.list_(pa.string()))],
                [c.split()[0] for c in HITS.split(", ")])

    return run


def _verdicts(batches):
    for row in _rows(batches):
        ids, nulls = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["null_ids"], bool)
        n_words = np.frombuffer(row["n_words"], np.int64)
        first = np.concatenate(([0], np.cumsum(n_words + WINDOW)))
        doc, place, size = (np.frombuffer(row[c] or b"", np.int64) for c in ("doc", "place", "size"))
        total = np.concatenate(([0], np.cumsum(runs_covered(int(first[-1]), place, size))))
        n_hit = total[first[:-1] + n_words] - total[first[:-1]]
        found = [set() for _ in ids]
        for d, item in set(zip(doc.tolist(), row["item"] or [])):
            if item is not None:
                found[d].add(item)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=nulls), *[pa.array(np.frombuffer(row[c], np.int64)) for c in ("k1", "k2", "n_words")],
             pa.array(n_hit.astype(np.int64)),
             pa.array([len(f) for f in found], pa.int64()),
             pa.array([hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found], pa.string()),
             pa.array((n_hit > 0) & (20 * n_hit >= n_words))], [c.split()[0] for c in VERDICT.split(", ")])
