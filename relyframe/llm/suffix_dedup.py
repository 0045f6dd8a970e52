"""Removal of long repeated byte strings by suffixes, sorted one bucket at a time.

Positions p of a text with p modulo v in a difference cover D are its cover
sample. Pass 1 ranks the sample suffixes by their first ``length - v + 1``
bytes, bucket by bucket; all that later passes need of a rank is whether it is tied. Any
two positions have a shift below v that takes both into the sample, so a
suffix with a tie of ``length`` bytes has a tied sample suffix within the next
v - 1 bytes: only such suffixes go to pass 2. It sorts them by their first
``length`` bytes, again one bucket at a time, and equal neighbours are
repeats. Suffixes and sample ranks are compared by 64-bit hashes (with the
bits of the bucket), so the order is that of the hashes, not of the bytes;
equal neighbours are the same in both. Memory is bounded by a block of texts
or a bucket of keys, both of a fixed size.

Copies of a whole text are settled by a digest: all but one of them take no
part in pass 2. Null text is empty; matches never cross rows; repeated rows
are copies of each other; a text shorter than ``length`` bytes is kept; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relyframe.llm.blocks import DIGEST, EXACT, FILTER, Answers, Docs, distinct, first_of_each, write_blocks
from relyframe.llm.common import Rolling, byte_values, difference_cover, runs_covered

LENGTH = 400
#: q of the difference cover: v = q*q + q + 1 residues, q + 1 of them in the cover.
COVER_Q = 11
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Suffixes:
    """The suffixes of one block that can be repeated."""

    def __init__(self, docs: Docs, length: int, q: int):
        self.docs, self.length = docs, length
        self.v, self.cover = difference_cover(q)
        if length < self.v:
            raise ValueError(f"length {length} is below the cover's period {self.v}")
        self.rolling = Rolling(byte_values(docs.raw))
        n = len(docs.raw)
        self.inside = np.arange(n) - np.repeat(docs.starts, docs.lens + 1)
        self.left = np.repeat(docs.lens, docs.lens + 1) - self.inside  # bytes of the text from here on
        self.long = docs.lens >= length
        self.digest = docs.digests()
        self.keys, self.whole = distinct(self.digest[self.long])[:2]
        self.copies = np.bincount(self.whole, minlength=len(self.keys))
        self.single = first_of_each(self.digest) & self.long  # one of each text in this block

    def of(self, rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return mask & np.repeat(rows, self.docs.lens + 1)

    def sample(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sample positions, and their distinct ranks' keys as ``distinct`` gives them."""
        size = self.length - self.v + 1
        ok = self.of(self.single, self.cover[self.inside % self.v] & (self.left >= size))
        at = np.flatnonzero(ok)
        return at, *distinct(self.rolling.windows(at, size))

    def first_pass(self):
        at, keys, _, _ = self.sample()
        held = np.full(len(self.keys), self.docs.blk, np.int64)
        return [(FILTER, keys, None), (DIGEST, self.keys, held)]

    def settle(self, answers: Answers) -> tuple[np.ndarray, np.ndarray]:
        """(texts that are repeated as a whole, texts that take part in pass 2)."""
        tie, elsewhere_first = answers.of(DIGEST, self.keys)
        repeated = np.zeros(len(self.long), bool)
        repeated[self.long] = (tie | (self.copies > 1))[self.whole]
        later = np.zeros(len(self.long), bool)
        later[self.long] = elsewhere_first[self.whole]
        return repeated, self.single & ~later

    def candidates(self, answers: Answers, rows: np.ndarray):
        """Suffixes near a tied sample suffix, and their keys as ``distinct`` gives them."""
        at, keys, inverse, times = self.sample()
        tied = at[(answers.of(FILTER, keys)[0] | (times > 1))[inverse]]
        lo = np.maximum(tied - (self.v - 1), tied - self.inside[tied])
        near = runs_covered(len(self.docs.raw), lo, tied - lo + 1)
        at = np.flatnonzero(self.of(rows, near & (self.left >= self.length)))
        return at, *distinct(self.rolling.windows(at, self.length))

    def second_pass(self, answers: Answers):
        _, rows = self.settle(answers)
        return [(EXACT, self.candidates(answers, rows)[1], None)]

    def removed(self, answers: Answers) -> np.ndarray:
        """Mask of the bytes to remove."""
        repeated, rows = self.settle(answers)
        at, keys, inverse, times = self.candidates(answers, rows)
        again = (answers.of(EXACT, keys)[0] | (times > 1))[inverse]
        out = runs_covered(len(self.docs.raw), at[again], self.length)
        return (out | np.repeat(repeated, self.docs.lens + 1)) & (self.left > 0)


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = COVER_Q, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_bytes``, kept (binary), by row of ``docs``."""
    blocks = write_blocks(docs)
    first = blocks.answer(blocks.ask(lambda d: Suffixes(d, length, q).first_pass()))
    second = blocks.answer(blocks.ask_again(lambda d, a: Suffixes(d, length, q).second_pass(a), first))

    def result(d: Docs, a: Answers) -> pa.Table:
        gone = Suffixes(d, length, q).removed(a)
        edge = np.concatenate(([0], np.cumsum(gone & ~np.concatenate(([False], gone[:-1])))))
        total = np.concatenate(([0], np.cumsum(gone)))
        end = d.starts + d.lens
        kept = [d.text(i) if total[b] == total[a] else d.raw[a:b][~gone[a:b]].tobytes()
                for i, (a, b) in enumerate(zip(d.starts.tolist(), end.tolist()))]
        cols = [d.id_array(), pa.array(d.lens), pa.array(total[end] - total[d.starts]),
                pa.array(edge[end] - edge[d.starts]), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        names = [c.split()[0] for c in RESULT.split(", ")]
        return pa.table(cols + [pa.array(kept, pa.binary())], names=names + ["kept"]) if keep_bytes \
            else pa.table(cols, names=names)

    return blocks.each(result, RESULT + (", kept binary" if keep_bytes else ""), first.unionByName(second))
